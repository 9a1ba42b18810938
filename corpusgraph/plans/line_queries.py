"""Queries of the operators on lines: fences, headers, markers, references, ignore rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ignore, line_state, references
from .registry import Tables, query

#: Fence state by recursion over a file's fence lines; `kind` is what a fence is told by.
FENCES = """
WITH RECURSIVE k AS (SELECT path, line_no, {kind} AS kind, row_number() OVER (PARTITION BY path ORDER BY line_no) AS n FROM v_lines WHERE regexp_matches(line, '^\\s*(```|~~~)')),
s AS (SELECT path, n, line_no, kind AS open, true AS opens FROM k WHERE n = 1 UNION ALL SELECT k.path, k.n, k.line_no, CASE WHEN s.open = '' THEN k.kind WHEN s.open = k.kind THEN '' ELSE s.open END,
  CASE WHEN s.open = '' THEN true WHEN s.open = k.kind THEN false END FROM s JOIN k ON k.path = s.path AND k.n = s.n + 1),
f AS (SELECT v.*, coalesce(last_value(s.opens IGNORE NULLS) OVER (PARTITION BY v.path ORDER BY v.line_no ROWS UNBOUNDED PRECEDING), false) OR coalesce(NOT s.opens, false) AS fenced FROM v_lines v LEFT JOIN s USING (path, line_no))"""
BY_KIND = FENCES.replace("{kind}", "left(ltrim(line), 3)")
ANY_KIND = FENCES.replace("{kind}", "'fence'")


@query("w9_fences", BY_KIND + " SELECT path, line_no, fenced FROM f")
def fenced(t: Tables) -> DataFrame:
    return line_state.fences(t.v_lines).select("path", "line_no", "fenced")


@query(
    "a29_conflict_boxes",
    ANY_KIND + r""", b AS (SELECT path, count(*) AS found FROM f WHERE NOT fenced AND regexp_matches(line, '^[ \t]*>\s*\[!conflict\]', 'i') GROUP BY path),
d AS (SELECT DISTINCT path, CASE WHEN suppkey % 3 <> 0 THEN CAST(suppkey % 7 AS BIGINT) END AS declared FROM v_lines)
SELECT path, coalesce(found, 0) AS found, declared, CASE WHEN declared IS NULL THEN 'declaration is missing' ELSE 'counts differ' END AS message FROM d LEFT JOIN b USING (path) WHERE CASE WHEN declared IS NULL THEN coalesce(found, 0) > 0 ELSE declared <> coalesce(found, 0) END""",
)
def conflict_boxes(t: Tables) -> DataFrame:
    lines = t.v_lines
    declared = lines.select("path", F.when(F.col("suppkey") % 3 != 0, F.col("suppkey") % 7).alias("conflicts")).distinct()
    return line_state.conflict_findings(lines.select("path", "line_no", "line"), declared)


@query(
    "w8_headers",
    r"""WITH r AS (SELECT *, regexp_matches(line, '^@@ ') AS hd FROM w_patch),
h AS (SELECT *, sum(CAST(hd AS INT)) OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS hunk FROM r),
g AS (SELECT *, CASE WHEN hd THEN regexp_extract(line, '^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))?', ['a', 'o', 'c', 'n']) END AS e FROM h),
c AS (SELECT *, first_value(e) OVER w AS e1, row_number() OVER w AS k FROM g WINDOW w AS (PARTITION BY path, hunk ORDER BY line_no)),
q AS (SELECT *, CASE WHEN e1.o = '' THEN 1 ELSE CAST(e1.o AS INT) END AS o, CASE WHEN e1.n = '' THEN 1 ELSE CAST(e1.n AS INT) END AS nn FROM c WHERE hunk > 0),
u AS (SELECT *, NOT hd AND (coalesce(sum(CAST(left(line, 1) = '-' AND NOT hd AS INT)) OVER p, 0) < o OR coalesce(sum(CAST(left(line, 1) = '+' AND NOT hd AS INT)) OVER p, 0) < nn) AS body FROM q WINDOW p AS (PARTITION BY path, hunk ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
heads AS (SELECT path, line_no, line FROM h WHERE line LIKE '--- _%' OR line LIKE '+++ _%' EXCEPT SELECT path, line_no, line FROM u WHERE body),
names AS (SELECT u.path, u.hunk, max_by(n.line, n.line_no) FILTER (n.line LIKE '---%') AS m, max_by(n.line, n.line_no) FILTER (n.line LIKE '+++%') AS p FROM u JOIN heads n ON u.hd AND n.path = u.path AND n.line_no BETWEEN u.line_no - 2 AND u.line_no GROUP BY ALL),
b AS (SELECT path, hunk, string_agg(line, '|' ORDER BY line_no) AS lines FROM u WHERE body GROUP BY ALL)
SELECT u.path, CASE WHEN p LIKE '%/dev/null' THEN substr(m, 7) ELSE substr(p, 7) END AS file, CAST(u.hunk AS BIGINT) AS hunk, CASE WHEN nn = 0 THEN greatest(CAST(e1.c AS INT), 1) ELSE CAST(e1.c AS INT) END AS line_from,
  CASE WHEN nn = 0 THEN greatest(CAST(e1.c AS INT), 1) ELSE CAST(e1.c AS INT) + nn - 1 END AS line_to, coalesce(b.lines, '') AS lines, CAST(0 AS BIGINT) AS omitted FROM u JOIN names USING (path, hunk) LEFT JOIN b USING (path, hunk) WHERE u.hd""",
)
def headers(t: Tables) -> DataFrame:
    return line_state.hunks(t.w_patch).select("path", "file", "hunk", "line_from", "line_to", F.array_join("lines", "|").alias("lines"), F.col("omitted").cast("long").alias("omitted"))


NATIVES = [
    line_state.Marker("no cover", "pragma: no cover", (".py", ".js")),
    line_state.Marker("skip", "skip-start", (".py",), "start", True),
    line_state.Marker("skip", "skip-stop", (".py",), "stop", True),
]
MARKERS = r"""
WITH l AS (SELECT path, CAST(line_no AS BIGINT) AS line_no, line, lag(line) OVER (PARTITION BY path ORDER BY line_no) AS above, max(line_no) OVER (PARTITION BY path) AS last FROM x_src),
own AS (SELECT path, line_no + CASE WHEN line IN ('# coverage:exempt', '-- coverage:exempt: odd') THEN 1 ELSE 0 END AS line, true AS own, line <> '# coverage:exempt' AS reason FROM l WHERE line IN ('x = 1  # coverage:exempt: slow', '# coverage:exempt', '-- coverage:exempt: odd')),
o AS (SELECT path, line, own, bool_or(reason) AS reason FROM own GROUP BY ALL),
nc AS (SELECT path, line_no, above = '# too slow' OR (NOT ends_with(path, '.py') AND above IN ('# skip-start', '# skip-stop')) AS ok FROM l WHERE line = '# pragma: no cover'),
t AS (SELECT path, line_no, line, last, coalesce(lag(line) OVER (PARTITION BY path ORDER BY line_no), '# skip-stop') AS before FROM l WHERE ends_with(path, '.py') AND line IN ('# skip-start', '# skip-stop')),
b AS (SELECT path, line_no AS opened, last, line, lead(line_no) OVER (PARTITION BY path ORDER BY line_no) AS stop FROM t WHERE line <> before),
s AS (SELECT path, opened, stop, unnest(range(opened, coalesce(stop, last) + 1)) AS line FROM b WHERE line = '# skip-start'),
n AS (SELECT path, unnest([line_no, line_no + 1]) AS line FROM nc UNION SELECT path, line FROM s),
e AS (SELECT * FROM o UNION ALL SELECT path, line, false, false FROM n WHERE (path, line) NOT IN (SELECT (path, line) FROM o))
"""


@query("f21_exemptions", MARKERS + "SELECT path, CAST(line AS BIGINT) AS line, own, reason FROM e")
def exempt_lines(t: Tables) -> DataFrame:
    return line_state.exemptions(t.x_src.withColumn("line_no", F.col("line_no").cast("long")), NATIVES)[0]


@query(
    "f21_findings",
    MARKERS + """SELECT path, CAST(0 AS BIGINT) AS line, 'coverage:exempt-file without a reason' AS message FROM l WHERE line = '# coverage:exempt-file'
UNION ALL SELECT path, line_no, 'no cover without a reason' FROM nc WHERE NOT coalesce(ok, false) UNION ALL SELECT DISTINCT path, opened, 'skip without a stop' FROM s WHERE stop IS NULL""",
)
def exemption_findings(t: Tables) -> DataFrame:
    return line_state.exemptions(t.x_src.withColumn("line_no", F.col("line_no").cast("long")), NATIVES)[2]


@query("f21_files", MARKERS + "SELECT path, true AS own, bool_or(line = '// coverage:exempt-file - generated') AS reason, false AS native FROM l WHERE line IN ('// coverage:exempt-file - generated', '# coverage:exempt-file') GROUP BY path")
def exempt_files(t: Tables) -> DataFrame:
    return line_state.exemptions(t.x_src.withColumn("line_no", F.col("line_no").cast("long")), NATIVES)[1]


REFS = BY_KIND + r""", r AS (SELECT path AS page, unnest([
  {'path': 'src/' || regexp_extract(line, 'src/(p\d+)', 1) || '.py', 'a': CAST(regexp_extract(line, 'py:(\d+)', 1) AS INT), 'b': 9, 'k': 6}, {'path': 's/' || regexp_extract(line, 'src/(p\d+)', 1) || '.py', 'a': NULL, 'b': NULL, 'k': 6}]) AS x FROM f WHERE NOT fenced AND starts_with(line, 'see ')
UNION ALL SELECT path, {'path': 'b/' || regexp_extract(line, 'b/(\d+)', 1) || '.go', 'a': NULL, 'b': NULL, 'k': 7} FROM f WHERE NOT fenced AND starts_with(line, '[up]'))"""


@query("f2_references", REFS + " SELECT page, x.path AS path, CAST(x.a AS INT) AS line_from, CAST(x.b AS INT) AS line_to FROM r")
def page_references(t: Tables) -> DataFrame:
    return references.document_refs(t.v_lines.select("path", "line_no", "line"))


@query(
    "j41_code_links",
    REFS.replace("WITH RECURSIVE", "WITH RECURSIVE fl AS (SELECT 'src/p' || CAST(p_partkey AS STRING) || '.py' AS path, p_partkey AS key FROM part WHERE p_partkey % 3 > 0), sy AS (SELECT path, path || '#' || CAST(k AS STRING) AS id, k AS a, k + 4 - k % 2 AS b FROM fl, (VALUES (1), (2), (4)) AS v(k)),")
    + """, w AS (SELECT DISTINCT page, x.path AS path, CAST(x.a AS INT) AS line_from FROM r),
i AS (SELECT path, line_from, arg_min(id, {'w': b - a, 'id': id}) AS symbol FROM (SELECT DISTINCT path, line_from FROM w) JOIN sy USING (path) WHERE line_from BETWEEN a AND b GROUP BY ALL)
SELECT page, w.path, w.line_from, symbol, fl.path IS NULL AS missing FROM w LEFT JOIN fl ON fl.path = w.path LEFT JOIN i ON i.path = w.path AND i.line_from = w.line_from""",
)
def code_links(t: Tables) -> DataFrame:
    files = t.part.filter("p_partkey % 3 > 0").select(F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"))
    k = F.col("k")
    symbols = files.select("path", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))).alias("k")).select("path", F.concat("path", F.lit("#"), k.cast("string")).alias("id"), k.alias("span_from"), (k + 4 - k % 2).alias("span_to"))
    refs = references.document_refs(t.v_lines.select("path", "line_no", "line"))
    return references.code_links(refs, files, symbols)


@query(
    "p12_ignored",
    r"""WITH f AS (SELECT row_number() OVER () AS r, path, tracked FROM i_files),
p AS (SELECT level, base, line_no, starts_with(line, '!') AS negate, ends_with(line, '/') AS dir_only, regexp_replace(regexp_replace(line, '^!', ''), '/$', '') AS l FROM i_rules WHERE NOT starts_with(line, '#')),
rx AS (SELECT level, base, line_no, negate, dir_only, regexp_extract(l, '^/?([A-Za-z0-9]*)', 1) AS lit, CASE WHEN contains(l, '/') THEN '^' || CASE WHEN starts_with(l, '/') THEN '' ELSE '/' END ELSE '(^|/)' END || replace(replace(replace(replace(replace(l, '.', '[.]'), '/**/', '\x01'), '*', '[^/]*'), '?', '[^/]'), '\x01', '/([^/]+/)*') || '$' AS re FROM p),
u AS (SELECT r, tracked, array_to_string(string_split(path, '/')[1:i], '/') AS unit, i < len(string_split(path, '/')) AS is_dir FROM f, unnest(range(1, 9)) AS v(i) WHERE i <= len(string_split(path, '/'))),
d AS (SELECT DISTINCT unit, is_dir FROM u),
m AS (SELECT unit, is_dir, arg_max(negate, {'l': level, 'b': length(base), 'n': line_no}) AS negate FROM d JOIN rx ON (base = '' OR starts_with(unit, base || '/')) AND (is_dir OR NOT dir_only) AND CASE WHEN contains(unit, lit) THEN regexp_matches(CASE WHEN base = '' THEN '/' || unit ELSE substr(unit, length(base) + 1) END, re) ELSE false END GROUP BY ALL)
SELECT path, tracked, bool_or(coalesce(NOT negate, false)) AND NOT tracked AS ignored FROM f JOIN u USING (r, tracked) LEFT JOIN m USING (unit, is_dir) GROUP BY r, path, tracked""".replace("\\x01", "<>"),
)
def ignored_files(t: Tables) -> DataFrame:
    return ignore.ignored(t.i_files, ignore.parse_rules(t.i_rules), tracked="tracked")
