"""Queries of module re-exports, releases, collapsed views, canonical JSON, page headers, merge events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import canonical
from ..operators import collapse, exports, headers, merges, scouting
from .registry import Tables, query

EXPORTS = """
WITH RECURSIVE tops AS MATERIALIZED (SELECT * FROM e_tops), imp AS MATERIALIZED (SELECT *, coalesce(alias, name) AS shown FROM e_imports),
k AS MATERIALIZED (SELECT 'm' || CAST(p_partkey AS VARCHAR) AS file, 'n' || CAST(i AS VARCHAR) AS name, p_partkey AS m FROM part, unnest(range(1, 8)) AS v(i)),
ex AS (SELECT file, shown, arg_min({'kind': kind, 'name': name, 'target': target}, pos) AS e FROM imp WHERE kind = 'export' OR (kind = 'reexport' AND NOT (name = '*' AND alias IS NULL)) GROUP BY ALL),
bd AS (SELECT file, shown, arg_min({'name': name, 'target': target}, pos) AS b FROM imp WHERE kind = '' GROUP BY ALL),
s AS MATERIALIZED (SELECT k.file, k.name, k.m, e IS NOT NULL AS listed, e.kind AS kind, e, l.id AS local_id, b, o.id AS own_id FROM k LEFT JOIN ex ON ex.file = k.file AND ex.shown = k.name LEFT JOIN tops l ON l.file = k.file AND e.kind = 'export' AND l.name = e.name
  LEFT JOIN bd ON bd.file = k.file AND e.kind = 'export' AND bd.shown = e.name LEFT JOIN (SELECT * FROM tops WHERE exported AND (file, name) NOT IN (SELECT (file, name) FROM imp WHERE kind = 'export')) o ON o.file = k.file AND o.name = k.name),
st AS MATERIALIZED (SELECT file, name, m, CASE WHEN kind = 'reexport' AND e.name = '*' THEN e.target WHEN kind = 'export' THEN coalesce(local_id, CASE WHEN b.name = '*' THEN b.target END) WHEN NOT listed THEN own_id END AS id,
  CASE WHEN kind = 'reexport' AND e.name <> '*' AND e.target IS NOT NULL THEN {'f': e.target, 'n': e.name} WHEN kind = 'export' AND local_id IS NULL AND b.name <> '*' AND b.target IS NOT NULL THEN {'f': b.target, 'n': b.name} END AS next,
  NOT listed AND own_id IS NULL AS star FROM s),
w AS (SELECT file, name, file AS f, name AS n FROM st UNION SELECT w.file, w.name, st.next.f, st.next.n FROM w JOIN st ON st.file = w.f AND st.name = w.n WHERE st.next IS NOT NULL),
ends AS MATERIALIZED (SELECT w.file, w.name, w.f, w.n FROM w JOIN st ON st.file = w.f AND st.name = w.n WHERE st.next IS NULL),
d AS MATERIALIZED (SELECT DISTINCT st.file, st.name, st.m % 4 AS layer, ends.f, ends.n, target FROM st JOIN imp ON imp.file = st.file AND imp.kind = 'reexport' AND imp.name = '*' AND imp.alias IS NULL JOIN ends ON ends.file = imp.target AND ends.name = st.name WHERE star AND imp.target IS NOT NULL),
v0 AS MATERIALIZED (SELECT file, name, id FROM st WHERE next IS NULL AND id IS NOT NULL),
v1 AS MATERIALIZED (SELECT * FROM v0 UNION ALL SELECT d.file, d.name, min(v.id) FROM d JOIN v0 v ON v.file = d.f AND v.name = d.n WHERE layer = 1 GROUP BY d.file, d.name HAVING count(DISTINCT v.id) = 1),
v2 AS MATERIALIZED (SELECT * FROM v1 UNION ALL SELECT d.file, d.name, min(v.id) FROM d JOIN v1 v ON v.file = d.f AND v.name = d.n WHERE layer = 2 GROUP BY d.file, d.name HAVING count(DISTINCT v.id) = 1),
t3 AS MATERIALIZED (SELECT DISTINCT d.file, d.name, v.id FROM d JOIN v2 v ON v.file = d.f AND v.name = d.n WHERE layer = 3),
ring AS MATERIALIZED (SELECT d.file, d.name, d.f, d.n, EXISTS (SELECT 1 FROM d b WHERE b.file = d.f AND b.name = d.n AND b.f = d.file AND b.n = d.name) AS mutual FROM d WHERE layer = 3),
one3 AS (SELECT file, name, min(id) AS id FROM t3 GROUP BY ALL HAVING count(DISTINCT id) = 1),
t4 AS (SELECT * FROM t3 UNION SELECT r.file, r.name, t3.id FROM ring r JOIN t3 ON t3.file = r.f AND t3.name = r.n WHERE mutual UNION SELECT r.file, r.name, o.id FROM ring r JOIN one3 o ON o.file = r.f AND o.name = r.n WHERE NOT mutual),
v3 AS MATERIALIZED (SELECT * FROM v2 UNION ALL SELECT file, name, min(id) FROM t4 GROUP BY ALL HAVING count(DISTINCT id) = 1)
SELECT k.file, k.name, v3.id FROM k JOIN ends ON ends.file = k.file AND ends.name = k.name LEFT JOIN v3 ON v3.file = ends.f AND v3.name = ends.n
UNION ALL SELECT k.file, k.name, NULL FROM k WHERE (file, name) NOT IN (SELECT (file, name) FROM ends)"""


@query("j10_exports", EXPORTS)
def export_chains(t: Tables) -> DataFrame:
    asks = t.part.select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("file"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.concat(F.lit("n"), i.cast("string")))).alias("name"))
    return exports.exported(asks, t.e_tops, t.e_imports)


VERSIONS = r"""
WITH sub AS (SELECT *, CAST(string_split(version, '.') AS INT[]) AS v FROM r_subjects), live AS (SELECT *, v[1] AS major FROM sub WHERE NOT held),
l AS (SELECT fixture, stack, kind, name, major, max(list_resize(v, 6, 0)) AS most, least(arg_min(len(v), pos), 2) AS parts FROM live GROUP BY ALL),
l2 AS (SELECT *, major = max(major) OVER (PARTITION BY kind, name) OR (major = max(major) OVER (PARTITION BY fixture, stack, kind, name) AND max(major) OVER (PARTITION BY fixture, kind, name) = max(major) OVER (PARTITION BY kind, name)) AS leads FROM l),
pl AS (SELECT kind, name, 'new' AS found, CAST(string_split(ltrim(version, 'v'), '.') AS INT[]) AS r, version, NULL::INT[] AS st FROM r_releases WHERE NOT pre),
pe AS (SELECT kind, name, 'pre' AS found, version, regexp_extract(version, '^(\d+)\.0\.0-alpha\.(\d+)', ['a', 'n']) AS al, regexp_extract(version, '^(\d+)\.(\d+)(?:\.\d+)?-?(beta|rc)\.?(\d+)$', ['a', 'b', 's', 'n']) AS g, regexp_extract(version, '^(\d+)-ea$', 1) AS ea FROM r_releases WHERE pre AND kind = 'runtime'),
pr AS (SELECT kind, name, found, CASE WHEN al.a <> '' THEN [TRY_CAST(al.a AS INT)] WHEN g.a <> '' THEN [TRY_CAST(g.a AS INT), TRY_CAST(g.b AS INT)] ELSE [TRY_CAST(ea AS INT)] END AS r, version, CASE WHEN al.a <> '' THEN [1, TRY_CAST(al.n AS INT)] WHEN g.a <> '' THEN [CASE g.s WHEN 'rc' THEN 3 ELSE 2 END, TRY_CAST(g.n AS INT)] ELSE [0, 0] END AS st FROM pe WHERE al.a <> '' OR g.a <> '' OR ea <> ''),
o AS (SELECT kind, name, found, r, version, list_resize(list_concat(r, coalesce(st, [])), 6, 0) AS key FROM (SELECT * FROM pl UNION ALL SELECT * FROM pr)),
h AS (SELECT l2.*, o.found, o.version, o.key, o.r FROM l2 JOIN o USING (kind, name) WHERE (leads AND r[1] > major) OR (parts = 2 AND r[1] = major AND coalesce(r[2], 0) > most[2])),
f AS (SELECT fixture, stack, kind, name, major, parts, arg_max({'found': found, 'version': version, 'r': r}, {'n': found = 'new', 'key': key, 'version': version}) AS b FROM h GROUP BY ALL),
best AS (SELECT fixture, stack, kind, name, major, b.found AS found, CASE WHEN b.found = 'pre' THEN b.version WHEN parts = 2 THEN CAST(b.r[1] AS VARCHAR) || '.' || CAST(coalesce(b.r[2], 0) AS VARCHAR) ELSE CAST(b.r[1] AS VARCHAR) END AS version FROM f)
"""


@query("a25_newest", VERSIONS + "SELECT * FROM best")
def newest_releases(t: Tables) -> DataFrame:
    return scouting.newest(t.r_subjects, t.r_releases)


@query(
    "a26_resolved",
    VERSIONS + r""", tt AS (SELECT DISTINCT title, regexp_extract(title, '^([^\s/]+)/(\S+) (\S+) is out$', ['w', 'label', 'v']) AS o, regexp_extract(title, '^(\S+) (\S+) is past end of support$', ['n', 'v']) AS e FROM r_titles),
a AS (SELECT title, split_part(o.w, '@', 1) AS fixture, CASE WHEN contains(o.w, '@') THEN split_part(o.w, '@', 2) END AS stack, o.label AS label, CAST(string_split(ltrim(o.v, 'v'), '.') AS INT[]) AS want FROM tt WHERE o.v <> '' AND NOT contains(o.v, 'rc')),
ok AS (SELECT DISTINCT title FROM a JOIN sub s ON s.fixture = a.fixture AND (a.stack IS NULL OR a.stack = s.stack) AND a.label = CASE WHEN s.kind = 'crate' THEN 'crate:' ELSE '' END || s.name WHERE list_resize(v[1:least(len(v), len(want))], 6, 0) >= list_resize(want, 6, 0)
UNION SELECT title FROM tt WHERE e.n <> '' AND NOT EXISTS (SELECT 1 FROM r_subjects s WHERE s.kind = 'runtime' AND s.name = e.n AND s.version = e.v))
SELECT title, title IN (SELECT title FROM ok) AS resolved, o.v <> '' AND contains(o.v, 'rc') AND title NOT IN (SELECT title FROM r_titles WHERE stands) AS superseded FROM tt""",
)
def resolved_titles(t: Tables) -> DataFrame:
    return scouting.settled(t.r_titles, t.r_subjects, t.r_titles.filter("stands"))


MERGES = """
WITH k AS (SELECT e.*, a.scope FROM m_events e LEFT JOIN m_areas a USING (repo)), p AS (SELECT DISTINCT scope, path FROM m_pages WHERE state <> 'implemented'),
h AS (SELECT p.*, c."trigger" AS tr, c.package FROM p JOIN m_cases c USING (scope, path)), fr AS (SELECT * FROM p WHERE (scope, path) NOT IN (SELECT (scope, path) FROM m_cases)),
r AS (SELECT DISTINCT event FROM k JOIN h USING (scope) WHERE tr <> 'merge' OR len(list_filter(evidence, lambda b: NOT contains(package, b))) > 0),
f AS (SELECT *, scope IS NOT NULL AND event NOT IN (SELECT event FROM r) AS fits FROM k), g AS (SELECT *, arg_min(evidence, event) FILTER (fits) OVER (PARTITION BY scope) AS ev1, min(event) FILTER (fits) OVER (PARTITION BY scope) AS e1 FROM f),
d AS (SELECT event, scope, e1, CASE WHEN scope IS NULL THEN 'unknown' WHEN fits AND (scope NOT IN (SELECT scope FROM fr) OR event = e1 OR len(list_filter(evidence, lambda b: NOT contains(array_to_string(ev1, chr(10)), b))) = 0) THEN 'landed' ELSE 'deferred' END AS decision FROM g)
"""


@query("j24_merges", MERGES + "SELECT event, scope, decision FROM d")
def merge_decisions(t: Tables) -> DataFrame:
    return merges.land(t.m_events, t.m_areas, t.m_pages, t.m_cases, ["planned", "partial"])[0]


@query("j24_cases", MERGES + "SELECT scope, path, event FROM fr JOIN d USING (scope) WHERE event = e1 AND decision = 'landed'")
def merge_cases(t: Tables) -> DataFrame:
    return merges.land(t.m_events, t.m_areas, t.m_pages, t.m_cases, ["planned", "partial"])[1]


IMAGES = """
WITH op AS MATERIALIZED (SELECT element FROM g_open), im AS MATERIALIZED (SELECT id, path, CASE WHEN split_part(path, '/', 1) NOT IN (SELECT * FROM op) THEN split_part(path, '/', 1) WHEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2) NOT IN (SELECT * FROM op) THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2)
  WHEN path NOT IN (SELECT * FROM op) THEN path ELSE id END AS image FROM g_nodes)"""


@query("g15_view", IMAGES + " SELECT a.image AS source, b.image AS target, relation || '/' || confidence AS kind, count(*) AS n FROM g_edges e JOIN im a ON a.id = e.source JOIN im b ON b.id = e.target WHERE relation IN ('calls', 'references') AND a.image <> b.image GROUP BY ALL")
def collapsed_edges(t: Tables) -> DataFrame:
    return collapse.view(t.g_nodes, t.g_edges, t.g_open, ["calls", "references"])[1]


@query("g15_elements", IMAGES + " SELECT image AS element, CASE WHEN contains(image, '#') THEN 'symbol' WHEN ends_with(image, '.py') THEN 'file' ELSE 'directory' END AS kind, count(*) AS members FROM im GROUP BY ALL")
def collapsed_elements(t: Tables) -> DataFrame:
    return collapse.view(t.g_nodes, t.g_edges, t.g_open, ["calls", "references"])[0]


WITH_DOCS = IMAGES + """, pg AS (SELECT path FROM g_pages), ln AS (SELECT 'docs/' || CAST(source AS VARCHAR) || '.md' AS source, 'docs/' || CAST(target AS VARCHAR) || '.md' AS target FROM t_links),
lk AS (SELECT source, target, 'link' AS kind, count(*) AS n FROM ln WHERE source <> target AND source IN (SELECT path FROM pg) AND target IN (SELECT path FROM pg) GROUP BY ALL), rf AS (SELECT * FROM g_page_refs WHERE page IN (SELECT path FROM pg)),
dd AS (SELECT page AS source, path AS target, 'link' AS kind, count(*) AS n FROM rf WHERE path IN (SELECT path FROM pg) AND page <> path AND (page, path) NOT IN (SELECT (source, target) FROM lk) GROUP BY ALL),
el AS (SELECT DISTINCT split_part(path, '/', 1) AS e FROM im UNION SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM im UNION SELECT path FROM im),
ei AS (SELECT e, CASE WHEN split_part(e, '/', 1) NOT IN (SELECT * FROM op) THEN split_part(e, '/', 1) WHEN contains(e, '/') AND split_part(e, '/', 1) || '/' || split_part(e, '/', 2) NOT IN (SELECT * FROM op) THEN split_part(e, '/', 1) || '/' || split_part(e, '/', 2) ELSE e END AS image FROM el),
cd AS (SELECT page, rf.path, coalesce(im.image, CASE WHEN symbol IS NULL THEN ei.image END) AS image FROM rf LEFT JOIN im ON im.id = symbol LEFT JOIN ei ON ei.e = rf.path WHERE rf.path NOT IN (SELECT path FROM pg))"""


@query("g16_documents", WITH_DOCS + " SELECT * FROM lk UNION ALL SELECT * FROM dd UNION ALL SELECT page, image, 'ref', count(*) FROM cd WHERE image IS NOT NULL GROUP BY ALL")
def document_edges(t: Tables) -> DataFrame:
    name = lambda c: F.concat(F.lit("docs/"), F.col(c).cast("string"), F.lit(".md")).alias(c)
    return collapse.with_documents(t.g_nodes, t.g_open, t.g_pages.select("path"), t.t_links.select(name("source"), name("target")), t.g_page_refs)[1]


@query("g16_missing", WITH_DOCS + " SELECT pg.path, coalesce(array_to_string(list_sort(list(DISTINCT cd.path) FILTER (cd.path IS NOT NULL)), ','), '') AS missing FROM pg LEFT JOIN cd ON cd.page = pg.path AND image IS NULL GROUP BY pg.path")
def missing_refs(t: Tables) -> DataFrame:
    name = lambda c: F.concat(F.lit("docs/"), F.col(c).cast("string"), F.lit(".md")).alias(c)
    return collapse.with_documents(t.g_nodes, t.g_open, t.g_pages.select("path"), t.t_links.select(name("source"), name("target")), t.g_page_refs)[0].select("path", F.array_join("missing", ",").alias("missing"))


@query("f6_hashes", """SELECT o_orderkey AS key, 'sha256:' || sha256('[{"a":"' || o_orderstatus || '","b":{"x":' || CAST(o_custkey AS VARCHAR) || ',"y":[1,{"p":null,"q":true}]}},1]') AS h FROM orders""")
def canonical_hashes(t: Tables) -> DataFrame:
    return t.j_json.select("key", canonical.json_hash(F.col("inputs"), F.lit(" 1 ")).alias("h"))


@query("f19_strict_keys", """SELECT o_orderkey AS key, CASE o_orderkey % 4 WHEN 1 THEN 'unknown: more' WHEN 2 THEN 'missing: id' WHEN 3 THEN 'no object' END AS problem, CAST(o_custkey AS BIGINT) AS x FROM orders""")
def strict_keys(t: Tables) -> DataFrame:
    return t.j_json.select("key", canonical.key_problem(F.col("row"), ["id", "kind"]).alias("problem"), canonical.field(F.col("inputs"), "$.b.x", "long").alias("x"))


@query(
    "s7_pages",
    r"""WITH h AS (SELECT *, starts_with(text, '---') AS opened, starts_with(text, '---' || chr(10) || 'title: open') AS endless, contains(text, '= odd') AS odd FROM h_pages)
SELECT path, CASE WHEN opened AND NOT endless AND NOT odd AND contains(text, 'title: "') THEN regexp_extract(text, 'title: "([^"]*)"', 1) ELSE regexp_replace(split_part(path, '/', -1), '[.]md$', '') END AS title,
  CASE WHEN opened AND NOT endless AND NOT odd THEN regexp_extract(text, 'type: ([^\n]*)', 1) ELSE '' END AS type, CASE WHEN opened AND NOT endless AND NOT odd THEN regexp_replace(regexp_extract(text, 'tags: \[([^\]]*)', 1), ', ', ',') ELSE '' END AS tags,
  CASE WHEN opened AND NOT endless AND NOT odd THEN regexp_extract(text, 'id: ([^\n]*)', 1) || ':r1,:r2' ELSE '' END AS sources, opened AND NOT endless AS has_header, CASE WHEN endless THEN 'no end' WHEN odd THEN '= odd' END AS broken,
  CASE WHEN contains(text, '[x]') THEN 'other.md#a,wiki page' WHEN ends_with(path, '/index.md') AND NOT opened AND starts_with(text, '*') THEN array_to_string(list_sort(regexp_extract_all(text, '\]\(([^)]*)', 1)), ',') ELSE '' END AS links FROM h""",
)
def header_pages(t: Tables) -> DataFrame:
    pages = headers.read_pages(t.h_pages)
    sources = F.array_join(F.transform("sources", lambda s: F.concat(F.coalesce(s["id"], F.lit("")), F.lit(":"), F.coalesce(s["resource"], F.lit("")))), ",")
    return pages.select("path", "title", "type", F.array_join("tags", ",").alias("tags"), sources.alias("sources"), "has_header", "broken", F.array_join("links", ",").alias("links"))


@query(
    "c11_header_findings",
    r"""WITH h AS (SELECT *, regexp_extract(path, '(\d+)(/index)?[.]md$', 1) AS k, starts_with(text, '---' || chr(10) || 'title: open') AS endless, contains(text, '= odd') AS odd, starts_with(text, '---') AS opened FROM h_pages), g AS (SELECT *, opened AND NOT endless AND NOT odd AS good FROM h),
x AS (SELECT path, unnest(['title', 'type', 'runtime', 'tags', 'sources', 'generated']) AS key, text, good FROM g WHERE path = 'index.md')
SELECT path, 'frontmatter-unparsable' AS rule, 'error' AS severity, CASE WHEN endless THEN 'no end' ELSE '= odd' END AS message FROM g WHERE endless OR odd
UNION ALL SELECT path, 'generated-by-missing', 'error', '' FROM g WHERE good AND contains(text, 'generated:') AND NOT contains(text, 'by: tool')
UNION ALL SELECT path, 'computation-runtime-missing', 'error', '' FROM g WHERE good AND contains(text, 'Attested') AND NOT contains(text, 'runtime:')
UNION ALL SELECT path, 'index-frontmatter-misplaced', 'error', 'only the root catalog may have a header' FROM g WHERE ends_with(path, 'index.md') AND opened AND NOT endless
UNION ALL SELECT path, 'source-id-missing', 'warning', 'sources[1]' FROM g WHERE good""",
)
def header_checks(t: Tables) -> DataFrame:
    return headers.header_findings(headers.read_pages(t.h_pages), "version")


@query("c22_undescribed", r"SELECT path, 'index-entry-without-description' AS rule, 'warning' AS severity, 'p' || CAST(k + 70 AS VARCHAR) || '.md' AS message FROM (SELECT path, CAST(regexp_extract(path, '^d(\d+)/', 1) AS INT) AS k FROM h_pages WHERE starts_with(text, '* [a]'))")
def undescribed(t: Tables) -> DataFrame:
    return headers.undescribed(headers.read_pages(t.h_pages))


@query("c16_unlisted", r"WITH p AS (SELECT DISTINCT path, split_part(path, '/', 1) AS d, CAST(regexp_extract(path, '(\d+)[.]md$', 1) AS INT) AS k FROM h_pages WHERE path LIKE 'd%/p%.md'), c AS (SELECT path AS catalog, split_part(path, '/', 1) AS d, CAST(regexp_extract(path, '^d(\d+)/', 1) AS INT) AS b FROM h_pages WHERE starts_with(text, '* [a]')) SELECT catalog AS path, 'catalog-malformed' AS rule, 'error' AS severity, 'p' || CAST(k AS VARCHAR) || '.md' AS message FROM p JOIN c USING (d) WHERE k NOT IN (b, b + 70, b + 140, b + 210)")
def unlisted(t: Tables) -> DataFrame:
    return headers.unlisted(headers.read_pages(t.h_pages))
