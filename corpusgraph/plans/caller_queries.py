"""Queries of answers with evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import language
from ..operators import callers
from .registry import Tables, query

#: Each question's start: the symbol 'O<n>' of least score, path and id.
START = """
WITH asks AS (SELECT DISTINCT 'O' || CAST(custkey AS VARCHAR) AS ask FROM g_files WHERE custkey % 5 = 1), sy AS MATERIALIZED (SELECT * FROM g_symbols), si AS MATERIALIZED (SELECT * FROM g_sites), ln AS MATERIALIZED (SELECT * FROM g_lines),
hit AS MATERIALIZED (SELECT DISTINCT ask, id, name, path, CASE WHEN name <> ask THEN 2 ELSE 0 END + CASE WHEN is_test THEN 1 ELSE 0 END AS score FROM asks JOIN sy ON lower(name) = lower(ask) OR ends_with(lower(id), '#' || lower(ask)) WHERE NOT starts_with(path, 'asia/')),
st AS MATERIALIZED (SELECT ask, arg_min({'id': id, 'name': name}, {'a': score, 'b': path, 'c': id}) AS s FROM hit GROUP BY ask)
"""


def asked(t: Tables) -> tuple[DataFrame, DataFrame]:
    asks = t.g_files.filter("custkey % 5 = 1").select(F.concat(F.lit("O"), F.col("custkey").cast("string")).alias("ask"))
    return callers.starts(asks, t.g_nodes, ~F.col("path").startswith("asia/"))


@query("g6_starts", START + "SELECT ask, s.id AS id, false AS other FROM st UNION ALL SELECT ask, hit.id, true FROM hit JOIN st USING (ask) WHERE hit.id <> s.id AND hit.name = s.name")
def start_nodes(t: Tables) -> DataFrame:
    start, also = asked(t)
    return start.withColumn("other", F.lit(False)).unionByName(also.withColumn("other", F.lit(True)))


FOUND = START + """, e AS MATERIALIZED (SELECT ask, s.id AS start, source AS id, relation, bool_and(confidence = 'inferred') AS inferred, min(line) FILTER (line > 0) AS line FROM st JOIN si ON target = s.id AND source <> target GROUP BY ALL),
n AS MATERIALIZED (SELECT e.*, c.path, c.span_from, c.span_to, t.name AS called, ln.line AS site FROM e JOIN sy c ON c.id = e.id JOIN sy t ON t.id = e.start LEFT JOIN ln ON ln.path = c.path AND ln.line_no = e.line),
w AS (SELECT n.ask, n.id, n.relation, arg_min(ln.line, ln.line_no) AS q, min(ln.line_no) AS l FROM n JOIN ln ON ln.path = n.path AND line_no BETWEEN span_from AND span_to AND regexp_matches(ln.line, '(^|[^A-Za-z0-9_])' || called || '([^A-Za-z0-9_]|$)') WHERE site IS NULL GROUP BY ALL)
"""


@query("g6_evidence", FOUND + "SELECT n.ask, n.id, n.relation, 1 AS depth, inferred, CASE WHEN coalesce(site, q) IS NOT NULL THEN path END AS quote_path, CAST(CASE WHEN site IS NOT NULL THEN n.line ELSE l END AS INT) AS line, trim(coalesce(site, q)) AS quote FROM n LEFT JOIN w USING (ask, id, relation) WHERE NOT starts_with(path, 'europe/')")
def callers_with_evidence(t: Tables) -> DataFrame:
    return callers.neighbours(asked(t)[0], t.g_nodes, t.g_sites, t.g_lines, keep=~F.col("path").startswith("europe/"))[0]


@query("g6_hidden", FOUND + "SELECT st.ask, count(n.ask) AS hidden FROM st LEFT JOIN n ON n.ask = st.ask AND starts_with(path, 'europe/') GROUP BY st.ask")
def hidden_callers(t: Tables) -> DataFrame:
    return callers.neighbours(asked(t)[0], t.g_nodes, t.g_sites, t.g_lines, keep=~F.col("path").startswith("europe/"))[1]


GROUPS = """
WITH hits AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY path, line_no) AS k FROM g_lines WHERE contains(line, 'o1')), sy AS MATERIALIZED (SELECT * FROM g_symbols),
en AS (SELECT h.path, h.line_no, h.line, arg_min(s.id, {'a': -s.span_from, 'b': -s.span_to, 'c': s.id}) AS symbol FROM hits h LEFT JOIN sy s ON s.path = h.path AND h.line_no BETWEEN s.span_from AND s.span_to WHERE k <= 500 GROUP BY ALL),
g AS (SELECT path, symbol, array_to_string(list(CAST(line_no AS VARCHAR) || ':' || line ORDER BY line_no), '|') AS hits FROM en GROUP BY ALL), d AS (SELECT target AS symbol, count(*) AS in_degree FROM g_edges WHERE relation <> 'contains' GROUP BY ALL)
"""


@query("t12_symbol_groups", GROUPS + "SELECT g.path, g.symbol, coalesce(in_degree, 0) AS in_degree, hits, CAST(row_number() OVER (ORDER BY coalesce(in_degree, 0) DESC, g.path, sy.name NULLS LAST, g.symbol) AS INT) AS place FROM g LEFT JOIN d USING (symbol) LEFT JOIN sy ON sy.id = g.symbol")
def symbol_groups(t: Tables) -> DataFrame:
    groups = callers.hit_groups(t.g_lines.filter(F.contains("line", F.lit("o1"))), t.g_nodes, t.g_edges, 500)[0]
    return groups.withColumn("hits", F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["line"], h["text"])), "|"))


@query("t7_inline", "SELECT s.id, coalesce(string_agg(coalesce(l.line, ''), chr(10) ORDER BY n.i) FILTER (n.i <= m.last), NULL) AS code FROM g_symbols s LEFT JOIN (SELECT path, max(line_no) AS last FROM g_lines GROUP BY path) m USING (path) CROSS JOIN LATERAL (SELECT unnest(range(s.span_from, s.span_to + 1)) AS i) n LEFT JOIN g_lines l ON l.path = s.path AND l.line_no = n.i GROUP BY s.id")
def inline_source(t: Tables) -> DataFrame:
    return callers.inline(t.g_symbols.select("id", "path", F.col("span_from").cast("long").alias("span_from"), F.col("span_to").cast("long").alias("span_to")), t.g_lines).select("id", "code")


@query("p9_languages", "SELECT path, CASE split_part(path, '.', -1) WHEN 'py' THEN 'python' WHEN 'JS' THEN 'javascript' WHEN 'md' THEN 'md' ELSE CASE WHEN contains(split_part(path, '/', -1), '.') THEN 'min' ELSE 'unknown' END END AS language FROM s_tree")
def languages(t: Tables) -> DataFrame:
    return t.s_tree.select("path", language(F.col("path")).alias("language"))


@query("p8b_test_paths", "SELECT path, false AS test FROM g_files UNION ALL SELECT path, true FROM (SELECT nation || '/tests/' || region AS path FROM g_files UNION ALL SELECT path || '.test.ts' FROM g_files UNION ALL SELECT replace(path, '.py', '_test.go') FROM g_files)")
def test_paths(t: Tables) -> DataFrame:
    f = t.g_files
    rows = f.select("path").unionByName(f.select(F.concat_ws("/tests/", "nation", "region").alias("path"))).unionByName(f.select(F.concat("path", F.lit(".test.ts")).alias("path"))).unionByName(f.select(F.replace("path", F.lit(".py"), F.lit("_test.go")).alias("path")))
    return rows.select("path", callers.testlike(F.col("path")).alias("test"))
