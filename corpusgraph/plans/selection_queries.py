"""Queries of the selection operators and of the page checks over whole bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import documents, selection
from .registry import Tables, query

REASON = "CASE WHEN ignored THEN 'ignored' WHEN link THEN 'link' WHEN regexp_matches(path, '(^|/)[.]') THEN 'dotfile' WHEN size > 4000 THEN 'oversize' ELSE 'kept' END"


@query("s4_corpus_scan", f"SELECT {REASON} AS reason, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM s_listing GROUP BY 1")
def corpus_scan(t: Tables) -> DataFrame:
    return selection.scan(t.s_listing, 4000).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.sum("size").alias("size"))


@query("s5_source_set", "SELECT partkey, path FROM s_tree WHERE (ends_with(lower(path), '.py') OR ends_with(lower(path), '.js')) AND NOT contains(path, '.min.') AND NOT contains(path, '/node_modules/')")
def source_set(t: Tables) -> DataFrame:
    return selection.source_set(t.s_tree, ["py", "js"], ["node_modules", "vendor"]).select("partkey", "path")


@query("p11_size_limit", "SELECT path FROM s_listing WHERE size <= 2000")
def size_limit(t: Tables) -> DataFrame:
    return t.s_listing.filter(selection.within_size(F.col("size"), 2000)).select("path")


@query("p3_folded_globs", "SELECT doc_id FROM t_docs WHERE regexp_full_match(lower(path), 'src[0-9]/en/[^/]*[.]md|(.*/)?[^/]*7[.]md')")
def folded(t: Tables) -> DataFrame:
    return t.t_docs.filter(selection.case_folded(F.upper("path"), ["Src?/EN/*.md", "*7.MD"])).select("doc_id")


@query("p4_readable", "SELECT doc_id FROM t_docs WHERE NOT regexp_full_match(lower(path), 'src[0-9]/de/[^/]*')")
def readable(t: Tables) -> DataFrame:
    return t.t_docs.filter(selection.readable(F.upper("path"), ["src?/de/*"])).select("doc_id")


@query("p5_visible", "SELECT doc_id, path FROM t_docs WHERE NOT EXISTS (SELECT 1 FROM a_areas WHERE local_only AND starts_with(path, scope || '/'))")
def visible(t: Tables) -> DataFrame:
    return selection.conceal(t.t_docs, selection.hidden_areas(t.a_areas, "cloud")).select("doc_id", "path")


@query(
    "p6_scopes",
    """WITH s AS (SELECT split_part(scope, '/', 2) AS ask, count(*) AS n, min(scope) AS one FROM a_scopes GROUP BY 1)
SELECT custkey, coalesce(f.scope, CASE WHEN n = 1 THEN one END) AS scope, CASE WHEN f.scope IS NOT NULL OR n = 1 THEN NULL WHEN n > 1 THEN 'ambiguous' ELSE 'unknown' END AS problem
FROM a_asks a LEFT JOIN a_scopes f ON f.scope = a.ask LEFT JOIN s ON s.ask = a.ask""",
)
def scopes(t: Tables) -> DataFrame:
    return selection.single_scope(t.a_asks, t.a_scopes).select("custkey", "scope", "problem")


@query("p13_withheld", "SELECT page, line FROM w_lines WHERE NOT EXISTS (SELECT 1 FROM a_areas WHERE local_only AND contains(line, '](' || scope || '/'))")
def withheld(t: Tables) -> DataFrame:
    return selection.withhold(t.w_lines, selection.hidden_areas(t.a_areas, "cloud")).select("page", "line")


@query("p16_web_resources", "SELECT page_id, regexp_matches(lower(trim('  ' || upper(url))), '^https?://') AS web FROM pages")
def web(t: Tables) -> DataFrame:
    return t.pages.select("page_id", selection.is_web_resource(F.concat(F.lit("  "), F.upper("url"))).alias("web"))


@query(
    "p17_sections",
    """WITH h AS (SELECT *, length(regexp_extract(line, '^#+')) AS level, trim(regexp_replace(line, '^#+', '')) AS title FROM m_lines),
s AS (SELECT page, min(line_no) AS st, arg_min(level, line_no) AS lv FROM h WHERE level > 0 AND title = 'user' GROUP BY page),
e AS (SELECT h.page, min(line_no) AS stop FROM h JOIN s ON s.page = h.page WHERE level > 0 AND line_no > st AND level <= lv GROUP BY h.page)
SELECT h.page, line_no, line FROM h JOIN s ON s.page = h.page LEFT JOIN e ON e.page = h.page WHERE line_no >= st AND (stop IS NULL OR line_no < stop)""",
)
def sections(t: Tables) -> DataFrame:
    return selection.section(t.m_lines, "user")


@query(
    "p19_stacks",
    """WITH p AS (SELECT area, bool_or(ends_with(path, '.py')) AS py, bool_or(ends_with(path, '.JS')) AS js, bool_or(ends_with(path, '.md')) AS md FROM s_tree GROUP BY area)
SELECT area, 'python' AS stack FROM p WHERE py UNION ALL SELECT area, 'web' FROM p WHERE js AND md""",
)
def stacks(t: Tables) -> DataFrame:
    signals = t.spark.createDataFrame([("python", ".py", None), ("web", ".js", ".md"), ("docs", "readme.md", None)], "stack string, sign string, companion string")
    return selection.detect_stacks(t.s_tree, signals)


@query("f2_code_refs", "SELECT id, path, CAST(span_from AS INT) AS line_from, CAST(CASE WHEN orderkey % 2 = 0 THEN span_to ELSE span_from END AS INT) AS line_to FROM g_symbols WHERE NOT contains(path, ' ')")
def refs(t: Tables) -> DataFrame:
    return selection.code_refs(t.r_lines, "line").select("id", "path", "line_from", "line_to")


@query(
    "g5_symbols",
    """WITH a AS (SELECT ask, regexp_replace(regexp_replace(ask, '^#', ''), '^[.]', '') AS c, contains(ask, '/') OR regexp_matches(ask, '[.](py|go)$') AS f FROM g_asks),
k AS (SELECT id, name, is_test, 'symbol' AS kd, lower(name) AS k FROM g_nodes WHERE kind <> 'file' UNION SELECT id, name, is_test, 'symbol', lower(id) FROM g_nodes WHERE kind <> 'file' UNION SELECT id, name, is_test, 'symbol', unnest([lower(regexp_replace(id, '^[^#.]*[.]', '')), lower(split_part(id, '#', 2))]) FROM g_nodes WHERE kind <> 'file'
UNION SELECT id, name, is_test, 'package', unnest([lower(split_part(path, '/', 2)), lower(split_part(path, '/', 1) || '/' || split_part(path, '/', 2))]) || chr(10) || lower(name) FROM g_nodes WHERE kind <> 'file' UNION SELECT id, name, is_test, 'name', lower(name) FROM g_nodes
UNION SELECT id, name, is_test, 'file', unnest([lower(path), lower(split_part(path, '/', 2) || '/' || split_part(path, '/', 3)), lower(split_part(path, '/', 3))]) FROM g_nodes WHERE kind = 'file'),
w AS (SELECT ask, c, 0 AS stage, 'symbol' AS kd, lower(c) AS k FROM a UNION ALL SELECT ask, c, 1, 'package', lower(regexp_extract(c, '^(.*)[.]([^.]*)$', 1) || chr(10) || regexp_extract(c, '^(.*)[.]([^.]*)$', 2)) FROM a WHERE contains(c, '.') UNION ALL SELECT ask, c, CASE WHEN f THEN 2 ELSE 4 END, 'file', lower(c) FROM a
UNION ALL SELECT ask, c, 3, 'name', lower(split_part(c, '.', -1)) FROM a WHERE contains(c, '.') AND NOT f),
h AS (SELECT DISTINCT ask, id, stage, CASE WHEN stage IN (2, 4) THEN 0 ELSE CASE WHEN name <> split_part(c, '.', -1) THEN 2 ELSE 0 END + CASE WHEN is_test THEN 1 ELSE 0 END END AS score FROM w JOIN k USING (kd, k))
SELECT ask, id, CAST(stage AS INT) AS stage, CAST(score AS INT) AS score FROM (SELECT *, min(stage) OVER (PARTITION BY ask) AS least FROM h) WHERE stage = least""",
)
def symbols(t: Tables) -> DataFrame:
    return selection.resolve_symbols(t.g_asks, t.g_nodes)


@query("w6_candidates", "SELECT id, CAST(2 + CASE WHEN is_test THEN 1 ELSE 0 END AS INT) AS score FROM g_nodes WHERE name = 'o7'")
def candidates(t: Tables) -> DataFrame:
    return selection.rank_candidates(t.g_nodes, "O7")


@query("w19_label_search", "SELECT id, path FROM g_nodes WHERE contains(name, 'o99') ORDER BY name <> 'o99', path, id LIMIT 20")
def labels(t: Tables) -> DataFrame:
    return selection.label_search(t.g_nodes, "O99")


NOW = "SELECT id, CASE WHEN orderkey % 50 = 0 THEN 'x' ELSE body_hash END AS body_hash FROM g_symbols WHERE orderkey % 77 <> 0"


@query(
    "g10_changed_callers",
    f"""WITH nw AS ({NOW}), ch AS (SELECT b.id, b.path FROM g_symbols b LEFT JOIN nw ON nw.id = b.id WHERE b.body_hash IS DISTINCT FROM nw.body_hash)
SELECT DISTINCT ch.id AS changed, c.source AS caller FROM ch JOIN g_calls c ON c.target = ch.id JOIN g_symbols s ON s.id = c.source WHERE s.path <> ch.path""",
)
def callers(t: Tables) -> DataFrame:
    after = t.g_symbols.filter("orderkey % 77 <> 0").select("id", F.when(F.col("orderkey") % 50 == 0, "x").otherwise(F.col("body_hash")).alias("body_hash"))
    return selection.changed_callers(t.g_symbols.select("id", "path", "body_hash"), after, t.g_edges)


@query(
    "w7_first_use",
    """SELECT path_from, path_to, symbol, CAST(line AS INT) AS line FROM (SELECT a.path AS path_from, b.path AS path_to, b.id AS symbol, line, row_number() OVER (PARTITION BY a.path, b.path ORDER BY line, relation = 'calls', b.id) AS k
FROM g_edges e JOIN g_nodes a ON a.id = e.source JOIN g_nodes b ON b.id = e.target) WHERE k = 1""",
)
def uses(t: Tables) -> DataFrame:
    a, b = t.g_nodes.select(F.col("id").alias("source"), F.col("path").alias("path_from")), t.g_nodes.select(F.col("id").alias("target"), F.col("path").alias("path_to"))
    return selection.first_use(t.g_edges.join(a, "source").join(b, "target").withColumn("symbol", F.col("target")))


DIRS = "SELECT nation AS dir, count(*) AS files, CAST(sum(custkey % 7) AS BIGINT) AS symbols FROM g_files GROUP BY nation"


@query("w4_directories", f"WITH b AS ({DIRS}) SELECT dir, files, symbols, (SELECT greatest(count(*) - 16, 0) FROM b) AS dropped FROM b ORDER BY files DESC, symbols DESC, dir LIMIT 16")
def directories(t: Tables) -> DataFrame:
    return selection.bounded_directories(t.g_files.groupBy(F.col("nation").alias("dir")).agg(F.count("*").alias("files"), F.sum(F.col("custkey") % 7).alias("symbols")))


@query(
    "j43_assembled_hits",
    """WITH v AS (SELECT DISTINCT lang AS collection FROM documents WHERE lang <> 'de'), h AS (SELECT lang AS collection, path, length(text) AS score FROM t_docs WHERE text IS NOT NULL),
d AS (SELECT count(*) AS dropped FROM h WHERE collection NOT IN (SELECT collection FROM v))
SELECT collection, path, score, CASE WHEN path NOT IN (SELECT path FROM snap_a) THEN 'not registered' END AS finding, dropped FROM h, d WHERE collection IN (SELECT collection FROM v) ORDER BY score DESC, path LIMIT 100""",
)
def assembled(t: Tables) -> DataFrame:
    areas = t.documents.select(F.col("lang").alias("collection"), (F.col("lang") != "de").alias("visible")).distinct()
    hits = t.t_docs.filter("text IS NOT NULL").select(F.col("lang").alias("collection"), "path", F.length("text").alias("score"))
    return selection.assemble_hits(hits, areas, t.snap_a, 100)


@query("j42_unfindable", "WITH m AS (SELECT path FROM snap_a WHERE path NOT IN (SELECT path FROM snap_b)) SELECT count(*) AS n, (SELECT string_agg(path, ',' ORDER BY path) FROM (SELECT path FROM m ORDER BY path LIMIT 3)) AS sample FROM m")
def unfindable(t: Tables) -> DataFrame:
    return selection.unfindable(t.snap_a, t.snap_b)


@query(
    "j52_wrong_direction",
    "SELECT a.path AS page, b.path AS cited FROM t_links l JOIN t_docs a ON a.doc_id = l.source JOIN t_docs b ON b.doc_id = l.target WHERE a.lang = 'en' AND b.lang <> 'en'",
)
def direction(t: Tables) -> DataFrame:
    a, b = t.t_docs.select(F.col("doc_id").alias("source"), F.col("path").alias("page")), t.t_docs.select(F.col("doc_id").alias("target"), F.col("path").alias("cited"))
    return selection.wrong_direction(t.t_links.join(a, "source").join(b, "target").select("page", "cited"), t.a_areas.select("scope", "shared"))


@query("c15_reserved_names", "SELECT path, 'reserved-name-as-concept' AS rule FROM k_pages WHERE type IS NOT NULL AND regexp_matches(path, '/(index|log)[.]md$')")
def reserved(t: Tables) -> DataFrame:
    return documents.reserved_names(t.k_pages).select("path", "rule")


@query("c17_log_dates", "SELECT path, 'log-date-form' AS rule FROM k_lines WHERE ends_with(path, '/log.md') AND starts_with(line, '## May')")
def log_dates(t: Tables) -> DataFrame:
    return documents.log_dates(t.k_lines).select("path", "rule")


@query("c23_no_index", "SELECT regexp_replace(path, '/[^/]*$', '') AS dir FROM k_pages GROUP BY 1 HAVING bool_or(NOT regexp_matches(path, '/(index|log)[.]md$')) AND NOT bool_or(ends_with(path, '/index.md'))")
def no_index(t: Tables) -> DataFrame:
    return documents.without_catalog(t.k_pages)


@query("c24_no_log", "SELECT DISTINCT scope FROM k_pages WHERE scope NOT IN (SELECT scope FROM k_pages WHERE path = scope || '/log.md')")
def no_log(t: Tables) -> DataFrame:
    return documents.without_log(t.k_pages)


@query(
    "c29_orphans",
    "SELECT path FROM k_pages WHERE NOT regexp_matches(path, '/(index|log)[.]md$') AND doc_id NOT IN (SELECT target FROM t_links JOIN k_pages ON doc_id = source WHERE NOT ends_with(path, '/log.md'))",
)
def orphans(t: Tables) -> DataFrame:
    to = t.k_pages.select(F.col("doc_id").alias("to"), F.col("path").alias("target"))
    links = t.t_links.withColumnRenamed("target", "to").join(t.k_pages.select(F.col("doc_id").alias("source"), "path"), "source").join(to, "to").select("path", "target")
    return documents.orphans(t.k_pages, links)
