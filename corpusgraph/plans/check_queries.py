"""Queries of the report checks: coverage, layers, timings, quality, versions, messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import version
from ..operators import documents, reports
from .registry import Tables, query

COV = "cov AS MATERIALIZED (SELECT path, line, CAST(sum(hits) AS BIGINT) AS hits FROM c_cov GROUP BY ALL)"
#: Lines 1 of parts with an even number are exempt, every third without a reason; files of three brands are exempt.
EXEMPT = "ex AS MATERIALIZED (SELECT DISTINCT path, line, CASE WHEN length(path) % 3 = 0 THEN NULL ELSE 'generated' END AS reason FROM cov WHERE line = 1)"


@query("a12_merged_coverage", f"WITH {COV} SELECT * FROM cov")
def merged(t: Tables) -> DataFrame:
    return reports.merge_coverage(t.c_cov)


def exempt(cov: DataFrame) -> DataFrame:
    lines = cov.filter("line = 1").select("path", "line", F.when(F.length("path") % 3 != 0, "generated").alias("reason"))
    files = cov.filter(F.col("path").startswith("src/Brand#1")).select("path", F.lit(None).cast("int").alias("line"), F.lit("vendored").alias("reason")).distinct()
    return lines.unionByName(files)


@query(
    "j27_coverage_gate",
    f"""WITH {COV}, {EXEMPT} SELECT path, line, CASE WHEN starts_with(path, 'src/Brand#1') AND hits > 0 THEN 'file exempt but hit' WHEN starts_with(path, 'src/Brand#1') THEN NULL
WHEN ex.path IS NOT NULL AND reason IS NULL THEN 'exempt without reason' WHEN ex.path IS NOT NULL AND hits > 0 THEN 'exempt but hit' WHEN ex.path IS NULL AND hits = 0 THEN 'not covered' END AS finding
FROM cov LEFT JOIN ex USING (path, line) WHERE finding IS NOT NULL""",
)
def gate(t: Tables) -> DataFrame:
    cov = merged(t)
    return reports.coverage_gate(cov, exempt(cov))


@query("j28_absent", f"WITH {COV} SELECT 'src/' || p_brand || '/p' || CAST(p_partkey AS VARCHAR) || '.py' AS path FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def absent(t: Tables) -> DataFrame:
    tree = t.part.select(F.concat(F.lit("src/"), "p_brand", F.lit("/p"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"))
    return reports.absent(tree, t.c_cov.filter("hits >= 24"))


@query(
    "j26_report_paths",
    """WITH tree AS MATERIALIZED (SELECT 'src/' || p_brand || '/p' || CAST(p_partkey % 700 AS VARCHAR) || '.py' AS path FROM part), rep AS MATERIALIZED (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN p_brand || '/' ELSE '' END || 'p' || CAST(p_partkey AS VARCHAR) || '.py' AS path FROM part),
m AS (SELECT rep.path, count(DISTINCT tree.path) AS n, max(tree.path) AS file FROM rep LEFT JOIN tree ON ends_with(tree.path, '/' || rep.path) GROUP BY rep.path)
SELECT path, CASE WHEN n = 1 THEN file END AS file, CASE n WHEN 0 THEN 'missing' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome FROM m""",
)
def report_paths(t: Tables) -> DataFrame:
    number = lambda c: c.cast("string")
    tree = t.part.select(F.concat(F.lit("src/"), "p_brand", F.lit("/p"), number(F.col("p_partkey") % 700), F.lit(".py")).alias("path")).distinct()
    rep = t.part.select(F.concat(F.when(F.col("p_partkey") % 3 == 0, F.concat("p_brand", F.lit("/"))).otherwise(""), F.lit("p"), number(F.col("p_partkey")), F.lit(".py")).alias("path"))
    return reports.resolve_suffix(rep, tree)


@query("j29_newer_files", "SELECT path FROM (SELECT path, o_custkey AS m FROM g_symbols JOIN orders ON o_orderkey = orderkey) GROUP BY path HAVING max(m) > (SELECT max(l_suppkey) FROM lineitem) + 2")
def newer(t: Tables) -> DataFrame:
    files = t.g_symbols.join(t.orders.select(F.col("o_orderkey").alias("orderkey"), "o_custkey"), "orderkey").groupBy("path").agg(F.max("o_custkey").alias("mtime"))
    return reports.newer_than_report(files, t.lineitem.select(F.col("l_suppkey").alias("mtime")))


LAYERS = [("core", "asia/**"), ("core", "europe/**"), ("edge", "africa/**"), ("shared", "america/nation_1/*"), ("app", "america/**"), ("tests", "test_*.py")]
LAYER = "ly AS MATERIALIZED (SELECT path, CASE WHEN starts_with(path, 'asia/') OR starts_with(path, 'europe/') THEN 'core' WHEN starts_with(path, 'africa/') THEN 'edge' WHEN regexp_full_match(path, 'america/nation_1/[^/]*') THEN 'shared' WHEN starts_with(path, 'america/') THEN 'app' WHEN regexp_full_match(path, '(.*/)?test_[^/]*[.]py') THEN 'tests' END AS layer FROM g_files)"


@query("j30_layers", f"WITH {LAYER} SELECT path, layer, false AS tie FROM ly")
def layers(t: Tables) -> DataFrame:
    return reports.assign_layers(t.g_files.select("path"), LAYERS)


@query("j31_layer_violations", f"WITH {LAYER} SELECT DISTINCT a.layer AS from_layer, b.layer AS to_layer, a.path AS source, b.path AS target FROM g_calls c JOIN g_symbols x ON x.id = c.source JOIN g_symbols y ON y.id = c.target JOIN ly a ON a.path = x.path JOIN ly b ON b.path = y.path WHERE a.layer IS NOT NULL AND b.layer IS NOT NULL AND a.layer <> b.layer AND NOT (a.layer IN ('edge', 'app') AND b.layer = 'core')")
def violations(t: Tables) -> DataFrame:
    s = t.g_symbols
    edges = t.g_calls.join(s.select(F.col("id").alias("source"), F.col("path").alias("sp")), "source").join(s.select(F.col("id").alias("target"), F.col("path").alias("tp")), "target").select(F.col("sp").alias("source"), F.col("tp").alias("target")).distinct()
    return reports.layer_violations(edges, layers(t), {"core": [], "edge": ["core"], "app": ["core"], "shared": [], "tests": []})


@query("j32_unlayered", f"WITH {LAYER} SELECT path FROM ly WHERE layer IS NULL")
def unlayered(t: Tables) -> DataFrame:
    return layers(t).filter("layer IS NULL").select("path")


@query("j33_missing_tests", "SELECT path FROM g_files WHERE NOT is_test AND regexp_replace(path, '([^/]+)$', 'test_\\1') NOT IN (SELECT path FROM g_files)")
def missing(t: Tables) -> DataFrame:
    return reports.missing_tests(t.g_files.select("path"))


@query("j35_watches", "SELECT 'asia' AS watch, count(*) AS paths FROM g_files WHERE starts_with(path, 'asia/') AND NOT regexp_matches(path, '(^|/)test_[^/]*$') UNION ALL SELECT 'tests', count(*) FROM g_files WHERE regexp_matches(path, '(^|/)test_[^/]*$')")
def watches(t: Tables) -> DataFrame:
    return reports.watch_hits(t.g_files.select("path"), [("asia", ["asia/**"], ["test_*"]), ("tests", ["test_*"], []), ("none", ["nowhere/**"], [])])


SUMMARY = "SELECT name, series, max(CASE WHEN k = 1 THEN ms END) AS cold, count(CASE WHEN k > 1 THEN 1 END) AS n, round(median(CASE WHEN k > 1 THEN ms END), 6) AS median, min(CASE WHEN k > 1 THEN ms END) AS least, max(CASE WHEN k > 1 THEN ms END) AS most, round(avg(CASE WHEN k > 1 THEN ms END), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY name, series ORDER BY seq) AS k FROM b_timings) GROUP BY ALL"


@query("a14_timings", SUMMARY)
def timings(t: Tables) -> DataFrame:
    return reports.timing_summary(t.b_timings, ["name", "series"], "ms", "seq")


@query("j47_compared_timings", f"WITH m AS MATERIALIZED ({SUMMARY}), a AS (SELECT name || CAST(series AS VARCHAR) AS name, mean FROM m WHERE series % 3 <> 0), b AS (SELECT name || CAST(series AS VARCHAR) AS name, least AS mean FROM m WHERE series % 5 <> 0) SELECT name, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'dropped' ELSE 'compared' END AS state, CASE WHEN a.mean > 0 AND b.mean > 0 THEN round(a.mean / b.mean, 6) ELSE 0 END AS factor FROM a FULL JOIN b USING (name)")
def compared(t: Tables) -> DataFrame:
    rows = timings(t).withColumn("name", F.concat("name", F.col("series").cast("string")))
    return reports.compare_timings(rows.filter("series % 3 <> 0"), rows.filter("series % 5 <> 0").withColumn("mean", F.col("least")))


RANKS = "SELECT q_hits.item_id, expected, coalesce(k, 0) AS rank FROM q_hits LEFT JOIN (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY n_chars, doc_id) AS k FROM (SELECT b.item_id, d.doc_id, d.n_chars FROM benchmark b JOIN documents d ON contains(d.text, b.text))) r ON r.item_id = q_hits.item_id AND doc_id = expected"


@query("j46_expected_rank", RANKS)
def expected_rank(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text", "n_chars")
    hits = documents.containing(t.benchmark.select("item_id", F.col("text").alias("quote")), docs).join(docs.select("doc_id", "n_chars"), "doc_id")
    # What a question's row holds is its expected document and the least ones before it, so no question is sorted whole.
    expected = hits.groupBy("item_id").agg(F.min("doc_id").alias("expected"), F.min_by("n_chars", "doc_id").alias("size"))
    ahead = hits.join(F.broadcast(expected), "item_id").filter("n_chars < size OR (n_chars = size AND doc_id <= expected)")
    return ahead.groupBy("item_id", "expected").agg(F.count("*").cast("int").alias("rank"))


@query("a18_search_quality", f"WITH e AS ({RANKS}), r AS (SELECT CAST(b.item_id % 4 AS VARCHAR) AS kind, coalesce(e.rank, 0) AS rank FROM benchmark b LEFT JOIN e ON e.item_id = b.item_id) SELECT kind, count(*) AS questions, count(*) FILTER (rank BETWEEN 1 AND 3) AS hits FROM (SELECT kind, rank FROM r UNION ALL SELECT 'all', rank FROM r) GROUP BY kind")
def quality(t: Tables) -> DataFrame:
    ranked = t.benchmark.select("item_id").join(expected_rank(t).select("item_id", "rank"), "item_id", "left")
    return reports.search_quality(ranked.select((F.col("item_id") % 4).cast("string").alias("kind"), F.coalesce("rank", F.lit(0)).alias("rank")))


@query("a24_next_versions", "SELECT p_brand AS repo, CAST(v[1] AS VARCHAR) || '.' || CAST(v[2] AS VARCHAR) || '.' || CAST(v[3] + 1 AS VARCHAR) AS next FROM (SELECT p_brand, max([p_size % 7, p_partkey % 13, p_partkey % 29]) AS v FROM part GROUP BY p_brand)")
def versions(t: Tables) -> DataFrame:
    tag = F.concat(F.lit("v"), (F.col("p_size") % 7).cast("string"), F.lit("."), (F.col("p_partkey") % 13).cast("string"), F.lit("."), (F.col("p_partkey") % 29).cast("string"), F.lit("-rc1"))
    return reports.next_version(t.part.select(F.col("p_brand").alias("repo"), version(tag).alias("version")), "repo")


GERMAN = "der die das und nicht ist mit ein eine von zu den im auf für".split()
HITS = "SELECT conv_id, turn, list_max(list_transform(string_split(regexp_replace(regexp_replace(text, '`[^`]*`', ' ', 'g'), '\"[^\"\\n]*\"', ' ', 'g'), chr(10)), lambda l: len(list_filter(string_split_regex(lower(l), '[^a-zäöüß]+'), lambda w: w IN ('der','die','das','und','nicht','ist','mit','ein','eine','von','zu','den','im','auf','für'))))) AS hits FROM m_msgs"


@query("t18_language_scan", f"SELECT conv_id, turn, hits FROM ({HITS}) WHERE hits >= 2")
def language(t: Tables) -> DataFrame:
    return reports.language_hits(t.m_msgs, "text", GERMAN).filter("hits >= 2").select("conv_id", "turn", "hits")


@query("a22_calibration", f"SELECT threshold, count(*) FILTER (hits >= threshold) AS refused FROM ({HITS}), (SELECT unnest(range(1, 6)) AS threshold) GROUP BY threshold")
def calibration(t: Tables) -> DataFrame:
    return reports.calibrate(reports.language_hits(t.m_msgs, "text", GERMAN), 5)


@query("a23_levels", "SELECT level, count(*) AS n FROM (SELECT CASE l_linenumber % 5 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 0 END AS level FROM lineitem) GROUP BY level")
def levels(t: Tables) -> DataFrame:
    n = F.col("l_linenumber") % 5
    subject = F.when(n == 0, "feat(api)!: drop it").when(n == 1, "feat: add").when(n == 2, "fix(x): mend").when(n == 3, "docs: say").otherwise("Merge branch")
    return t.lineitem.select(reports.conventional_level(subject).alias("level")).groupBy("level").agg(F.count("*").alias("n"))


CHUNKS = """
WITH RECURSIVE l AS MATERIALIZED (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), p AS MATERIALIZED (SELECT doc_id, i AS n, l[i] AS p FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l)),
s AS (SELECT doc_id, n, p AS open, CAST(NULL AS VARCHAR) AS done FROM p WHERE n = 1 UNION ALL SELECT p.doc_id, p.n, CASE WHEN length(s.open) > 1200 OR s.open = '' THEN p.p ELSE s.open || chr(10) || p.p END, CASE WHEN length(s.open) > 1200 THEN s.open END FROM s JOIN p ON p.doc_id = s.doc_id AND p.n = s.n + 1),
c AS (SELECT doc_id, n, done AS text FROM s WHERE done IS NOT NULL UNION ALL SELECT s.doc_id, s.n + 1, open FROM s JOIN l USING (doc_id) WHERE s.n = len(l) AND open <> '')
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INT) AS chunk, CAST(length(text) AS INT) AS size, md5(text) AS digest FROM c"""


@query("w20_chunks", CHUNKS)
def chunked(t: Tables) -> DataFrame:
    return reports.chunks(t.documents, "doc_id", "text").select("doc_id", "chunk", F.length("text").alias("size"), F.md5("text").alias("digest"))


TAGS = "SELECT p_brand AS repo, 'v' || CAST(p_size % 7 AS VARCHAR) || '.' || CAST(p_partkey % 13 AS VARCHAR) || '.' || CASE WHEN p_partkey % 5 = 0 THEN '0' ELSE '' END || CAST(p_partkey % 29 AS VARCHAR) || CASE WHEN p_partkey % 3 = 0 THEN '-beta.' || CAST(p_partkey % 17 AS VARCHAR) WHEN p_partkey % 7 = 0 THEN '-rc1' ELSE '' END AS tag FROM part UNION ALL SELECT p_brand, 'v6.13.0-beta.' || CAST(p_partkey % 40 AS VARCHAR) FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'empty', 'v01.2.3'"


def tags(t: Tables) -> DataFrame:
    k, text = F.col("p_partkey"), lambda c: c.cast("string")
    end = F.when(k % 3 == 0, F.concat(F.lit("-beta."), text(k % 17))).when(k % 7 == 0, "-rc1").otherwise("")
    one = t.part.select(F.col("p_brand").alias("repo"), F.concat(F.lit("v"), text(F.col("p_size") % 7), F.lit("."), text(k % 13), F.lit("."), F.when(k % 5 == 0, "0").otherwise(""), text(k % 29), end).alias("tag"))
    two = t.part.filter(k % 2 == 0).select(F.col("p_brand").alias("repo"), F.concat(F.lit("v6.13.0-beta."), text(k % 40)).alias("tag"))
    return one.unionByName(two).unionByName(t.spark.range(1).select(F.lit("empty").alias("repo"), F.lit("v01.2.3").alias("tag")))


@query("a24_next_releases", "WITH t AS (" + TAGS + r"""), n AS (SELECT repo, max(CASE WHEN regexp_full_match(tag, 'v(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)') THEN CAST(string_split(substr(tag, 2), '.') AS INT[]) END) AS v FROM t GROUP BY repo), m AS (SELECT repo, CASE WHEN v IS NULL THEN '1.0.0' ELSE CAST(v[1] AS VARCHAR) || '.' || CAST(v[2] + 1 AS VARCHAR) || '.0' END AS next FROM n)
SELECT repo, next, next || '-beta.' || CAST(coalesce((SELECT max(CAST(split_part(tag, '-beta.', 2) AS INT)) FROM t WHERE t.repo = m.repo AND starts_with(tag, 'v' || next || '-beta.') AND NOT contains(tag, 'beta.0')), 0) + 1 AS VARCHAR) AS beta FROM m""")
def next_releases(t: Tables) -> DataFrame:
    return reports.next_releases(tags(t), "minor")


@query("a18_quality_report", "WITH o AS (SELECT doc_id AS id, lang AS kind, doc_id % 5 AS rank, n_chars / 10.0 AS ms FROM documents), b AS (SELECT * FROM o UNION ALL SELECT id, 'all', rank, ms FROM o) SELECT kind, count(*) AS questions, count(*) FILTER (rank BETWEEN 1 AND 3) AS hits, median(ms) FILTER (rank BETWEEN 1 AND 3) AS hit_ms, median(ms) FILTER (rank NOT BETWEEN 1 AND 3) AS miss_ms FROM b GROUP BY kind")
def quality_report(t: Tables) -> DataFrame:
    return reports.quality_report(t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), (F.col("doc_id") % 5).alias("rank"), (F.col("n_chars") / 10.0).alias("ms")))[0]


@query("a18_misses", "SELECT doc_id AS id, lang AS kind, CASE WHEN doc_id % 5 = 4 THEN 'rank 4' ELSE 'not found' END AS found FROM documents WHERE doc_id % 5 IN (0, 4)")
def misses(t: Tables) -> DataFrame:
    return reports.quality_report(t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), (F.col("doc_id") % 5).alias("rank"), (F.col("n_chars") / 10.0).alias("ms")))[1]
