"""Queries of the graph, drift and impact operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import case_id, plain_name, span, under
from ..checkpoint import cut, shared_dir
from ..operators import drift, graph, impact, snapshots
from .registry import Tables, query

WALK = "(SELECT * FROM g_edges WHERE relation <> 'contains')"
PAIRS = f"p AS MATERIALIZED (SELECT source AS src, target AS dst FROM {WALK} WHERE source IN (SELECT id FROM g_nodes) AND target IN (SELECT id FROM g_nodes))"


@query("p1_subtree", "SELECT id, kind FROM g_nodes WHERE path = 'asia' OR starts_with(path, 'asia/')")
def subtree(t: Tables) -> DataFrame:
    return t.g_nodes.filter(under(F.col("path"), "asia")).select("id", "kind")


@query("p7_walk_edges", f"SELECT source, target, relation, line FROM {WALK}")
def walks(t: Tables) -> DataFrame:
    return graph.walk_edges(t.g_edges).select("source", "target", "relation", "line")


@query("a3_in_degree", f"SELECT target AS id, count(*) AS in_degree FROM {WALK} GROUP BY target")
def in_degree(t: Tables) -> DataFrame:
    return graph.in_degree(t.g_edges)


@query(
    "a4_graph_stats",
    """SELECT CASE WHEN kind = 'file' THEN 'files' ELSE 'symbols' END AS what, count(*) AS n FROM g_nodes GROUP BY 1
UNION ALL SELECT 'edges', count(*) FROM g_edges UNION ALL SELECT 'relation:' || relation, count(*) FROM g_edges GROUP BY 1 UNION ALL SELECT 'confidence:' || confidence, count(*) FROM g_edges GROUP BY 1""",
)
def stats(t: Tables) -> DataFrame:
    return graph.graph_stats(t.g_nodes, t.g_edges)


@query("j1_adjacency", f"WITH {PAIRS} SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM p UNION ALL SELECT dst, src FROM p) GROUP BY ALL")
def adjacency(t: Tables) -> DataFrame:
    return graph.resolved_both(t.g_nodes, t.g_edges).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("j2_loose_ends", f"SELECT target, count(*) AS n FROM {WALK} WHERE target NOT IN (SELECT id FROM g_nodes) GROUP BY target")
def loose(t: Tables) -> DataFrame:
    return graph.with_loose_ends(t.g_nodes, t.g_edges).filter("target_path IS NULL").groupBy("target").agg(F.count("*").alias("n"))


@query("a6_directories", "WITH t AS (SELECT split_part(path, '/', 1) AS top, count(*) AS n FROM g_files GROUP BY 1), d AS (SELECT max(n) > 0.6 * sum(n) AS deep FROM t) SELECT CASE WHEN deep THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2) ELSE split_part(path, '/', 1) END AS bucket, count(*) AS files FROM g_files, d GROUP BY 1")
def directories(t: Tables) -> DataFrame:
    return graph.directory_buckets(t.g_files.select("path")).groupBy("bucket").agg(F.count("*").alias("files"))


@query(
    "a7_rollup",
    """SELECT dir, count(*) AS members, sum(CASE WHEN kind = 'file' THEN 1 ELSE 0 END) AS files FROM (
SELECT '' AS dir, kind FROM g_nodes UNION ALL SELECT split_part(path, '/', 1), kind FROM g_nodes UNION ALL SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), kind FROM g_nodes) GROUP BY dir""",
)
def rollup(t: Tables) -> DataFrame:
    return graph.rollup(t.g_nodes, "path", F.count("*").alias("members"), F.sum((F.col("kind") == "file").cast("int")).alias("files"))


@query("a8_visible_edges", f"SELECT split_part(s.path, '/', 2) AS src, split_part(d.path, '/', 2) AS dst, relation, count(*) AS n FROM {WALK} e JOIN g_nodes s ON s.id = source JOIN g_nodes d ON d.id = target WHERE split_part(s.path, '/', 2) <> split_part(d.path, '/', 2) GROUP BY ALL")
def visible(t: Tables) -> DataFrame:
    return graph.visible_edges(t.g_edges, t.g_nodes.select("id", F.split("path", "/")[1].alias("dir")))


RANK = f"""WITH RECURSIVE {PAIRS},
adj AS MATERIALIZED (SELECT src, dst, count(*) / sum(count(*)) OVER (PARTITION BY src) AS share FROM (SELECT src, dst FROM p UNION ALL SELECT dst, src FROM p) GROUP BY src, dst),
base AS MATERIALIZED (SELECT id, w / sum(w) OVER () AS r FROM ({{seeds}})),
{{steps}}
SELECT id, round(mass / (SELECT max(mass) FROM r25), 6) AS score FROM r25 WHERE mass > 0 AND round(mass / (SELECT max(mass) FROM r25), 6) > 0"""


def rank_sql(seeds: str) -> str:
    steps = ["r0 AS MATERIALIZED (SELECT id, r AS mass FROM base)"]
    for i in range(25):
        steps.append(
            f"r{i + 1} AS MATERIALIZED (SELECT id, sum(got) AS mass FROM (SELECT dst AS id, mass * share * 0.75 AS got FROM r{i} JOIN adj ON src = id UNION ALL "
            f"SELECT id, r * (0.25 + 0.75 * (SELECT coalesce(sum(mass), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM adj))) FROM base) GROUP BY id)"
        )
    return RANK.format(seeds=seeds, steps=",\n".join(steps))


def ranked(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.round("score", 6).alias("score")).filter("score > 0")


@query("g1_seeded_rank", rank_sql("SELECT id, CASE WHEN kind = 'class' THEN 2.0 ELSE 1.0 END AS w FROM g_nodes WHERE name = 'o7' OR name = 'o11'"))
def seeded(t: Tables) -> DataFrame:
    seeds = t.g_nodes.filter("name IN ('o7', 'o11')").select("id", F.when(F.col("kind") == "class", 2.0).otherwise(1.0).alias("weight"))
    return ranked(graph.pagerank(t.g_nodes, t.g_edges, seeds))


@query("g2_pagerank", rank_sql("SELECT id, 1.0 AS w FROM g_nodes"))
def uniform(t: Tables) -> DataFrame:
    return ranked(graph.pagerank(t.g_nodes, t.g_edges, t.g_nodes.select("id", F.lit(1.0).alias("weight"))))


REACH = """WITH RECURSIVE s AS MATERIALIZED (SELECT target AS at, source AS nxt, min(CASE WHEN confidence = 'inferred' THEN 1 ELSE 0 END) AS guess FROM g_edges WHERE relation <> 'contains' GROUP BY ALL),
{seeds},
d AS (SELECT origin, id, 0 AS depth FROM seed UNION SELECT d.origin, s.nxt, d.depth + 1 FROM d JOIN s ON s.at = d.id WHERE d.depth < {depth}),
m AS MATERIALIZED (SELECT origin, id, min(depth) AS depth FROM d GROUP BY ALL),
{layers}
SELECT origin, id, depth, guess = 1 AS inferred FROM ({union}) WHERE depth > 0"""


def reach_sql(seeds: str, depth: int) -> str:
    layers = ["l0 AS MATERIALIZED (SELECT origin, id, 0 AS depth, 0 AS guess FROM m WHERE depth = 0)"]
    for i in range(depth):
        layers.append(
            f"l{i + 1} AS MATERIALIZED (SELECT m.origin, m.id, m.depth, min(greatest(l.guess, s.guess)) AS guess FROM l{i} l JOIN s ON s.at = l.id JOIN m ON m.origin = l.origin AND m.id = s.nxt AND m.depth = {i + 1} GROUP BY ALL)"
        )
    return REACH.format(seeds=seeds, depth=depth, layers=",\n".join(layers), union=" UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(depth + 1)))


@query("g3_reach", reach_sql("seed AS MATERIALIZED (SELECT DISTINCT name AS origin, id FROM g_nodes WHERE name IN ('o3', 'o4', 'o5'))", 3))
def reach(t: Tables) -> DataFrame:
    return graph.reach(t.g_edges, t.g_nodes.filter("name IN ('o3', 'o4', 'o5')").select(F.col("name").alias("origin"), "id"), True, 3)


@query("g4_edge_walk", f"SELECT source, target, relation, confidence, line FROM {WALK} WHERE target IN (SELECT id FROM g_nodes WHERE name = 'o3')")
def edge_walk(t: Tables) -> DataFrame:
    at = t.g_nodes.filter("name = 'o3'").select(F.col("id").alias("target"))
    return graph.walk_edges(t.g_edges).join(at, "target", "left_semi").select("source", "target", "relation", "confidence", "line")


@query("g6_callers", f"SELECT b.name AS name, count(DISTINCT e.source) AS callers, count(DISTINCT CASE WHEN NOT a.is_test THEN e.source END) AS plain_callers, min(e.line) AS first_line FROM {WALK} e JOIN g_nodes a ON a.id = e.source JOIN g_nodes b ON b.id = e.target GROUP BY b.name")
def callers(t: Tables) -> DataFrame:
    a, b = t.g_nodes.select(F.col("id").alias("source"), "is_test"), t.g_nodes.select(F.col("id").alias("target"), "name")
    rows = graph.walk_edges(t.g_edges).join(a, "source").join(b, "target")
    return rows.groupBy("name").agg(F.count_distinct("source").alias("callers"), F.count_distinct(F.when(~F.col("is_test"), F.col("source"))).alias("plain_callers"), F.min("line").alias("first_line"))


@query(
    "g11_neighbours",
    """SELECT id, direction, string_agg(CAST(other AS VARCHAR), ',' ORDER BY other) AS others FROM (SELECT DISTINCT source AS id, 'out' AS direction, target AS other FROM t_links UNION SELECT DISTINCT target, 'in', source FROM t_links) GROUP BY ALL""",
)
def neighbours(t: Tables) -> DataFrame:
    return graph.neighbours(t.t_links)


@query("g12_orphans", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT target FROM t_links WHERE source <> target)")
def orphans(t: Tables) -> DataFrame:
    return graph.orphans(t.documents.select(F.col("doc_id").alias("id")), t.t_links)


@query(
    "g13_cycles",
    """WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT source, target FROM t_links),
r AS (SELECT source AS a, target AS b FROM e UNION SELECT r.a, e.target FROM r JOIN e ON e.source = r.b)
SELECT x.a AS id, min(x.b) AS cycle FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a""",
)
def cycles(t: Tables) -> DataFrame:
    return graph.cycles(t.t_links)


@query("j48_same_name", "SELECT name, count(*) AS n FROM g_nodes GROUP BY name HAVING count(*) > 1")
def same_name(t: Tables) -> DataFrame:
    return graph.same_name(t.g_nodes)


@query("j49_first_site", f"SELECT source, target, relation, min(CASE WHEN line > 0 THEN line END) AS line FROM {WALK} GROUP BY ALL")
def first_site(t: Tables) -> DataFrame:
    return graph.first_site(t.g_edges)


@query("w2_hotspots", f"SELECT target AS id, count(*) AS in_degree FROM {WALK} GROUP BY target ORDER BY in_degree DESC, id LIMIT 12")
def hotspots(t: Tables) -> DataFrame:
    return graph.in_degree(t.g_edges).orderBy(F.desc("in_degree"), "id").limit(12)


@query("w3_hubs", f"SELECT dir, id, in_degree FROM (SELECT split_part(n.path, '/', 2) AS dir, id, in_degree, row_number() OVER (PARTITION BY split_part(n.path, '/', 2) ORDER BY in_degree DESC, id) AS k FROM g_nodes n JOIN (SELECT target, count(*) AS in_degree FROM {WALK} GROUP BY target) ON target = id) WHERE k <= 3")
def hubs(t: Tables) -> DataFrame:
    rows = t.g_nodes.select("id", F.split("path", "/")[1].alias("dir")).join(graph.in_degree(t.g_edges), "id")
    w = Window.partitionBy("dir").orderBy(F.desc("in_degree"), "id")
    return rows.withColumn("k", F.row_number().over(w)).filter("k <= 3").select("dir", "id", "in_degree")


@query("w5_ordinals", "SELECT orderkey, name || CASE WHEN k > 1 THEN '~' || CAST(k AS VARCHAR) ELSE '' END AS minted FROM (SELECT orderkey, name, row_number() OVER (PARTITION BY path, name ORDER BY orderkey) AS k FROM g_symbols)")
def ordinals(t: Tables) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("path", "name").orderBy("orderkey"))
    return t.g_symbols.select("orderkey", "name", k.alias("k")).select("orderkey", F.concat("name", F.when(F.col("k") > 1, F.concat(F.lit("~"), F.col("k").cast("string"))).otherwise("")).alias("minted"))


MINTED = "SELECT orderkey, path, name || CASE WHEN k > 1 THEN '~' || CAST(k AS VARCHAR) ELSE '' END AS minted FROM (SELECT orderkey, path, name, row_number() OVER (PARTITION BY path, name ORDER BY orderkey) AS k FROM g_symbols)"


@query("f13_plain_names", f"SELECT orderkey, regexp_replace(minted, '~[0-9]+', '', 'g') AS name, contains(minted, '~') AS had_ordinal FROM ({MINTED})")
def plain_names(t: Tables) -> DataFrame:
    rows = ordinals(t)
    return rows.select("orderkey", plain_name(F.col("minted")).alias("name"), F.contains("minted", F.lit("~")).alias("had_ordinal"))


SPELLED = "CASE WHEN orderkey % 7 = 0 THEN 'L' || CAST(span_from AS VARCHAR) ELSE 'L' || CAST(span_from AS VARCHAR) || '-L' || CAST(span_to AS VARCHAR) END"


@query("p14_spans", f"SELECT id, TRY_CAST(regexp_extract({SPELLED}, '^L([0-9]+)-L([0-9]+)$', 1) AS INT) AS line_from, TRY_CAST(regexp_extract({SPELLED}, '^L([0-9]+)-L([0-9]+)$', 2) AS INT) AS line_to FROM g_symbols")
def spans(t: Tables) -> DataFrame:
    start, end = F.concat(F.lit("L"), F.col("span_from").cast("string")), F.concat(F.lit("-L"), F.col("span_to").cast("string"))
    rows = t.g_symbols.select("id", F.concat(start, F.when(F.col("orderkey") % 7 == 0, "").otherwise(end)).alias("spelled"))
    low, high = span(F.col("spelled"))
    return rows.select("id", low.alias("line_from"), high.alias("line_to"))


@query("f9_case_ids", "SELECT o_orderkey, o_orderpriority || '-' || strftime(o_orderdate, '%Y-%m-%d') || '-' || left(sha256('orders/' || o_orderpriority || chr(10) || CAST(o_custkey AS VARCHAR)), 4) AS case_id FROM orders")
def case_ids(t: Tables) -> DataFrame:
    area = F.concat(F.lit("orders/"), "o_orderpriority")
    return t.orders.select("o_orderkey", case_id(area, F.col("o_custkey").cast("string"), F.col("o_orderdate")).alias("case_id"))


@query("w16_skeleton", "SELECT path, row_number() OVER (PARTITION BY path ORDER BY span_from NULLS LAST, name, id) AS place, id FROM g_nodes WHERE kind <> 'file'")
def skeleton(t: Tables) -> DataFrame:
    return impact.skeleton(t.g_nodes)


#: A graph with every kind of defect: nodes and edges of the whole graph, some of them broken.
BROKEN = """bn AS (SELECT CASE WHEN orderkey % 97 = 0 THEN '' ELSE id END AS id, CASE WHEN orderkey % 89 = 0 THEN NULL ELSE path END AS path, CASE WHEN orderkey % 83 = 0 THEN '' ELSE kind END AS kind, CASE WHEN orderkey % 79 = 0 THEN NULL ELSE body_hash END AS body_hash FROM g_symbols UNION ALL SELECT id, path, kind, body_hash FROM g_symbols WHERE orderkey % 50 = 7
UNION ALL SELECT path, path, 'file', 'h' FROM g_files WHERE custkey % 6 <> 1), be AS (SELECT CASE WHEN line = 5 AND confidence = 'inferred' THEN NULL ELSE source END AS source, CASE WHEN line = 4 AND confidence = 'inferred' THEN '' ELSE target END AS target, CASE WHEN line = 3 AND confidence = 'inferred' THEN 'odd' ELSE relation END AS relation FROM g_edges)"""


def broken_graph(t: Tables) -> tuple[DataFrame, DataFrame]:
    views = {v: getattr(t, v) for v in ("g_symbols", "g_files", "g_edges")}
    part = lambda name: t.spark.sql(f"WITH {BROKEN} SELECT * FROM {name}".replace("FROM g_symbols", "FROM {g_symbols}").replace("FROM g_files", "FROM {g_files}").replace("FROM g_edges", "FROM {g_edges}"), **views)
    return cut(part("bn"), "nodes"), cut(part("be"), "edges")  # each is read several times


@query(
    "s3_validation",
    f"""WITH {BROKEN}, p AS (SELECT CASE WHEN id = '' THEN 'node without id' WHEN path IS NULL THEN 'node without path' WHEN kind = '' THEN 'node without kind' WHEN body_hash IS NULL THEN 'node without hash' END AS problem, id FROM bn),
q AS (SELECT CASE WHEN source IS NULL THEN 'edge without source' WHEN target = '' THEN 'edge without target' WHEN relation = 'odd' THEN 'unknown relation' END AS problem, source, target, relation FROM be)
SELECT 'unknown version' AS problem, NULL AS id, 1 AS n UNION ALL SELECT 'no stamp', NULL, 1 UNION ALL SELECT problem, id, count(*) FROM p WHERE problem IS NOT NULL GROUP BY ALL UNION ALL SELECT 'id twice', id, count(*) FROM bn WHERE id <> '' GROUP BY id HAVING count(*) > 1
UNION ALL SELECT problem, CASE problem WHEN 'unknown relation' THEN relation WHEN 'edge without target' THEN source ELSE target END, count(*) FROM q WHERE problem IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'source is no node', source, count(*) FROM be WHERE source IS NOT NULL AND source NOT IN (SELECT id FROM bn) GROUP BY source""",
)
def validation(t: Tables) -> DataFrame:
    nodes, edges = broken_graph(t)
    meta = t.spark.range(1).select(F.lit(2).alias("version"), F.lit(" ").alias("extractor"))
    return snapshots.validate(nodes, edges, meta, 3)


@query("s1_snapshot", "SELECT kind, count(*) AS n, count(DISTINCT path) AS paths, (SELECT count(*) FROM g_edges) AS edges FROM g_nodes GROUP BY kind")
def snapshot(t: Tables) -> DataFrame:
    folder = f"{shared_dir(t.spark).rstrip('/')}/graph-{uuid.uuid4().hex}"
    snapshots.write(t.g_nodes, t.g_edges, t.spark.range(1).select(F.lit(3).alias("version"), F.lit("x").alias("extractor")), folder)
    nodes, edges, _ = snapshots.read(t.spark, folder)
    return nodes.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("path").alias("paths")).crossJoin(F.broadcast(edges.agg(F.count("*").alias("edges"))))


# Drift.

DRIFT = "SELECT path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS state FROM snap_a a FULL JOIN snap_b b USING (path) WHERE a.content_hash IS DISTINCT FROM b.content_hash"


@query("j15_content_drift", DRIFT)
def content_drift(t: Tables) -> DataFrame:
    return drift.content_drift(t.snap_a, t.snap_b)


@query("j16_file_drift", DRIFT)
def stat_drift(t: Tables) -> DataFrame:
    return drift.stat_drift(t.snap_a, t.snap_b)


@query("j17_ref_drift", "SELECT ref, CASE WHEN a.sha IS NULL THEN 'new' WHEN b.sha IS NULL THEN 'gone' ELSE 'moved' END AS change FROM (SELECT path AS ref, content_hash AS sha FROM snap_a) a FULL JOIN (SELECT path AS ref, content_hash AS sha FROM snap_b) b USING (ref) WHERE a.sha IS DISTINCT FROM b.sha AND NOT starts_with(ref, 'moved/')")
def ref_drift(t: Tables) -> DataFrame:
    skip = t.snap_b.filter(F.col("path").startswith("moved/")).select(F.col("path").alias("ref"))
    return drift.refs_drift(t.snap_a.select(F.col("path").alias("ref"), F.col("content_hash").alias("sha")), t.snap_b.select(F.col("path").alias("ref"), F.col("content_hash").alias("sha")), skip)


RENAMES = """gone AS (SELECT content_hash, min(path) AS old_path FROM snap_a WHERE path NOT IN (SELECT path FROM snap_b) GROUP BY 1 HAVING count(*) = 1),
come AS (SELECT content_hash, min(path) AS new_path FROM snap_b WHERE path NOT IN (SELECT path FROM snap_a) GROUP BY 1 HAVING count(*) = 1),
ren AS (SELECT old_path, new_path FROM gone JOIN come USING (content_hash))"""


@query("j18_renames", f"WITH {RENAMES} SELECT * FROM ren")
def renames(t: Tables) -> DataFrame:
    return drift.renames(t.snap_a, t.snap_b)


@query(
    "j19_carry_forward",
    f"""WITH {RENAMES}, was AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(new_path, path) AS path, content_hash AS was FROM snap_a LEFT JOIN ren ON old_path = path)
SELECT coalesce(w.doc_id, substr(sha256(b.path || '|' || b.content_hash), 1, 16)) AS doc_id, b.path, b.content_hash, CASE WHEN w.doc_id IS NULL OR w.was = b.content_hash THEN 1 ELSE 2 END AS revision FROM snap_b b LEFT JOIN was w USING (path)""",
)
def carry(t: Tables) -> DataFrame:
    return drift.carry_forward(t.snap_a.select(F.col("doc_id").cast("string").alias("doc_id"), "path", "content_hash", F.lit(1).alias("revision")), t.snap_b.select("path", "content_hash"))


@query(
    "j20_pin_drift",
    """WITH pins AS (SELECT t_links.source AS page, d.path, CASE WHEN doc_id % 17 = 0 THEN -doc_id ELSE doc_id END AS doc_id, md5(text) AS content_hash FROM t_links JOIN t_docs d ON doc_id = target)
SELECT page, path, CASE WHEN r.doc_id IS NULL THEN 'row-missing' WHEN f.path IS NULL THEN 'source-missing' WHEN r.doc_id <> p.doc_id THEN 'doc-id' WHEN r.content_hash <> p.content_hash THEN 'pin-stale' END AS finding
FROM pins p LEFT JOIN snap_b r USING (path) LEFT JOIN snap_a f USING (path)
WHERE r.doc_id IS NULL OR f.path IS NULL OR r.doc_id <> p.doc_id OR r.content_hash <> p.content_hash""",
)
def pins(t: Tables) -> DataFrame:
    pins = t.t_links.join(t.t_docs.select(F.col("doc_id").alias("target"), "path", "text"), "target").select(F.col("source").alias("page"), "path", F.when(F.col("target") % 17 == 0, -F.col("target")).otherwise(F.col("target")).alias("doc_id"), F.md5("text").alias("content_hash"))
    return drift.pin_drift(pins, t.snap_b, t.snap_a)


@query("a11_shared_content", "SELECT content_hash, count(*) AS copies, min(path) AS first_path FROM snap_a GROUP BY content_hash HAVING count(*) > 1")
def shared(t: Tables) -> DataFrame:
    return drift.shared_content(t.snap_a)


@query(
    "a27_digest",
    """WITH f AS (SELECT left(md5(path), 4) AS k, count(*) AS n, sha256(string_agg(path || chr(31) || content_hash, chr(10) ORDER BY path || chr(31) || content_hash)) AS d FROM snap_a GROUP BY 1), c AS (SELECT left(k, 2) AS k, sum(n) AS n, sha256(string_agg(k || d, chr(10) ORDER BY k || d)) AS d FROM f GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS files, sha256(string_agg(k || d, chr(10) ORDER BY k || d)) AS digest FROM c""",
)
def digest(t: Tables) -> DataFrame:
    return drift.digest(t.snap_a)


@query("j23_tombstones", "SELECT user_id, event_type, min(event_id) AS event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.user_id = e.user_id AND d.event_type = e.event_type AND d.value < 0.5) GROUP BY ALL")
def tombstones(t: Tables) -> DataFrame:
    dropped = t.events.filter("value < 0.5").select("user_id", "event_type").distinct()
    return drift.tombstoned(t.events, dropped, ["user_id", "event_type"], "event_id")


@query("u8_overlay", f"WITH moved AS MATERIALIZED ({DRIFT}) SELECT path, content_hash FROM snap_a WHERE path NOT IN (SELECT path FROM moved) UNION ALL SELECT path, content_hash FROM snap_b WHERE path IN (SELECT path FROM moved)")
def overlay(t: Tables) -> DataFrame:
    moved = drift.content_drift(t.snap_a, t.snap_b).select("path")
    return drift.overlay(t.snap_a.select("path", "content_hash"), moved, t.snap_b.join(moved, "path", "left_semi").select("path", "content_hash"), "path", 10_000_000)


# Impact.


@query("j13_enclosing", "SELECT path, line_from AS line, hunk, arg_min(id, struct_pack(a := -span_from, b := -span_to, c := id)) AS id FROM d_hunks LEFT JOIN (SELECT path, id, span_from, span_to FROM g_symbols) s USING (path) WHERE line_from BETWEEN span_from AND span_to GROUP BY ALL")
def enclosing(t: Tables) -> DataFrame:
    points = t.d_hunks.select("path", F.col("line_from").alias("line"), "hunk").distinct()
    spans = t.g_symbols.select("path", "id", "span_from", "span_to")
    return impact.enclosing(points, spans).filter("id IS NOT NULL")


INNER = """rg AS (SELECT DISTINCT path, line_from, line_to FROM d_hunks),
hit AS MATERIALIZED (SELECT path, line_from, line_to, id, span_from, span_to FROM rg JOIN (SELECT path, id, span_from, span_to FROM g_symbols) s USING (path) WHERE span_from <= line_to AND line_from <= span_to),
inner_ AS MATERIALIZED (SELECT path, line_from, line_to, id FROM hit h WHERE NOT EXISTS (SELECT 1 FROM hit o WHERE o.path = h.path AND o.line_from = h.line_from AND o.line_to = h.line_to AND o.id <> h.id AND o.span_from >= h.span_from AND o.span_to <= h.span_to))"""


@query("j14_innermost", f"WITH {INNER} SELECT * FROM inner_")
def innermost(t: Tables) -> DataFrame:
    return impact.innermost(t.d_hunks.select("path", "line_from", "line_to").distinct(), t.g_nodes)


SEEDS = f"""{INNER}, seed AS MATERIALIZED (SELECT DISTINCT path AS origin, id FROM inner_ UNION SELECT path, path FROM d_hunks WHERE path NOT IN (SELECT path FROM inner_))"""


@query("g7_blast_radius", reach_sql(SEEDS, 2).replace("SELECT origin, id, depth, guess = 1 AS inferred FROM (", "SELECT id, min(depth) AS depth, count(DISTINCT origin) AS froms, min(guess) AS inferred FROM (") + " GROUP BY id")
def blast(t: Tables) -> DataFrame:
    return impact.radius(t.d_hunks, t.g_nodes, t.g_edges, 2)


SIGNAL = """WITH RECURSIVE s AS MATERIALIZED (SELECT DISTINCT target AS at, source AS nxt FROM g_edges WHERE relation <> 'contains'), f AS MATERIALIZED (SELECT DISTINCT path FROM d_hunks),
d AS (SELECT n.path AS origin, n.id FROM g_nodes n WHERE n.path IN (SELECT path FROM f) UNION SELECT d.origin, s.nxt FROM d JOIN s ON s.at = d.id),
own AS MATERIALIZED (SELECT path AS origin, id FROM g_nodes),
t AS MATERIALIZED (SELECT d.origin, bool_or(n.path IN (SELECT path FROM f)) AS changed FROM d JOIN g_nodes n ON n.id = d.id WHERE n.is_test AND n.path <> d.origin GROUP BY d.origin),
sig AS MATERIALIZED (SELECT f.path, CASE WHEN (SELECT bool_or(is_test) FROM g_nodes n WHERE n.path = f.path) THEN 'na' WHEN t.changed IS NULL THEN 'none' WHEN t.changed THEN 'changed' ELSE 'stale' END AS signal FROM f LEFT JOIN t ON t.origin = f.path)"""


@query("g8_test_signal", SIGNAL + " SELECT * FROM sig")
def signal(t: Tables) -> DataFrame:
    return impact.test_signal(t.d_hunks, t.g_nodes, t.g_edges)


@query("g9_audit", SIGNAL + f", {INNER} SELECT DISTINCT i.path, signal, i.id, in_degree FROM inner_ i JOIN sig ON sig.path = i.path JOIN (SELECT target, count(*) AS in_degree FROM g_edges WHERE relation <> 'contains' GROUP BY 1) ON target = i.id WHERE signal IN ('none', 'stale') AND in_degree >= 1")
def audit(t: Tables) -> DataFrame:
    return impact.audit(t.d_hunks, t.g_nodes, t.g_edges, 1)
