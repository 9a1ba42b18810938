"""Queries over files that Spark writes from the driver's tables and reads again through the engine's sources, and over references."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import resolution
from ..sources import files
from ..checkpoint import shared_dir
from .registry import Tables, query


def folder(t: Tables) -> str:
    return f"{shared_dir(t.spark).rstrip('/')}/source-{uuid.uuid4().hex}"


@query("s11_lcov", "SELECT path, line, CAST(sum(hits) AS BIGINT) AS hits FROM c_cov GROUP BY ALL")
def lcov(t: Tables) -> DataFrame:
    place = folder(t)
    rows = t.c_cov.groupBy("path").agg(F.array_join(F.collect_list(F.concat(F.lit("DA:"), F.col("line").cast("string"), F.lit(","), F.col("hits").cast("string"))), "\n").alias("da"))
    rows.select(F.concat(F.lit("TN:\nSF:"), "path", F.lit("\n"), "da", F.lit("\nend_of_record"))).write.text(place)
    return files.read_lcov(t.spark, place).groupBy("path", "line").agg(F.sum("hits").cast("long").alias("hits"))


@query("s12_block_profile", "SELECT path, l AS line, max(hits) AS hits FROM (SELECT path, hits, unnest(range(line * 3, line * 3 + 5)) AS l FROM c_cov) GROUP BY ALL")
def blocks(t: Tables) -> DataFrame:
    place = folder(t)
    n = F.col("line") * 3
    t.c_cov.select(F.concat("path", F.lit(":"), n.cast("string"), F.lit(".2,"), (n + 4).cast("string"), F.lit(".9 3 "), F.col("hits").cast("string"))).write.text(place)
    return files.read_block_profile(t.spark, place).select("path", F.col("line").cast("long").alias("line"), F.col("hits").cast("long").alias("hits"))


@query("s8_register", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, path, content_hash, CAST(size % 9 + 1 AS INT) AS revision FROM snap_a")
def register(t: Tables) -> DataFrame:
    place = folder(t)
    files.write_register(t.snap_a.select(F.col("doc_id").cast("string").alias("doc_id"), "path", "content_hash", (F.col("size") % 9 + 1).cast("int").alias("revision")), place)
    return files.read_register(t.spark, place)


@query("s9_journal", "SELECT CAST(run AS VARCHAR) AS run, node, seq, input_hash, outcome, seconds FROM l_journal")
def journal(t: Tables) -> DataFrame:
    place = folder(t)
    files.append_journal(t.l_journal.withColumn("run", F.col("run").cast("string")), place)
    return files.read_journal(t.spark, place)


@query("s19_messages", "SELECT md5(text) AS message, count(*) AS n FROM conversations WHERE trim(text) <> '' GROUP BY 1")
def messages(t: Tables) -> DataFrame:
    place = folder(t)
    t.conversations.select("text").write.text(place, lineSep="\x00")
    return files.read_messages(t.spark, place).groupBy(F.md5("message").alias("message")).agg(F.count("*").alias("n"))


LADDER = """u AS (SELECT l_orderkey * 8 + l_linenumber AS raw_id, s.path, split_part(s.path, '/', 2) AS dir, d.name FROM lineitem JOIN g_symbols s ON s.orderkey = l_orderkey JOIN g_first ON partkey = l_partkey JOIN g_symbols d ON d.orderkey = g_first.orderkey),
a AS (SELECT path, name, min(id) AS t FROM g_symbols GROUP BY ALL HAVING count(*) = 1), b AS (SELECT split_part(path, '/', 2) AS dir, name, min(id) AS t FROM g_symbols GROUP BY ALL HAVING count(*) = 1), c AS (SELECT name, min(id) AS t FROM g_symbols GROUP BY ALL HAVING count(*) = 1)"""


@query(
    "j3_name_resolution",
    f"WITH {LADDER} SELECT raw_id, coalesce(a.t, b.t, c.t) AS target, CASE WHEN a.t IS NOT NULL THEN 'file' WHEN b.t IS NOT NULL THEN 'directory' ELSE 'repository' END AS step, a.t IS NULL AND b.t IS NULL AS inferred FROM u LEFT JOIN a USING (path, name) LEFT JOIN b USING (dir, name) LEFT JOIN c USING (name) WHERE coalesce(a.t, b.t, c.t) IS NOT NULL",
)
def names(t: Tables) -> DataFrame:
    s = t.g_symbols.withColumn("dir", F.split("path", "/")[1])
    raw = t.lineitem.join(s.select(F.col("orderkey").alias("l_orderkey"), "path", "dir"), "l_orderkey").join(t.g_first.toDF("l_partkey", "first"), "l_partkey").join(s.select(F.col("orderkey").alias("first"), "name"), "first")
    raw = raw.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("raw_id"), "path", "dir", "name")
    return resolution.resolve_references(raw, s, [("file", ["path", "name"], False), ("directory", ["dir", "name"], False), ("repository", ["name"], True)])


@query("j12_nearest_root", "SELECT path, CASE WHEN starts_with(path, 'asia/nation_1') AND split_part(path, '/', 2) = 'nation_1' THEN 'asia/nation_1' WHEN split_part(path, '/', 1) IN ('asia', 'africa') THEN split_part(path, '/', 1) END AS root FROM g_files")
def roots(t: Tables) -> DataFrame:
    return resolution.longest_prefix(t.g_files.select("path"), "path", t.spark.createDataFrame([("asia",), ("africa",), ("asia/nation_1",)], "root string"))


@query("j8_probed_imports", "SELECT custkey, coalesce(min(CASE WHEN k = 1 THEN p END), min(p)) AS path FROM (SELECT f.custkey, 1 AS k, g.path AS p FROM g_files f JOIN g_files g ON g.path = regexp_replace(f.path, '[^/]+$', '') || 'test_c' || CAST(f.custkey + 1 AS VARCHAR) || '.py' UNION ALL SELECT f.custkey, 2, g.path FROM g_files f JOIN g_files g ON g.path = regexp_replace(f.path, '[^/]+$', '') || 'c' || CAST(f.custkey + 2 AS VARCHAR) || '.py') GROUP BY custkey")
def probed(t: Tables) -> DataFrame:
    base = F.regexp_replace("from", "[^/]+$", "")
    name = lambda prefix, i: F.concat(base, F.lit(prefix), (F.col("custkey") + i).cast("string"), F.lit(".py"))
    imports = t.g_files.select("custkey", F.col("path").alias("from"))
    return resolution.probe(imports, t.g_files, [name("test_c", 1), name("c", 2)]).filter("path IS NOT NULL").select("custkey", "path")


@query(
    "j11_bridges",
    """WITH use_ AS (SELECT id AS source, kind AS namespace, name, path AS file, orderkey % 7 AS line FROM g_symbols WHERE orderkey % 3 = 0), offer AS (SELECT id AS target, kind AS namespace, name, path FROM g_symbols WHERE orderkey % 3 <> 0),
hit AS (SELECT source, target, namespace, name, line FROM use_ JOIN offer USING (namespace, name) WHERE split_part(file, '/', 2) = split_part(path, '/', 2) OR length(path) % 2 = 0),
one AS (SELECT source, namespace, name FROM hit GROUP BY ALL HAVING count(DISTINCT target) = 1)
SELECT source, target, min(line) AS line FROM hit JOIN one USING (source, namespace, name) WHERE (source, target) NOT IN (SELECT (source, target) FROM g_calls) GROUP BY source, target""",
)
def bridges(t: Tables) -> DataFrame:
    dir_ = F.split("path", "/")[1]
    uses = t.g_symbols.filter("orderkey % 3 = 0").select(F.col("id").alias("source"), F.col("kind").alias("namespace"), "name", dir_.alias("file"), (F.col("orderkey") % 7).alias("line"))
    offers = t.g_symbols.filter("orderkey % 3 <> 0").select(F.col("id").alias("target"), F.col("kind").alias("namespace"), "name", F.when(F.length("path") % 2 != 0, F.array(dir_)).alias("scope"))
    return resolution.bridge(uses, offers, t.g_calls)
