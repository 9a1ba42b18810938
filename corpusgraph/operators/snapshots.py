"""Graph snapshots: reading, writing, and everything that is wrong with one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "id string, name string, path string, kind string, span_from long, span_to long, exported boolean, is_test boolean, body_hash string"
EDGES = "source string, target string, relation string, confidence string, line int"
META = "version int, extractor string"
#: The relations that a graph may have.
RELATIONS = ["calls", "references", "imports", "extends", "implements", "contains"]


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, meta) of a graph in one JSON document; a document is one task's, so large graphs are kept as `write` leaves them."""
    rows = spark.read.schema(f"meta struct<{_fields(META)}>, nodes array<struct<{_fields(NODES)}>>, edges array<struct<{_fields(EDGES)}>>").json(path, multiLine=True, mode="FAILFAST")
    part = lambda c: rows.select(F.explode(c).alias("x")).select("x.*")
    return part("nodes"), part("edges"), rows.select("meta.*")


def _fields(columns: str) -> str:
    return ", ".join(c.replace(" ", ": ", 1) for c in columns.split(", "))


def write(nodes: DataFrame, edges: DataFrame, meta: DataFrame, folder: str) -> None:
    """Sorted Parquet tables; the manifest comes last, so that a folder without one, or with other counts, is no snapshot."""
    nodes.select(*[c.split()[0] for c in NODES.split(", ")]).repartitionByRange("path", "id").sortWithinPartitions("path", "id").write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.select(*[c.split()[0] for c in EDGES.split(", ")]).repartitionByRange("source", "target").sortWithinPartitions("source", "target", "relation", "line").write.mode("overwrite").parquet(f"{folder}/edges")
    spark = nodes.sparkSession
    counts = [spark.read.parquet(f"{folder}/{x}").count() for x in ("nodes", "edges")]
    meta.select("version", "extractor", F.lit(counts[0]).cast("long").alias("nodes"), F.lit(counts[1]).cast("long").alias("edges")).write.mode("overwrite").parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, meta) of a written snapshot."""
    manifest = spark.read.schema(f"{META}, nodes long, edges long").parquet(f"{folder}/manifest")
    nodes, edges = spark.read.schema(NODES).parquet(f"{folder}/nodes"), spark.read.schema(EDGES).parquet(f"{folder}/edges")
    said = manifest.first()
    if said is None or (said["nodes"], said["edges"]) != (nodes.count(), edges.count()):
        raise ValueError(f"{folder} holds no whole snapshot")
    return nodes, edges, manifest.select("version", "extractor")


def validate(nodes: DataFrame, edges: DataFrame, meta: DataFrame, version: int, relations: list[str] = RELATIONS) -> DataFrame:
    """(problem, id, n) of all that no reader could work around: an unknown version, a missing stamp, nodes without id, path, kind or hash, ids that are given twice, edges without ends, with an unknown relation, or from what is no node.

    Edges to what is no node are no defect: an unresolved import names its module.
    """
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    problem = lambda text: F.lit(text).alias("problem")
    none = F.lit(None).cast("string").alias("id")
    of_meta = meta.select(F.explode(F.array_compact(F.array(F.when(~F.col("version").eqNullSafe(F.lit(version)), "unknown version"), F.when(empty("extractor"), "no stamp")))).alias("problem"), none, F.lit(1).cast("long").alias("n"))
    lacks = F.coalesce(*[F.when(empty(c), F.lit(f"node without {what}")) for c, what in (("id", "id"), ("path", "path"), ("kind", "kind"), ("body_hash", "hash"))])
    of_nodes = nodes.select(lacks.alias("problem"), "id").filter("problem IS NOT NULL").groupBy("problem", "id").agg(F.count("*").alias("n"))
    twice = nodes.filter(~empty("id")).groupBy(problem("id twice"), "id").agg(F.count("*").alias("n")).filter("n > 1")
    odd = F.coalesce(F.when(empty("source"), "edge without source"), F.when(empty("target"), "edge without target"), F.when(~F.coalesce(F.col("relation").isin(relations), F.lit(False)), "unknown relation"))
    of_edges = edges.select(odd.alias("problem"), F.when(odd == "unknown relation", F.col("relation")).when(odd == "edge without target", F.col("source")).otherwise(F.col("target")).alias("id")).filter("problem IS NOT NULL").groupBy("problem", "id").agg(F.count("*").alias("n"))
    # A node is the source of many edges: they are counted before they meet the nodes.
    sources = edges.filter(~empty("source")).groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"))
    loose = sources.join(nodes.select("id"), "id", "left_anti").select(problem("source is no node"), "id", "n")
    return of_meta.unionByName(of_nodes).unionByName(twice).unionByName(of_edges).unionByName(loose)
