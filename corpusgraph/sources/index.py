"""Persisted search index: term and trigram postings in buckets, with a manifest of what they describe, and a delta.

Postings lie in Parquet partitioned by a bucket of their key and sorted by it within, so that a question reads the
folders of its own terms or grams and, in those, the row groups that hold them. A search first compares the manifest
with the present documents: few moved ones are searched beside the index (their old postings are masked), many have
the index written anew.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoint import shared_dir
from ..functions.text import tokens
from ..operators import search

BUCKETS = 64
#: Pieces of a bucket, by document, so that a frequent key's rows are not one task's.
PIECES = 8
PARTS = ("terms", "grams")
#: Fixed value: most moved documents for which the old index still serves.
OVERLAY = 200
POSTINGS = "id long, field string, term string, tf long, bucket int"
GRAMS = "id long, gram string, bucket int"
MANIFEST = "id long, content_hash string, binary boolean, len long"


def bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def bucket_numbers(spark: SparkSession, keys: list[str]) -> list[int]:
    """The buckets of a question's keys, asked of Spark so that there is one hash."""
    if not keys:
        return []
    return sorted({r["b"] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(bucket(F.col("k")).alias("b")).collect()})


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    folder: str
    parts: tuple[str, ...] = PARTS

    def manifest(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest")

    def _part(self, kind: str, schema: str, column: str, keys: list[str]) -> DataFrame:
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{kind}")
        return rows.filter(F.col("bucket").isin(bucket_numbers(self.spark, keys)) & F.col(column).isin(keys)).drop("bucket")

    def postings(self, terms: list[str]) -> DataFrame:
        """(id, field, term, tf) of these terms."""
        return self._part("terms", POSTINGS, "term", terms)

    def gram_rows(self, grams: list[str]) -> DataFrame:
        """(id, gram) of these grams."""
        return self._part("grams", GRAMS, "gram", grams)


def describe(docs: DataFrame, text: str) -> DataFrame:
    """The manifest's rows of documents(id, text)."""
    return docs.select("id", F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("content_hash"), F.coalesce(F.contains(text, F.lit("\x00")), F.lit(False)).alias("binary"), F.size(tokens(F.coalesce(F.col(text), F.lit("")))).cast("long").alias("len"))


def _bucketed(rows: DataFrame, key: str, path: str) -> None:
    rows = rows.withColumn("bucket", bucket(F.col(key)))
    # By hash and not by range: for a range the rows would be made twice, once to find its bounds.
    rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(PIECES))).sortWithinPartitions("bucket", key, "id").write.mode("overwrite").partitionBy("bucket").parquet(path)


def write(docs: DataFrame, text: str, fields: dict[str, str], folder: str | None = None, parts: tuple[str, ...] = PARTS) -> Index:
    """Write the index of documents(id, ...) to a new folder: terms of each field, trigrams of the text unless it is binary.

    parts: those to write, for a use that asks no others; a question to a part that is missing fails. The manifest is written last, so that a folder without one is no index.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    if "terms" in parts:
        _bucketed(search.postings(docs, fields).select("id", "field", "term", "tf"), "term", f"{folder}/terms")
    if "grams" in parts:
        plain = docs.filter(~F.coalesce(F.contains(text, F.lit("\x00")), F.lit(False))).select("id", F.col(text).alias("text"))
        _bucketed(search.gram_index(plain).select("id", "gram"), "gram", f"{folder}/grams")
    describe(docs, text).write.mode("overwrite").parquet(f"{folder}/manifest")
    return Index(spark, folder, parts)


def moved(index: Index, docs: DataFrame, text: str) -> DataFrame:
    """(id, state) of documents that the index doesn't describe as they are: added, removed, changed."""
    now = docs.select("id", F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("now"))
    both = index.manifest().select("id", F.col("content_hash").alias("was")).join(now, "id", "full_outer")
    return both.filter("NOT was <=> now").select("id", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("state"))


def decision(moves: DataFrame, limit: int = OVERLAY) -> DataFrame:
    """One row: changed, added, removed and action: clean, overlay (at most `limit` moved) or rebuild."""
    number = lambda s: F.count_if(F.col("state") == s).alias(s)
    counts = moves.agg(number("changed"), number("added"), number("removed"), F.count("*").alias("n"))
    return counts.select("changed", "added", "removed", F.when(F.col("n") == 0, "clean").when(F.col("n") <= limit, "overlay").otherwise("rebuild").alias("action"))


def refresh(index: Index, docs: DataFrame, text: str, fields: dict[str, str], limit: int = OVERLAY) -> tuple[Index, DataFrame, str]:
    """(index to ask, moved documents, action): after a rebuild, nothing is moved."""
    moves = moved(index, docs, text)
    action = decision(moves, limit).first()["action"]
    if action == "rebuild":
        return write(docs, text, fields, parts=index.parts), moves.limit(0), action
    return index, moves, action


def candidates(index: Index, docs: DataFrame, text: str, alternatives: list[list[str]], moves: DataFrame | None = None) -> DataFrame:
    """(id) that may hold all literals of one alternative: by the index, but for moved documents, which are looked at themselves."""
    wanted = sorted({g for literals in alternatives for t in literals for g in search._grams(t)})
    here = docs.select("id", F.col(text).alias("text"))
    rows = index.gram_rows(wanted).select("gram", "id")
    if moves is not None:
        rows = rows.join(moves.select("id"), "id", "left_anti").select("gram", "id").unionByName(search.postings_of(here.join(moves.select("id"), "id", "left_semi"), alternatives))
    return search.candidates(rows, here, alternatives)


def grep(index: Index, docs: DataFrame, pattern: str, alternatives: list[list[str]], moves: DataFrame | None = None) -> DataFrame:
    """(id, line_no, line) of matching lines of the present documents(id, text)."""
    return search.grep(docs, pattern, candidates(index, docs, "text", alternatives, moves))


def lexical(index: Index, query: str, name_fields: dict[str, float]) -> DataFrame:
    """(id, lexical): the fielded score of `search.lexical` from postings and manifest alone; name_fields: weights of fields but the body."""
    spark = index.spark
    qtf = {r["term"]: r["n"] for r in spark.range(1).select(F.explode(tokens(F.lit(query))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}  # the question's words
    post = index.postings(sorted(qtf))
    weight = F.coalesce(*[F.when(F.col("field") == f, F.lit(w)) for f, w in name_fields.items()], F.lit(0.0))
    per = post.groupBy("id", "term").agg(F.sum(weight * F.col("tf")).alias("named"), F.sum(F.when(F.col("field") == "body", F.col("tf")).otherwise(0)).alias("body"))
    df = per.groupBy("term").agg(F.count("*").alias("df"))  # one row a word of the question
    stats = index.manifest().agg(F.count("*").alias("docs"), F.avg("len").alias("avg_len"))
    rows = per.join(F.broadcast(df.crossJoin(F.broadcast(stats))), "term").join(index.manifest().select("id", "len"), "id")
    times = F.coalesce(*[F.when(F.col("term") == t, F.lit(n)) for t, n in qtf.items()], F.lit(0))
    idf = F.log(1 + F.col("docs") / (1 + F.col("df")))
    ratio = F.when(F.col("avg_len") > 0, F.col("len") / F.col("avg_len")).otherwise(1.0)
    norm = search.K1 * (1 - search.B + search.B * ratio)
    score = idf * times * F.col("named") + F.when(F.col("body") > 0, idf * F.col("body") * (search.K1 + 1) / (F.col("body") + norm)).otherwise(0.0)
    return rows.groupBy("id").agg(F.sum(score).alias("lexical")).filter("lexical > 0")
