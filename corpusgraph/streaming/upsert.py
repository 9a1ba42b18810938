"""Incremental work in foreachBatch: a keyed table in the shared folder, written batch by batch, safe to replay.

Rows lie in Parquet under gen=<generation>/batch=<number>; of a key's rows the latest batch's counts. A batch is
written by overwriting its own partition, and is worked out from the batches before it alone, so a replayed batch
writes the same rows again. Compaction writes the rows that count, with their batch numbers, as a next generation and
then names it in the manifest; a run that dies before that leaves the old generation in force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class KeyedTable:
    """columns: a DDL schema; keys: those of its columns that tell rows apart."""

    def __init__(self, spark: SparkSession, folder: str, columns: str, keys: list[str]) -> None:
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys
        self.schema: StructType = spark.createDataFrame([], columns).schema
        spark.createDataFrame([(0,)], "gen int").write.mode("ignore").parquet(f"{self.folder}/manifest")
        self._write(spark.createDataFrame([], self.schema).withColumn("batch", F.lit(0).cast("long")), self._generation(), "ignore")

    def _generation(self) -> int:
        return self.spark.read.schema("gen int").parquet(f"{self.folder}/manifest").agg(F.max("gen")).first()[0]

    def _write(self, rows: DataFrame, generation: int, mode: str) -> None:
        rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.folder}/gen={generation}")

    def rows(self, before: int | None = None) -> DataFrame:
        """All rows, with their batch; `before`: of earlier batches only."""
        found = self.spark.read.schema(self.schema.add("batch", "long") if "batch" not in self.schema.names else self.schema).parquet(f"{self.folder}/gen={self._generation()}")
        return found if before is None else found.filter(F.col("batch") < before)

    def read(self, before: int | None = None) -> DataFrame:
        """The row of each key that counts."""
        rest = [c for c in self.schema.names if c not in (*self.keys, "batch")]
        latest = self.rows(before).groupBy(*self.keys).agg(F.max_by(F.struct(*rest) if rest else F.lit(1), "batch").alias("v"))
        return latest.select(*self.keys, *[F.col(f"v.{c}").alias(c) for c in rest])

    def put(self, rows: DataFrame, batch: int) -> None:
        self._write(rows.select(*[c for c in self.schema.names if c != "batch"]).withColumn("batch", F.lit(batch).cast("long")), self._generation(), "overwrite")

    def compact(self) -> None:
        now = self._generation()
        rest = [c for c in self.schema.names if c not in (*self.keys, "batch")]
        latest = self.rows().groupBy(*self.keys).agg(F.max_by(F.struct(*rest, "batch"), "batch").alias("v")).select(*self.keys, *[F.col(f"v.{c}").alias(c) for c in rest], F.col("v.batch").alias("batch"))
        self._write(latest, now + 1, "overwrite")
        self.spark.createDataFrame([(now + 1,)], "gen int").write.mode("append").parquet(f"{self.folder}/manifest")


def extract_new(table: KeyedTable, content: str, version: str, extract: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: contents that the table, keyed by (content_hash, version), has no row for are extracted, once each.

    content: the batch's text column. extract takes (content_hash, text) and returns the table's columns but `version`.
    """

    def each(batch: DataFrame, number: int) -> None:
        asked = batch.select(F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("content_hash"), F.coalesce(F.col(content), F.lit("")).alias("text")).dropDuplicates(["content_hash"])
        known = table.read(before=number).filter(F.col("version") == version).select("content_hash")
        table.put(extract(asked.join(known, "content_hash", "left_anti")).withColumn("version", F.lit(version)), number)

    return each


def scan_register(register: KeyedTable, text: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over listings (path, size, mtime, text): register rows of what is new or has other stats.

    register: (path, size, mtime, content_hash, state, revision), keyed by path. A file with the size and mtime of its row
    is clean, and its text isn't hashed; of the others state is new, changed or touched (other stats, same content),
    and a new content adds one to the revision.
    """

    def each(batch: DataFrame, number: int) -> None:
        old = register.read(before=number).select("path", *[F.col(c).alias(f"old_{c}") for c in ("size", "mtime", "content_hash", "revision")])
        both = batch.join(old, "path", "left")
        moved = both.filter(~(F.col("size").eqNullSafe(F.col("old_size")) & F.col("mtime").eqNullSafe(F.col("old_mtime"))) | F.col("old_content_hash").isNull())
        hashed = moved.withColumn("content_hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
        state = F.when(F.col("old_content_hash").isNull(), "new").when(F.col("old_content_hash") != F.col("content_hash"), "changed").otherwise("touched")
        revision = F.coalesce("old_revision", F.lit(0)) + F.when(state == "touched", 0).otherwise(1)
        register.put(hashed.select("path", "size", "mtime", "content_hash", state.alias("state"), revision.alias("revision")), number)

    return each
