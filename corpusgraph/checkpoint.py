"""The shared folder, and cutting lineage for iterative operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a broadcast block, about.
BLOCK = 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; in tests, where it is unset, a local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Spark's switch to remove the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder; the shuffle files of the job that writes it go with its end."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = df.sparkSession.conf.get(CLEANUP, None)
    df.sparkSession.conf.set(CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)
    finally:
        if before is None:
            df.sparkSession.conf.unset(CLEANUP)
        else:
            df.sparkSession.conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_blocks(rows: DataFrame, key: str, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """fn over blocks of about BLOCK rows, one after the other; rows of one key share a block."""
    n, out = -(-rows.count() // BLOCK), None
    if n <= 1:
        return fn(rows)
    for i in range(n):
        part = cut(fn(rows.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i)), "block")
        out = part if out is None else out.unionByName(part)
    return out


#: At most this many keys can each hold a HOT_SHARE-th part of all rows, so they may be broadcast.
HOT_SHARE = 1000


def join_hot(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Inner join of rows to one row per key, where some keys may hold a large part of all rows.

    Keys with at least 1/HOT_SHARE of the rows are counted first (partial counts meet in the shuffle, not rows); their
    groups, HOT_SHARE at most, are broadcast, all others meet in a shuffled join in which no key is large.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    least = (rows.count() // HOT_SHARE) + 1
    hot = cut(counts.filter(F.col("n") >= least).select(key), "hot")
    of_hot = rows.join(F.broadcast(groups.join(F.broadcast(hot), key, "left_semi")), key)
    of_cold = rows.join(F.broadcast(hot), key, "left_anti").join(groups.join(F.broadcast(hot), key, "left_anti"), key)
    return of_hot.unionByName(of_cold)
