"""Structured Streaming forms of the append-log queries.

Each takes a streaming (or static) DataFrame with an event time and returns one of the same kind; the caller
chooses sink, trigger and checkpoint. `run_available` processes what is there and ends.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quiet_periods(events: DataFrame, time: str, root: str, quiet: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """(root, start, end, n): bursts of events that ended with a quiet period."""
    return events.withWatermark(time, late).groupBy(root, F.session_window(time, quiet).alias("w")).agg(F.count("*").alias("n")).select(root, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key; state is kept for `late`."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windows(events: DataFrame, time: str, keys: list[str], length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(keys, start, n, total) of tumbling or sliding windows; rows later than the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(*keys, F.window(time, length, slide or length).alias("w")).agg(F.count("*").alias("n"), F.sum("cents").alias("total")).select(*keys, F.col("w.start").alias("start"), "n", "total")


def relevant(events: DataFrame, path: str) -> DataFrame:
    """Changes outside dot-directories."""
    return events.filter(~F.col(path).rlike(r"(^|/)\.[^/]+/"))


def tombstoned(events: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """Events whose keys are not in a static table of dropped ones (a stream-static anti join)."""
    marks = dropped.select(*keys).distinct().withColumn("dropped", F.lit(True))
    return events.join(marks, keys, "left").filter("dropped IS NULL").drop("dropped")


def latest_state(events: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """The newest state per key, for update or complete mode."""
    return events.groupBy(key).agg(F.max_by(state, order).alias(state), F.max(order).alias(order))


def run_available(df: DataFrame, folder: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a streaming query over all that is available and read its result; folder is shared by all executors."""
    spark = df.sparkSession
    place = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True)
    if each is not None:
        writer.foreachBatch(each).start().awaitTermination()
        return spark.createDataFrame([], df.schema)
    if mode == "append":
        writer.format("parquet").option("path", f"{place}/out").start().awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{place}/out")
    # Other modes: each batch replaces the table, written idempotently under its batch id.
    last: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/{number}")
        last.append(number)

    writer.foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{place}/out/{last[-1]}") if last else spark.createDataFrame([], df.schema)
