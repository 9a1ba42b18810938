"""Byte-balanced sharding by Karmarkar-Karp differencing; equal texts stay together.

A partial partition is a tuple of byte sums, one per shard. The two with the largest spread are combined
again and again, one in falling and one in rising order, until one is left.

Groups of at least 1/(shards * HOT_SHARE) of all bytes, of which there are shards * HOT_SHARE at most, are
differenced first, by themselves. All other groups are dealt by hash to buckets of about BUCKET groups that
are differenced in parallel; each bucket starts from its share of the large groups' uneven sums, so that the
small groups fill what the large ones left open. Sums then differ by a few bytes per bucket, unless one group
alone is larger than a shard.

Size is the UTF-8 length of the text plus 8; null has no bytes and belongs with empty texts. Rows that repeat
are placed each for itself, in one shard. Columns other than id and text are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, join_groups, materialise

BUCKET = 20_000
#: About so many rows of a shard are numbered by one task.
SLICE = 4096


def difference(sizes: Iterable[int], shards: int, start: Iterable[int] | None = None) -> list[int]:
    """The shard of each size. start: sums that the shards have already, in order."""
    heap = []
    for i, s in enumerate(sizes):
        heap.append((-s, i, [(s, ("item", i)), *((0, None),) * (shards - 1)]))
    count = len(heap)
    given = list(start) if start is not None else [0] * shards
    low = min(given)
    parts = sorted(((s - low, ("shard", i)) for i, s in enumerate(given)), key=lambda p: -p[0])
    heap.append((-parts[0][0], count, parts))
    heapq.heapify(heap)
    serial = count + 1
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        joined = [(x + y, p if q is None else q if p is None else (p, q)) for (x, p), (y, q) in zip(a, reversed(b), strict=True)]
        joined.sort(key=lambda p: -p[0])
        low = joined[-1][0]
        if low:
            joined = [(x - low, p) for x, p in joined]
        heapq.heappush(heap, (-joined[0][0], serial, joined))
        serial += 1
    out = [0] * count
    for _, tree in heap[0][2]:
        items, shard, todo = [], None, [tree]
        while todo:
            p = todo.pop()
            if p[0] == "item":
                items.append(p[1])
            elif p[0] == "shard":
                shard = p[1]
            else:
                todo += p
        for i in items:
            out[i] = shard
    return out


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot (0, 1, ... in each shard)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = materialise(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("sha")), "sizes"
    )
    groups = materialise(base.groupBy("sha").agg(F.sum("size").alias("bytes"), F.count("*").alias("copies")), "groups")
    rows, total, number = groups.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    is_large = F.col("bytes") * (shards * HOT_SHARE) >= total

    large = groups.filter(is_large).select("sha", "bytes", "copies").orderBy(F.desc("bytes"), "sha").collect()  # shards * HOT_SHARE at most
    placed = difference([r["bytes"] for r in large], shards)
    sums = np.zeros(shards, np.int64)
    np.add.at(sums, placed, [r["bytes"] for r in large])
    small_bytes = max(1, total - int(sums.sum()))
    spark = docs.sparkSession
    schema = "sha binary, copies long, shard int"
    of_large = spark.createDataFrame([(bytes(r["sha"]), r["copies"], s) for r, s in zip(large, placed, strict=True)], schema)

    def of(table: pa.Table) -> pa.Table:
        sha, size = table.column("sha").to_pylist(), table.column("bytes").to_pylist()
        order = sorted(range(len(sha)), key=lambda i: (-size[i], sha[i]))
        got = difference([size[i] for i in order], shards, (sums * (sum(size) / small_bytes)).astype(np.int64).tolist())
        part = [0] * len(sha)
        for i, s in zip(order, got, strict=True):
            part[i] = s
        return pa.table({"sha": table.column("sha"), "copies": table.column("copies"), "shard": pa.array(part, pa.int32())})

    buckets = max(1, -(-number // BUCKET))
    of_small = groups.filter(~is_large).withColumn("bucket", F.pmod(F.xxhash64("sha"), F.lit(buckets))).groupBy("bucket").applyInArrow(of, schema)
    where = of_large.unionByName(of_small)

    slices = max(1, -(-rows // (shards * SLICE)))
    dealt = join_groups(base, where, "sha", "copies", rows).drop("sha", "copies").withColumn("slice", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slices)))
    dealt = materialise(dealt, "placed")
    counts = dealt.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))).select("shard", "slice", F.coalesce("before", F.lit(0)).alias("before"))
    numbered = dealt.withColumn("i", F.row_number().over(Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size")))
    return numbered.join(before, ["shard", "slice"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("i") - 1).cast("long").alias("slot"))
