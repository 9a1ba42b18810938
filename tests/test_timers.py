"""Streams with timers over several batches, with late rows, against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusgraph.streaming import events as streams
from corpusgraph.streaming import timers

BEGIN = datetime(2024, 1, 1)
US = timedelta(microseconds=1)


def batches(spark, folder, parts, schema):
    """A stream that reads one file a batch, in this order."""
    import os
    import time

    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{folder}/{i}")
        for name in os.listdir(f"{folder}/{i}"):
            if name.endswith(".json"):
                os.makedirs(f"{folder}/in", exist_ok=True)
                os.rename(f"{folder}/{i}/{name}", f"{folder}/in/{i:03}.json")
                os.utime(f"{folder}/in/{i:03}.json", (time.time() - 1000 + i,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{folder}/in").withColumn("at", F.col("at").cast("timestamp"))


def seen(parts, late):
    """The rows that aren't late, and the last watermark: a batch's watermark is that of the rows before it, and its rows are late by that of the batch before."""
    marks, out = [None], []
    for rows in parts:
        top = max(r[1] for r in rows) - late
        marks.append(top if marks[-1] is None else max(marks[-1], top))
    for n, rows in enumerate(parts):
        mark = marks[n - 1] if n else None
        out += [r for r in rows if mark is None or r[1] > mark]
    return out, marks[-1]


def shuffled(seed, kinds=("",)):
    rng = random.Random(seed)
    rows = [(f"k{rng.randrange(6)}", BEGIN + timedelta(milliseconds=rng.randrange(600_000)), rng.choice(kinds)) for _ in range(400)]
    rows.sort(key=lambda r: r[1] + timedelta(seconds=rng.choice([0, 0, 0, 5, 20, 300])))
    return [rows[i : i + 50] for i in range(0, 400, 50)]


@pytest.mark.parametrize("seed", [1])
def test_bursts_fire_quiet_or_capped(spark, tmp_path, seed):
    parts, late = shuffled(seed), timedelta(seconds=30)
    kept, mark = seen(parts, late)
    assert len(kept) < 400  # some rows are late
    want = set()
    for k in {r[0] for r in kept}:
        at = sorted((r[1] - BEGIN) // US for r in kept if r[0] == k)
        want |= {(k, BEGIN + a * US, BEGIN + b * US, n) for a, b, n in timers.bursts_of(at, 2_000_000, 10_000_000) if BEGIN + b * US <= mark}
    stream = batches(spark, str(tmp_path), parts, "root string, at timestamp_ntz, kind string")
    got = streams.run_available(timers.capped_bursts(stream, "at", "root", 2, 10, "30 seconds"), str(tmp_path))
    assert {tuple(r) for r in got.collect()} == want and any(b - a == timedelta(seconds=10) for _, a, b, _ in want)


def test_bursts_by_hand():
    s = 1_000_000
    assert timers.bursts_of([0, s, 2 * s, 4 * s], 2 * s, 10 * s) == [(0, 4 * s, 3), (4 * s, 6 * s, 1)]
    assert timers.bursts_of([i * s for i in range(12)], 2 * s, 10 * s) == [(0, 10 * s, 10), (10 * s, 13 * s, 2)]


def test_sessions_retire_revive_and_expire(spark, tmp_path):
    parts, late = shuffled(7, ("beat", "beat", "end")), timedelta(seconds=30)
    kept, mark = seen(parts, late)
    want = set()
    for k in {r[0] for r in kept}:
        mine = sorted(((r[1] - BEGIN) // US, r[2]) for r in kept if r[0] == k and r[1] < mark)
        want |= {(k, what, BEGIN + at * US) for what, at in timers.life(mine, None, 20_000_000, (mark - BEGIN) // US)[0]}
    stream = batches(spark, str(tmp_path), parts, "session string, at timestamp_ntz, kind string")
    got = streams.run_available(timers.session_states(stream, "at", "session", "kind", 20, "30 seconds"), str(tmp_path))
    assert {tuple(r) for r in got.collect()} == want and {w[1] for w in want} == {"live", "retired", "revived", "expired"}


def test_life_by_hand():
    assert timers.life([(0, "beat"), (5, "end"), (7, "beat"), (9, "beat")], None, 10, 30)[0] == [("live", 0), ("retired", 5), ("revived", 7), ("expired", 19)]
    assert timers.life([(0, "end"), (1, "beat"), (50, "end")], None, 10, 60) == ([("live", 1), ("expired", 11)], ("retired", 50))
