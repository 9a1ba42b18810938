"""Queries over append logs: run journals, sessions, latest states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_per_run(journal: DataFrame, run: str, order: str) -> DataFrame:
    """The last row of each run."""
    others = [c for c in journal.columns if c != run]
    return journal.groupBy(run).agg(F.max_by(F.struct(*others), order).alias("x")).select(run, "x.*")


def waiting(journal: DataFrame) -> DataFrame:
    """Runs whose last row is paused."""
    return last_per_run(journal, "run", "seq").filter("outcome = 'paused'")


def lookup(journal: DataFrame, outcome: str | None = None) -> DataFrame:
    """The newest row for each (node, input_hash), of one outcome if given."""
    rows = journal.filter(F.col("outcome") == outcome) if outcome else journal
    return rows.groupBy("node", "input_hash").agg(F.max("seq").alias("seq"), F.max_by("run", "seq").alias("run"))


def live_sessions(sessions: DataFrame, ended: DataFrame, mine: str, cutoff: str) -> DataFrame:
    """One row: how many other sessions are alive, seen at the cutoff or later."""
    return sessions.filter((F.col("session") != mine) & (F.col("seen") >= F.lit(cutoff).cast("timestamp_ntz"))).join(ended, "session", "left_anti").agg(F.count("*").alias("others"))


def verdicts(lanes: DataFrame) -> DataFrame:
    """(run, red, green) of lanes(run, lane, state): red if any lane failed, green the sorted lanes that are done."""
    return lanes.groupBy("run").agg(F.bool_or(F.col("state") == "failed").alias("red"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("state") == "done", F.col("lane")))), ",").alias("green"))


def outcome_summary(journal: DataFrame) -> DataFrame:
    """(node, done, failed, paused, seconds) per node."""
    return journal.groupBy("node").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("done", "failed", "paused")], F.round(F.sum(F.round(F.col("seconds") * 100).cast("long")) / 100, 2).alias("seconds"))
