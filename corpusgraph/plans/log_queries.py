"""Queries over logs, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import logs
from ..streaming import events as streams
from ..checkpoint import shared_dir
from .registry import Tables, query


@query("w10_last_entries", "SELECT run, arg_max(node, seq) AS node, max(seq) AS seq, arg_max(outcome, seq) AS outcome FROM l_journal GROUP BY run")
def last_entries(t: Tables) -> DataFrame:
    return logs.last_per_run(t.l_journal.select("run", "node", "seq", "outcome"), "run", "seq")


@query("x6_waiting_runs", "SELECT run, arg_max(node, seq) AS node, max(seq) AS seq FROM l_journal GROUP BY run HAVING arg_max(outcome, seq) = 'paused'")
def waiting(t: Tables) -> DataFrame:
    return logs.waiting(t.l_journal.select("run", "node", "seq", "outcome")).select("run", "node", "seq")


@query("w11_lookup", "SELECT node, input_hash, max(seq) AS seq, arg_max(run, seq) AS run FROM l_journal WHERE outcome = 'done' GROUP BY node, input_hash")
def lookup(t: Tables) -> DataFrame:
    return logs.lookup(t.l_journal, "done")


@query("w12_latest_seen", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def seen(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))


@query("a28_live_sessions", "SELECT count(*) AS others FROM (SELECT user_id, max(ts) AS seen FROM events GROUP BY user_id) WHERE user_id <> 7 AND seen >= TIMESTAMP '2024-01-29 00:00:00' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 50)")
def live(t: Tables) -> DataFrame:
    sessions = t.events.groupBy(F.col("user_id").cast("string").alias("session")).agg(F.max("ts").alias("seen"))
    ended = t.events.filter("event_type = 'signup' AND value > 50").select(F.col("user_id").cast("string").alias("session")).distinct()
    return logs.live_sessions(sessions, ended, "7", "2024-01-29 00:00:00")


@query("a19_verdicts", "SELECT run, bool_or(outcome = 'failed') AS red, coalesce(array_to_string(list_sort(list(DISTINCT CASE WHEN outcome = 'done' THEN node END) FILTER (outcome = 'done')), ','), '') AS green FROM l_journal GROUP BY run")
def verdicts(t: Tables) -> DataFrame:
    return logs.verdicts(t.l_journal.select("run", F.col("node").alias("lane"), F.col("outcome").alias("state")))


@query("a5_outcomes", "SELECT node, count(*) FILTER (outcome = 'done') AS done, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'paused') AS paused, round(sum(CAST(round(seconds * 100) AS BIGINT)) / 100, 2) AS seconds FROM l_journal GROUP BY node")
def outcomes(t: Tables) -> DataFrame:
    return logs.outcome_summary(t.l_journal)


def stream(t: Tables) -> DataFrame:
    """The events as a stream over the table's file, with event time in UTC and values in whole cents."""
    schema = t.events.schema
    # A file source takes a folder or a pattern; the pattern stands for the table, be it a file or a folder.
    rows = t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/event[s].parquet")
    return rows.withColumns({"at": F.col("ts").cast("timestamp"), "cents": F.round(F.col("value") * 100).cast("long")})


@query("x11_tumbling_windows", "SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ALL")
def tumbling(t: Tables) -> DataFrame:
    out = streams.run_available(streams.windows(stream(t), "at", ["event_type"], "1 day", late="60 days"), shared_dir(t.spark), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("x11_sliding_windows", "SELECT event_type, s AS start, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM (SELECT event_type, value, unnest([date_trunc('hour', ts) - INTERVAL (extract(hour FROM ts) % 6) HOUR - INTERVAL 6 HOUR, date_trunc('hour', ts) - INTERVAL (extract(hour FROM ts) % 6) HOUR]) AS s FROM events) GROUP BY ALL")
def sliding(t: Tables) -> DataFrame:
    out = streams.run_available(streams.windows(stream(t), "at", ["event_type"], "12 hours", "6 hours", late="60 days"), shared_dir(t.spark), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("x6_latest_state_stream", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest(t: Tables) -> DataFrame:
    return streams.run_available(streams.latest_state(stream(t), "user_id", "event_id", "event_type"), shared_dir(t.spark), "complete")


@query("x5_tombstoned_stream", "SELECT event_id, user_id FROM events WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE value < 0.5)")
def tombstoned(t: Tables) -> DataFrame:
    dropped = t.events.filter("value < 0.5")
    return streams.run_available(streams.tombstoned(stream(t), dropped, ["user_id", "event_type"]).select("event_id", "user_id"), shared_dir(t.spark))


@query("x4_once_stream", "SELECT DISTINCT user_id, event_type FROM events")
def once(t: Tables) -> DataFrame:
    return streams.run_available(streams.once(stream(t).select("at", "user_id", "event_type"), "at", ["user_id", "event_type"], "60 days").select("user_id", "event_type"), shared_dir(t.spark))


@query("x1_quiet_periods", "WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM g GROUP BY user_id, k")
def quiet(t: Tables) -> DataFrame:
    rows = t.events.withColumn("at", F.col("ts").cast("timestamp"))
    return streams.quiet_periods(rows, "at", "user_id", "6 hours", "60 days").withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})
