"""Merge events that land on all open pages of an area or on none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoint import cut


def land(events: DataFrame, areas: DataFrame, pages: DataFrame, standing: DataFrame, open_states: list[str]) -> tuple[DataFrame, DataFrame]:
    """(events with `decision`, new cases).

    events(event, repo, evidence), taken in the order of event; areas(scope, repo); pages(scope, path, state); standing
    cases(scope, path, trigger, package). An event concerns the area of its repository and there all pages in an open
    state. A page takes it if it is free, or has a merge case whose package quotes every block of the evidence. If any
    page doesn't, the event is deferred as a whole and should be given again with the next batch; else it lands (also
    where no page is open). The first event that lands takes the area's free pages, so a later one lands only if that
    one quotes it, too. Cases: (scope, path, event) of pages that were free. An event without an area is `unknown`.
    """
    known = events.join(areas.select("repo", "scope"), "repo", "left")
    targets = pages.filter(F.col("state").isin(open_states)).select("scope", "path").distinct()
    held = targets.join(standing.select("scope", "path", "trigger", "package"), ["scope", "path"])
    # Evidence that a page of the area refuses. Blocks and packages meet once each per area, and all packages only those blocks
    # that the shortest one holds, so events and occupied pages are never paired.
    package = F.coalesce("package", F.lit(""))
    packages = held.select("scope", package.alias("package")).distinct()
    shortest = packages.groupBy("scope").agg(F.min_by("package", F.struct(F.length("package"), "package")).alias("shortest"))
    closed = held.filter("trigger <> 'merge'").select("scope").distinct()
    given = known.join(shortest, "scope").join(closed, "scope", "left_anti").select("scope", "evidence", "shortest").distinct()
    blocks = cut(given.select("scope", F.explode("evidence").alias("block"), "shortest").distinct().withColumn("held", F.contains("shortest", F.col("block"))).select("scope", "block", "held"), "blocks")
    missed = blocks.filter("held").join(packages, "scope").filter(~F.contains("package", F.col("block"))).select("scope", "block").distinct()
    refused_blocks = blocks.filter("NOT held").select("scope", "block").unionByName(missed)
    quotes = known.select("event", "scope", "evidence").join(shortest.select("scope"), "scope", "left_semi").join(closed, "scope", "left_anti")
    refused = quotes.select("event", "scope", F.explode("evidence").alias("block")).join(refused_blocks, ["scope", "block"]).select("event", "scope").distinct().withColumn("refused", F.lit(True))
    free = targets.join(standing.select("scope", "path"), ["scope", "path"], "left_anti")
    has_free = free.select("scope").distinct().withColumn("has_free", F.lit(True))
    is_closed = closed.withColumn("closed", F.lit(True))
    rows = known.join(refused, ["event", "scope"], "left").join(has_free, "scope", "left").join(is_closed, "scope", "left").withColumn("fits", F.col("scope").isNotNull() & F.col("refused").isNull() & F.col("closed").isNull())
    # The first event that fits folds per area before it meets the area's events.
    first = rows.filter("fits").groupBy("scope").agg(F.min(F.struct("event", "evidence")).alias("first"))
    rows = rows.join(first, "scope", "left")
    text = F.array_join("first.evidence", "\n")
    lands = F.col("fits") & (F.col("has_free").isNull() | (F.col("event") == F.col("first.event")) | F.forall("evidence", lambda b: F.contains(text, b)))
    decided = rows.withColumn("decision", F.when(F.col("scope").isNull(), "unknown").when(lands, "landed").otherwise("deferred"))
    takes = decided.filter("decision = 'landed' AND event = first.event").select("scope", "event")
    return decided.select("event", "scope", "decision"), free.join(takes, "scope").select("scope", "path", "event")
