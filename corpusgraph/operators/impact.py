"""Change impact: lines to spans, spans to reach, reach to test signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoint import cut
from .graph import folded, walked

#: Lines per bin of a range join.
BIN = 64


def _bins(lo: str, hi: str):
    return F.explode(F.sequence(F.floor(F.col(lo) / BIN), F.floor(F.col(hi) / BIN)))


def enclosing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points(path, line) with the id of the span that starts last among those around the line; of equal starts the wider, then the lesser id.

    A range join on (path, bin of lines), so that neither a long file nor a long span pairs all with all.
    """
    s = spans.filter("span_from IS NOT NULL").select("path", F.col("id"), "span_from", "span_to").withColumn("bin", _bins("span_from", "span_to"))
    p = points.withColumn("bin", F.floor(F.col("line") / BIN))
    hit = p.join(s, ["path", "bin"], "left").filter("span_from IS NULL OR line BETWEEN span_from AND span_to")
    best = hit.groupBy(*points.columns).agg(F.min_by("id", F.struct(-F.col("span_from"), -F.col("span_to"), "id")).alias("id"))
    return points.join(best, points.columns, "left")


def innermost(ranges: DataFrame, spans: DataFrame) -> DataFrame:
    """ranges(path, line_from, line_to) with each overlapping span that contains no other overlapping one; equal spans drop each other.

    A range and a span meet in the first bin that both lie in, so once; the spans of a range are compared in its own row.
    """
    first = lambda c: F.floor(F.col(c) / BIN)
    s = spans.filter("span_from IS NOT NULL").select("path", "id", "span_from", "span_to").withColumn("bin", _bins("span_from", "span_to"))
    keys = ranges.columns
    r = ranges.withColumn("bin", _bins("line_from", "line_to"))
    hit = r.join(s, ["path", "bin"]).filter("span_from <= line_to AND line_from <= span_to").filter(F.col("bin") == F.greatest(first("line_from"), first("span_from")))
    hits = hit.groupBy(*keys).agg(F.collect_set(F.struct("id", "span_from", "span_to")).alias("hits"))
    holds = lambda x, o: (o["id"] != x["id"]) & (o["span_from"] >= x["span_from"]) & (o["span_to"] <= x["span_to"])
    around = F.filter("hits", lambda x: F.exists("hits", lambda o: holds(x, o)))
    return hits.select(*keys, F.explode(F.array_except(F.transform("hits", lambda x: x["id"]), F.transform(around, lambda x: x["id"]))).alias("id"))


def radius(hunks: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """(id, depth, froms): what the changed files reach, with the least depth and the number of files it comes from."""
    ranges = cut(hunks.select("path", "line_from", "line_to"), "ranges")
    # The walk moves numbers of files and nodes, not their names; it finds a node once per file.
    files = cut(ranges.select("path").distinct().select("path", F.monotonically_increasing_id().alias("origin")), "files")
    touched = cut(innermost(ranges, nodes).select("path", "id").distinct(), "touched")
    whole = files.select("path").join(touched.select("path").distinct(), "path", "left_anti").join(nodes.filter("kind = 'file'").select("path", "id"), "path").select("path", "id")
    seen, ids = walked(folded(edges), touched.unionByName(whole).join(files, "path").select("origin", "id"), True, depth)
    found = seen.filter("depth > 0").groupBy("no").agg(F.min("depth").alias("depth"), F.count("*").alias("froms"), F.min("guess").alias("inferred"))
    return found.join(ids, "no").select("id", "depth", "froms", "inferred")


def test_signal(hunks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, signal) per changed file: na for tests, none without a test that reaches it, changed if such a test is in the change, else stale."""
    return _signal(cut(hunks.select("path").distinct(), "files"), cut(nodes.select("id", "path", "is_test"), "nodes"), folded(edges))


def _signal(files: DataFrame, nodes: DataFrame, steps: DataFrame) -> DataFrame:
    # Walked from the tests, not from the files: two walks over the graph, however many files have changed.
    tests = nodes.filter("is_test").select("id", "path").join(files.withColumn("moved", F.lit(True)), "path", "left")
    starts = tests.select("id", F.explode(F.when(F.col("moved"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("origin"))
    seen, ids = walked(steps, starts, False)
    got = seen.filter("depth > 0").groupBy("no").agg(F.bool_or("origin").alias("moved")).join(ids, "no").join(nodes.select("id", "path"), "id")
    per = got.groupBy("path").agg(F.bool_or("moved").alias("changed"))
    is_test = nodes.groupBy("path").agg(F.bool_or("is_test").alias("is_test"))
    return files.join(is_test, "path", "left").join(per, "path", "left").select("path", F.when(F.col("is_test"), "na").when(F.col("changed").isNull(), "none").when(F.col("changed"), "changed").otherwise("stale").alias("signal"))


def audit(hunks: DataFrame, nodes: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """(path, signal, id, in_degree): changed symbols with many callers in files whose tests say nothing."""
    ranges = cut(hunks.select("path", "line_from", "line_to"), "ranges")
    nodes, steps = cut(nodes.select("id", "path", "span_from", "span_to", "is_test"), "nodes"), folded(edges)
    weak = cut(_signal(cut(ranges.select("path").distinct(), "files"), nodes, steps).filter("signal IN ('none', 'stale')"), "weak")
    # Only ranges of files whose tests say nothing meet spans.
    seeds = innermost(ranges.join(weak.select("path"), "path", "left_semi"), nodes).select("path", "id").distinct()
    degrees = steps.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("in_degree")).filter(F.col("in_degree") >= least)
    return seeds.join(weak, "path").join(degrees, "id").select("path", "signal", "id", "in_degree")


def skeleton(nodes: DataFrame) -> DataFrame:
    """(path, place, id): the symbols of each file by start line, spanless last, then name."""
    w = Window.partitionBy("path").orderBy(F.asc_nulls_last("span_from"), "name", "id")
    return nodes.filter("kind <> 'file'").select("path", F.row_number().over(w).alias("place"), "id")
