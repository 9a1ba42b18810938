"""Properties of operators on hand-made tables."""

import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import text
from corpusgraph.operators import drift, graph, impact, reports, search
from corpusgraph.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, text.tokens(F.lit("getUserName für the HTTP2Server a b"))) == ["user", "name", "http2", "server"]


def test_grams(spark):
    assert one(spark, text.grams(F.lit("aBcä"))) == ["abc"]
    assert one(spark, text.grams(F.lit("ab"))) == []
    assert one(spark, text.grams(F.lit(""))) == []


def test_paths_and_versions(spark):
    assert one(spark, text.clean_path(F.lit("a/./b/../c//d"))) == "a/c/d"
    assert one(spark, text.version(F.lit("v1.10-rc1"))) == [1, 10, 0]
    assert one(spark, text.version(F.lit("1.9.3")) < text.version(F.lit("1.10")))
    assert one(spark, text.version(F.lit("none"))) is None


@pytest.mark.parametrize(("glob", "path", "hit"), [("*.md", "a/b.md", True), ("a/*.md", "a/b/c.md", False), ("a/**", "a/b/c.md", True), ("**/c.md", "c.md", True), ("?.md", "ab.md", False)])
def test_globs(spark, glob, path, hit):
    assert one(spark, F.lit(path).rlike(text.glob_regex(glob))) is hit


EDGES = [("a", "b", "calls", "extracted", 1), ("b", "c", "calls", "inferred", 2), ("a", "c", "imports", "extracted", 3), ("c", "d", "calls", "extracted", 0), ("a", "b", "calls", "extracted", 5), ("f", "a", "contains", "extracted", 0), ("d", "ext:x", "imports", "extracted", 1)]


def graph_of(spark):
    nodes = spark.createDataFrame([(x, x, "p/" + x) for x in "abcdf"], "id string, name string, path string")
    return nodes, spark.createDataFrame(EDGES, "source string, target string, relation string, confidence string, line int")


def test_reach_keeps_the_best_path(spark):
    _, edges = graph_of(spark)
    got = {(r.id, r.depth, r.inferred) for r in graph.reach(edges, spark.createDataFrame([("o", "a")], "origin string, id string"), False).collect()}
    assert got == {("b", 1, False), ("c", 1, False), ("d", 2, False), ("ext:x", 3, False)}


def test_rank_keeps_all_mass(spark):
    nodes, edges = graph_of(spark)
    got = {r.id: r.score for r in graph.pagerank(nodes, edges, spark.createDataFrame([("a", 2.0), ("f", 1.0), ("zz", 9.0)], "id string, weight double")).collect()}
    assert max(got.values()) == 1.0 and set(got) == set("abcdf")
    assert graph.pagerank(nodes, edges, spark.createDataFrame([("zz", 1.0)], "id string, weight double")).count() == 0


def test_cycles(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 1)], "source long, target long")
    assert {(r.id, r.cycle) for r in graph.cycles(links).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)}


def test_innermost_drops_equal_spans(spark):
    spans = spark.createDataFrame([("f", "out", 1, 100), ("f", "in", 10, 20), ("f", "x", 50, 60), ("f", "y", 50, 60), ("f", "none", None, None)], "path string, id string, span_from long, span_to long")
    ranges = spark.createDataFrame([("f", 15, 15), ("f", 55, 55), ("f", 90, 95), ("f", 200, 201)], "path string, line_from long, line_to long")
    assert {(r.line_from, r.id) for r in impact.innermost(ranges, spans).collect()} == {(15, "in"), (90, "out")}


def test_renames_need_one_on_both_sides(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "2"), ("k", "9")], "path string, content_hash string")
    new = spark.createDataFrame([("x", "1"), ("y", "2"), ("k", "8")], "path string, content_hash string")
    assert [tuple(r) for r in drift.renames(old, new).collect()] == [("a", "x")]
    assert drift.content_drift(old, old).count() == 0


def test_digest_ignores_order_and_partitions(spark):
    rows = spark.createDataFrame([(str(i), str(i * i)) for i in range(50)], "path string, content_hash string")
    assert drift.digest(rows).first() == drift.digest(rows.repartition(7).orderBy(F.desc("path"))).first()


def test_candidates_hold_all_matches(spark):
    docs = spark.createDataFrame([(1, "Hello World"), (2, "hell"), (3, "ello worl"), (4, "")], "id long, text string")
    got = {r.id for r in search.candidates(search.gram_index(docs), docs, [["hello"]]).collect()}
    assert got >= {1} and 4 not in got
    assert search.candidates(search.gram_index(docs), docs, [["he"]]).count() == 4
    with pytest.raises(ValueError, match="look-around"):
        search.grep(docs, "(?=a)")


def test_layers_and_ties(spark):
    files = spark.createDataFrame([("a/b.py",), ("a/x.py",), ("z.py",)], "path string")
    got = {r.path: (r.layer, r.tie) for r in reports.assign_layers(files, [("one", "a/*"), ("two", "a/b.py"), ("three", "a/?.py")]).collect()}
    assert got["a/b.py"] == ("two", False) and got["a/x.py"] == ("one", True) and got["z.py"][0] is None


def test_coverage_saturates(spark):
    rows = spark.createDataFrame([("a", 1, reports.MOST_HITS), ("a", 1, 5), ("a", 2, 0)], "path string, line int, hits long")
    assert {(r.line, r.hits) for r in reports.merge_coverage(rows).collect()} == {(1, reports.MOST_HITS), (2, 0)}


def test_late_events_are_dropped(spark, tmp_path):
    src = f"{tmp_path}/in"
    for i, times in enumerate([["2024-01-01 00:00:00", "2024-01-01 02:00:00"], ["2024-01-01 03:30:00"], ["2024-01-01 00:05:00", "2024-01-01 05:00:00"]]):
        spark.createDataFrame([(t, "k", 100) for t in times], "t string, k string, cents long").select(F.to_timestamp("t").alias("at"), "k", "cents").coalesce(1).write.mode("append").parquet(f"{src}/{i}")
    stream = spark.readStream.schema("at timestamp, k string, cents long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(src)
    out = events.run_available(events.windows(stream, "at", ["k"], "1 hour", late="10 minutes"), str(tmp_path))
    assert sum(r.n for r in out.collect()) <= 4 and {r.n for r in out.collect()} == {1}


def test_grep_finds_lines_by_their_ends(spark):
    docs = spark.createDataFrame([(1, "foo\nbar\nbaz foo")], "id long, text string")
    found = lambda p: sorted(r.line_no for r in search.grep(docs, p).collect())
    assert found(r"\Abar") == [2] and found(r"foo\z") == [1, 3] and found("^ba") == [2, 3]
