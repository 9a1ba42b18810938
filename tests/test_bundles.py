"""Lint over areas, signposts, layers, passes, unions on hand-made rows."""

from pyspark.sql import functions as F

from corpusgraph.operators import bundles


def test_lint_sees_each_area_alone(spark):
    files = [
        ("a", "index.md", "---\nv: 1\nw: 2\n---\n* [p](p.md)"), ("a", "p.md", "[q](q.md) [gone](no.md) [out](../../x.md) [w](https://h) [anchor](#a)"), ("a", "q.md", "> [!CONFLICT]\n```\n> [!conflict]\n```"), ("a", "log.md", "[r](r.md) [dead](zz.md)"), ("a", "r.md", None),
        ("b", "s.md", "[p](p.md)"), ("b", "sub/index.md", "---\nv: 1\n---\n* [s](../s.md)"), ("b", "t.md", "---\ntitle: x"),
    ]
    got = [tuple(r) for r in bundles.lint(spark.createDataFrame(files, "area string, path string, text string"), "v").collect()]
    assert got == [
        ("a", "index.md", "index-frontmatter-misplaced", "error", "not allowed: w"), ("a", "p.md", "dead-link", "error", "../../x.md"), ("a", "p.md", "dead-link", "error", "no.md"), ("a", "q.md", "conflict-count", "error", "1"), ("a", "r.md", "orphan", "note", ""),
        ("b", "s.md", "dead-link", "error", "p.md"), ("b", "sub/index.md", "index-frontmatter-misplaced", "error", "only the root catalog may have a header"), ("b", "t.md", "frontmatter-unparsable", "error", "no end"), ("b", "t.md", "orphan", "note", ""),
    ]


def test_signposts(spark):
    areas = spark.createDataFrame([("post", "Docs/post", True), ("x/one", "Docs/one", False), ("two", "Docs/Two", False), ("three", None, False), ("four", "Docs/four", False)], "scope string, wiki string, signpost boolean")
    links = spark.createDataFrame([("post", "docs/ONE/"), ("post", "Hub/Two.md"), ("four", "docs/four")], "scope string, target string")
    assert {tuple(r) for r in bundles.unlisted_areas(links, areas, "hub").collect()} == {("post", "four")}


def test_layers_and_schedules(spark):
    links = spark.createDataFrame([("a", "b", "forward"), ("b", "c", "use"), ("a", "c", "forward"), ("c", "a", "forward"), ("c", "d", "use"), ("d", "d", "use")], "source string, target string, kind string")
    starts = spark.createDataFrame([("a",), ("d",), ("z",)], "start string")
    assert {tuple(r) for r in bundles.layers(starts, links).collect()} == {("a", "a", 0), ("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("d", "d", 0), ("z", "z", 0)}
    assert {tuple(r) for r in bundles.layers(starts, links, "forward").collect()} == {("a", "a", 0), ("a", "b", 1), ("a", "c", 1), ("d", "d", 0), ("z", "z", 0)}
    now = F.lit("2024-01-02 12:00:00").cast("timestamp")
    passes = spark.createDataFrame([("old", "2024-01-01T12:00:00Z"), ("zone", "2024-01-01T13:30:00+02:00"), ("young", "2024-01-01T12:00:01Z"), ("young", "2023-01-01T00:00:00Z"), ("bare", "2020-01-01T00:00:00"), ("junk", "x")], "area string, at string")
    assert {r.area for r in bundles.stale_passes(passes, now).collect()} == {"old", "zone"}
    runs = spark.createDataFrame([("a", "2024-01-02 11:59:00"), ("b", "2024-01-02 11:59:01"), ("b", "2020-01-01 00:00:00")], "root string, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert {r.root for r in bundles.due(spark.createDataFrame([("a",), ("b",), ("c",)], "root string"), runs, now, 60).collect()} == {"a", "c"}
    raw = spark.createDataFrame([("1",), ("2",), ("3",)], "raw_id string")
    edges, left = bundles.union_edges({"x": spark.createDataFrame([("1", "t")], "raw_id string, target string"), "y": spark.createDataFrame([("1", "u", True), ("2", "v", False)], "raw_id string, target string, inferred boolean")}, raw)
    assert {tuple(r) for r in edges.select("raw_id", "target", "language", "inferred").collect()} == {("1", "t", "x", None), ("1", "u", "y", True), ("2", "v", "y", False)} and [r.raw_id for r in left.collect()] == ["3"]
