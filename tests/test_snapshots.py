"""Graph snapshots, versions and betas, quality, quotes in texts."""

import json
import random

import pytest

from corpusgraph.operators import documents, reports, snapshots


def test_snapshots_round_trip_and_broken_ones(spark, tmp_path):
    nodes = spark.createDataFrame([("a#x", "x", "a", "function", 1, 2, True, False, "h"), ("a", "a", "a", "file", None, None, True, False, "h")], snapshots.NODES)
    edges = spark.createDataFrame([("a", "a#x", "contains", "extracted", 0), ("a#x", "ext:y", "imports", "inferred", 3)], snapshots.EDGES)
    meta = spark.createDataFrame([(3, "e1")], snapshots.META)
    snapshots.write(nodes, edges, meta, str(tmp_path / "g"))
    for got, want in zip(snapshots.read(spark, str(tmp_path / "g")), (nodes, edges, meta), strict=True):
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    edges.write.mode("append").parquet(str(tmp_path / "g" / "edges"))
    with pytest.raises(ValueError, match="no whole snapshot"):
        snapshots.read(spark, str(tmp_path / "g"))
    (tmp_path / "g.json").write_text(json.dumps({"meta": {"version": 3, "extractor": "e1"}, "nodes": [r.asDict() for r in nodes.collect()], "edges": [r.asDict() for r in edges.collect()]}, indent=1))
    for got, want in zip(snapshots.read_json(spark, str(tmp_path / "g.json")), (nodes, edges, meta), strict=True):
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert snapshots.validate(nodes, edges, meta, 3).count() == 0
    bad = nodes.unionByName(spark.createDataFrame([(None, "n", "p", "k", None, None, True, False, "h"), ("b", "n", "", "k", None, None, True, False, "h"), ("c", "n", "p", None, None, None, True, False, "h"), ("d", "n", "p", "k", None, None, True, False, ""), ("a", "n", "p", "k", None, None, True, False, "h")], snapshots.NODES))
    loose = edges.unionByName(spark.createDataFrame([("q", "a", "calls", "x", 1), ("q", "b", "calls", "x", 1), ("", "a", "calls", "x", 1), ("a", None, "calls", "x", 1), ("a", "b", "likes", "x", 1), ("a", "b", None, "x", 1)], snapshots.EDGES))
    got = {tuple(r) for r in snapshots.validate(bad, loose, spark.createDataFrame([(2, "")], snapshots.META), 3).collect()}
    assert got == {("unknown version", None, 1), ("no stamp", None, 1), ("node without id", None, 1), ("node without path", "b", 1), ("node without kind", "c", 1), ("node without hash", "d", 1), ("id twice", "a", 2), ("source is no node", "q", 2), ("edge without source", "a", 1), ("edge without target", "a", 1), ("unknown relation", "likes", 1), ("unknown relation", None, 1)}


def test_versions_and_betas(spark):
    tags = [("a", t) for t in ("v1.2.3", "v1.10.0", "v1.9.9", "v2.0.0-rc1", "x", "v1.11.0-beta.2", "v1.11.0-beta.10", "v1.10.1-beta.4", "v2.0.0-beta.01")] + [("b", "v1.2"), ("b", "v1.0.0-beta.7")]
    frame = spark.createDataFrame(tags, "repo string, tag string")
    got = {bump: {tuple(r) for r in reports.next_releases(frame, bump).collect()} for bump in ("major", "minor", "patch")}
    assert got["minor"] == {("a", "1.11.0", "1.11.0-beta.11"), ("b", "1.0.0", "1.0.0-beta.8")} and ("a", "1.10.1", "1.10.1-beta.5") in got["patch"] and ("a", "2.0.0", "2.0.0-beta.1") in got["major"]
    with pytest.raises(ValueError):
        reports.next_releases(frame, "huge")


def test_quality_with_misses(spark):
    rows = spark.createDataFrame([("1", "x", 1, 10.0), ("2", "x", 4, 30.0), ("3", "y", 0, 50.0), ("4", "y", 3, 20.0), ("5", "y", None, 70.0)], "id string, kind string, rank int, ms double")
    report, misses = reports.quality_report(rows)
    assert {tuple(r) for r in report.collect()} == {("x", 2, 1, 10.0, 30.0), ("y", 3, 1, 20.0, 60.0), ("all", 5, 2, 15.0, 50.0)}
    assert {tuple(r) for r in misses.collect()} == {("2", "x", "rank 4"), ("3", "y", "not found"), ("5", "y", "not found")}


def test_quotes_are_found_as_by_a_plain_search(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("ab.é", k=rng.randrange(1, 4)))
    texts = [rng.choice([" ", "\n", "  "]).join(word() for _ in range(rng.choice([0, 3, 40, 400]))) for _ in range(80)] + [None, ""]
    quotes = []
    for _ in range(60):
        t = rng.choice(texts) or "x"
        a = rng.randrange(len(t)) if t else 0
        quotes.append(t[a : a + rng.choice([1, 5, 12, 40, 90])] + rng.choice(["", "", "zz"]))
    quotes += ["", None, quotes[0], " ", "a b c d e f g"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {tuple(r) for r in documents.containing(spark.createDataFrame(list(enumerate(quotes)), "item_id int, quote string"), docs).collect()}
    assert got == {(i, d) for i, q in enumerate(quotes) for d, t in enumerate(texts) if q is not None and t is not None and q in t}
