"""Edits that keep a file's size."""

from corpusgraph.operators import drift


def test_same_size_edits_show_by_mtime(spark):
    schema = "path string, content_hash string, size long, mtime long"
    old = spark.createDataFrame([("edited", "1", 5, 1), ("touched", "2", 5, 1), ("kept", "3", 5, 1), ("unknown", "4", 5, None), ("gone", "5", 5, 1)], schema)
    new = spark.createDataFrame([("edited", "9", 5, 2), ("touched", "2", 5, 2), ("kept", "3", 5, 1), ("unknown", "8", 5, 1), ("come", "6", 5, 1)], schema)
    want = {("edited", "changed"), ("unknown", "changed"), ("gone", "removed"), ("come", "added")}
    assert {tuple(r) for r in drift.stat_drift(old, new).collect()} == want
    assert {tuple(r) for r in drift.stat_drift(old.drop("mtime"), new.drop("mtime")).collect()} == want
