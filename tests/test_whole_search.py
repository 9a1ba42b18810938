"""Questions are held against documents with their whole text, in blocks."""

from corpusgraph.operators import search
from corpusgraph import checkpoint
from corpusgraph.plans import registry


def test_rank_needs_the_whole_question(spark, tmp_path):
    opening = "a common opening of many questions that is long enough "
    docs = [(1, opening + "only"), (2, "before " + opening + "and its own end, after it"), (3, opening + "and its own end")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, opening + "and its own end"), (8, opening + "that no document has")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = registry.queries()["j46_expected_rank"](spark, str(tmp_path)).collect()
    assert [(r.item_id, r.expected, r["rank"]) for r in rows] == [(7, 2, 2)]


def test_nearest_is_the_same_in_blocks(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i % 5 + 1), float(i % 7), 1.0]) for i in range(40)], "id long, vec array<double>")
    got = lambda: sorted(tuple(r) for r in search.nearest(vectors.filter("id < 9"), vectors, 3).collect())
    whole = got()
    monkeypatch.setattr(checkpoint, "BLOCK", 2)
    assert got() == whole and len(whole) == 27
