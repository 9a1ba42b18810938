"""The persisted index, its delta, fused ranks, and upserts that are replayed."""

from pyspark.sql import functions as F

from corpusgraph.operators import fusion, search
from corpusgraph.sources import index
from corpusgraph.streaming import upsert

FIELDS = {"path": "path", "body": "text"}
SCHEMA = "id long, path string, text string"


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_a_question_reads_its_own_buckets(spark, tmp_path):
    made = index.write(docs(spark, [(i, f"p{i}", f"word{i} common text number{i % 7}") for i in range(50)] + [(90, "bin", "word1 \x00 x"), (91, "none", None)]), "text", FIELDS, str(tmp_path / "i"))
    rows = made.postings(["common", "word7"])
    assert {(r.id, r.term) for r in rows.collect()} == {(i, "common") for i in range(50)} | {(7, "word7")}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r.id for r in made.gram_rows(["d1 "]).collect()} == {1}  # binary texts have no grams
    assert {r.id: r.len for r in made.manifest().filter("id IN (1, 91)").collect()} == {1: 4, 91: 0}


def test_delta_overlay_and_rebuild(spark, tmp_path):
    old = [(i, "p", f"line needle{i}\nother" if i % 2 else "hay") for i in range(20)]
    made = index.write(docs(spark, old), "text", FIELDS, str(tmp_path / "i"))
    assert index.decision(index.moved(made, docs(spark, old), "text")).first().action == "clean"
    new = docs(spark, [(1, "p", "gone"), (2, "p", "a needle2"), *old[4:], (30, "p", "x\nneedle30")])
    assert tuple(index.decision(index.moved(made, new, "text")).first()) == (2, 1, 2, "overlay")
    want = {(2, 1), (30, 2), *[(i, 1) for i in range(5, 20, 2)]}
    for limit, action, moved in ((200, "overlay", 5), (4, "rebuild", 0)):
        asked, moves, done = index.refresh(made, new, "text", FIELDS, limit)
        assert done == action and moves.count() == moved and (asked.folder == made.folder) == (action == "overlay")
        assert {(r.id, r.line_no) for r in index.grep(asked, new, "needle[0-9]+", [["needle"]], moves).collect()} == want
        assert {r.id for r in index.candidates(asked, new, "text", [["needle"], ["no"]], moves).collect()} == {r.id for r in new.collect()}


def test_index_scores_as_the_texts_do(spark, tmp_path):
    rows = docs(spark, [(i, f"apple/{i}", " ".join(["apple"] * (i % 4) + ["pear"] * (i % 3) + ["fig"] * i)) for i in range(30)])
    by_text = {r.id: round(r.lexical, 9) for r in search.lexical(rows, "apple pear apple plum", None, "path", "text").collect()}
    by_index = {r.id: round(r.lexical, 9) for r in index.lexical(index.write(rows, "text", FIELDS, str(tmp_path / "i")), "apple pear apple plum", {"path": search.PATH_WEIGHT}).collect()}
    assert by_text == by_index and len(by_text) == 30


def test_fused_ranks(spark):
    side = lambda ids: spark.createDataFrame([(x, 100 - i) for i, x in enumerate(ids)], "id long, score long")
    a, b = fusion.numbered(side([1, 2, 3]), "score", 2), fusion.numbered(side([3, 1]), "score", 9)
    got = [tuple(r) for r in fusion.reciprocal({"a": a, "b": b}, 9).select("id", "score").collect()]
    assert got == [(1, round(1 / 61 + 1 / 62, 9)), (3, round(1 / 61, 9)), (2, round(1 / 62, 9))]


def test_replayed_batches_change_nothing(spark, tmp_path):
    table = upsert.KeyedTable(spark, str(tmp_path / "t"), "content_hash string, n long, version string", ["content_hash", "version"])
    asked = []

    def extract(rows):
        asked.append(sorted(r.text for r in rows.collect()))
        return rows.select("content_hash", F.length("text").cast("long").alias("n"))

    each = upsert.extract_new(table, "text", "v1", extract)
    parts = [["a", "bb", "a", None], ["bb", "ccc"], ["a"]]
    frames = [spark.createDataFrame([(x,) for x in p], "text string") for p in parts]
    for number, frame in enumerate(frames):
        each(frame, number)
    assert asked == [["", "a", "bb"], ["ccc"], []]
    before = sorted(map(tuple, table.rows().collect()))
    each(frames[1], 1)
    assert sorted(map(tuple, table.rows().collect())) == before and asked[-1] == ["ccc"]
    rows = sorted(map(tuple, table.read().collect()))
    table.compact()
    each(frames[2], 2)
    assert sorted(map(tuple, table.read().collect())) == rows and len(rows) == 4
    again = []
    upsert.extract_new(table, "text", "v2", lambda r: again.append(r.count()) or r.select("content_hash", F.lit(0).cast("long").alias("n")))(frames[0], 3)
    assert again == [3] and table.read().count() == 7


def test_register_hashes_only_what_moved(spark, tmp_path):
    columns = "path string, size long, mtime long, content_hash string, state string, revision int"
    register = upsert.KeyedTable(spark, str(tmp_path / "r"), columns, ["path"])
    each = upsert.scan_register(register, "text")
    first = [("a", 1, 1, "x"), ("b", 1, 1, "x"), ("c", 1, 1, "x")]
    second = [("a", 1, 1, "unseen"), ("b", 1, 2, "x"), ("c", 2, 1, "yy"), ("d", 0, 9, None)]
    for number, rows in enumerate((first, second, second)):
        each(spark.createDataFrame(rows, "path string, size long, mtime long, text string"), number)
    assert {(r.path, r.state, r.revision) for r in register.read().collect()} == {("a", "new", 1), ("b", "touched", 1), ("c", "changed", 2), ("d", "new", 1)}
    assert {(r.path, r.batch) for r in register.rows().collect()} == {("a", 0), ("b", 0), ("c", 0), ("b", 1), ("c", 1), ("d", 1)}
