"""The pipeline's stages on a small table, against plain Python."""

import random

import corpus_pipeline
from corpusgraph.llm import exact_dedup, ngram_join

WORDS = "red green blue black white grey pink brown teal cyan lime gold plum navy rust sand".split()


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_stages_keep_what_they_should(spark, tmp_path):
    rng = random.Random(2)
    sentence = lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))
    item = sentence(15)
    texts = [sentence(80) for _ in range(60)]
    texts += [texts[0], texts[0] + "  ", " ".join([*texts[1].split()[:-1], "changed"]), item + " " + item, None, "", "you stupid idiot, you worthless scum. you moron."]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    write(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    write(spark, tmp_path, "labels", [(i, 1, 0) for i in range(0, 40)], "doc_id long, quality int, toxic int")
    write(spark, tmp_path, "benchmark", [(1, item)], "item_id long, text string")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r.doc_id for r in docs.collect()})
    everyone = set(range(len(texts)))
    assert seen[0] >= everyone - {66} - {62, 63}
    # Two spaces at the end become one, so row 61 is another text; it falls as a near copy.
    assert 60 not in seen[1] and seen[1] >= {*range(60), 61}
    sets = {i: ngram_join.shingles((texts[i] or "").encode(), 5) for i in seen[1]}
    want = {i for i in seen[1] if not any(j < i and ngram_join.linked(sets[i], sets[j], 80, 100) for j in seen[1])}
    assert seen[2] == want and 62 not in want
    assert seen[3] == seen[2] - {63}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == seen[3]
    assert exact_dedup.normalise(b"a  b") == b"a b"
