"""The quality score of a fitted model, written out plainly."""

import math
import random

import zstandard

from corpusgraph.llm import quality


def plain_score(text, dictionaries, weights):
    raw = (text or "").encode()
    sizes = []
    for d in dictionaries:
        compressor = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), level=quality.LEVEL, write_content_size=False, write_dict_id=False)
        sizes.append(sum(len(compressor.compress(raw[i : i + quality.PIECE])) for i in range(0, len(raw), quality.PIECE)))
    x = (sizes[1] - sizes[0]) / (len(raw) + 16)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, weights[1] + weights[0] * x))))


def test_scores_of_odd_rows_equal_the_plain_ones(spark):
    rng = random.Random(4)
    word = lambda a: "".join(rng.choice(a) for _ in range(6))
    rows = [(i, " ".join(word("abcdefgh" if i % 2 else "stuvwxyz") for _ in range(120)), i % 2) for i in range(160)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(500, None), (501, ""), (None, rows[1][1]), (3, rows[3][1]), (502, "abc " * 30_000), (503, "é漢 🎉")], "doc_id long, text string").selectExpr("*", "1 AS score", "'x' AS label")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(1, None), (None, 1), (2, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = sorted(((r.doc_id, round(r.score, 9)) for r in quality.score(docs, model).collect()), key=repr)
    want = sorted(((r.doc_id, round(plain_score(r.text, model.compressors.dictionaries, model.weights), 9)) for r in docs.collect()), key=repr)
    assert got == want and len(got) == 166
    held = [(s, i % 2) for i, s in got if i is not None and i < 160]
    assert sum((s >= 0.5) == bool(y) for s, y in held) > 0.95 * len(held)
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.score(docs, quality.fit(docs, labels.limit(0))).count() == 166
