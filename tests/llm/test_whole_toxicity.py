"""The toxicity sample keeps the classes' ratio."""

import random

from corpusgraph.llm import toxicity


def labelled(spark, toxic_every):
    """Texts whose insults agree with the labels only mostly, so that the fit stays undecided."""
    rng = random.Random(5)
    rows = []
    for i in range(600):
        bad = i % toxic_every == 0
        insult = rng.random() < (0.7 if bad else 0.15)
        rows.append((i, " ".join(rng.choice("river stone cloud table window garden".split()) for _ in range(20)) + (". you stupid idiot." if insult else "."), int(bad)))
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2], r[2]) for r in rows], "doc_id long, toxic int, quality int")


def test_toxicity_keeps_the_class_ratio_when_the_sample_is_cut(spark):
    docs, labels = labelled(spark, 10)
    mean = lambda per_class: toxicity.score(docs, toxicity.fit(docs, labels, per_class=per_class)).agg({"score": "avg"}).first()[0]
    whole, cut = mean(1000), mean(40)
    assert abs(whole - 0.1) < 0.03 and abs(cut - whole) < 0.06
