"""No held-out label enters the quality model."""

import random

from pyspark.sql import functions as F

from corpusgraph.llm import learning, quality


def test_held_out_labels_change_nothing(spark):
    rng = random.Random(1)
    word = lambda a: "".join(rng.choice(a) for _ in range(6))
    rows = [(i, " ".join(word("abcdefgh" if (i % 2) ^ (rng.random() < 0.3) else "stuvwxyz") for _ in range(60)), i % 2) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    held = learning.held_out("doc_id", 4, 2)
    fits = [quality.fit(docs, labels.withColumn("quality", F.when(held, F.lit(y)).otherwise(F.col("quality")))).weights.tolist() for y in (0, 1)]
    assert fits[0] == fits[1]
