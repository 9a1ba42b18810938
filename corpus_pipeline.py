"""A training-data pipeline: each stage works on all that the stage before it kept.

Stages take (spark, docs, sf_dir) and return the rows of docs that stay, with the columns of docs; the last
one returns the encoded documents. `run` writes each stage's result as a table and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusgraph.llm import bpe, decontaminate, exact_dedup, ngram_join, registry, toxicity
from corpusgraph.llm.common import materialise, read

#: Documents scored below this stay.
TOXIC = 0.5
#: Near duplicates share 80 of 100 shingles of five words.
SHINGLE, NUM, DEN = 5, 80, 100


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), folds=5, fold=0)
    return toxicity.drop_toxic(docs, model, TOXIC)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near_duplicates(docs, SHINGLE, NUM, DEN)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, registry.bpe_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: The learned toxicity score and the tokenizer are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
