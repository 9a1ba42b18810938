"""Compression classifier for text quality.

Two zstandard dictionaries are trained, one from good and one from bad labelled text. A text is cut into
pieces of PIECE bytes, all of which are compressed with either dictionary; the difference of the two sizes over
the text's own size, and nothing else, goes through a logistic calibration. Dictionaries learn from one half of
the labelled sample and the calibration from the other.

The sample is bounded: `learning.MAX_PER_CLASS` rows and MAX_PIECES pieces of either class for the
dictionaries. Null and empty texts are scored as such. Labels, language, source and id never enter a score.
Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import learning
from .common import map_arrow, map_texts, materialise, utf8

PIECE = 384
MAX_PIECES = 16_000
DICT_BYTES = 512 << 10
LEVEL = 3


def pieces(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)]


def train(samples: list[bytes]) -> bytes:
    """A dictionary; plain content where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICT_BYTES:] or b"\x00" * 8


class Compressors:
    """One compressor per dictionary; made anew in each Python worker."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.dictionaries = good, bad
        made = []
        for raw in self.dictionaries:
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))
        self.good, self.bad = made

    def __reduce__(self):
        return Compressors, self.dictionaries

    def difference(self, text: bytes) -> float:
        """How many bytes the good dictionary saves against the bad one, for each byte of the text."""
        cut = pieces(text)
        good, bad = (sum(len(c.compress(p)) for p in cut) for c in (self.good, self.bad))
        return (bad - good) / (len(text) + 16)


class Model:
    def __init__(self, compressors: Compressors, weights: np.ndarray) -> None:
        self.compressors, self.weights = compressors, weights

    def scores(self, texts: list[bytes]) -> list[float]:
        if not texts:
            return []
        return learning.logistic(np.array([[self.compressors.difference(t)] for t in texts]), self.weights).tolist()


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, per_class: int = learning.MAX_PER_CLASS) -> Model:
    """Learn from labelled rows outside the held-out fold; without labels of both classes every score is the share of label 1."""
    sample = materialise(learning.sample(docs, labels, "quality", folds, fold, per_class).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))), "sample")
    spark = docs.sparkSession

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, parts = [], []
            for y, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                for part in pieces(text):
                    labels.append(y)
                    parts.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(parts, pa.binary())], names=["label", "piece"])

    parts = map_arrow(sample.filter("half = 0").select("label", "text"), cut, "label int, piece binary")
    by = [[bytes(r["piece"]) for r in parts.filter(F.col("label") == y).orderBy(F.xxhash64("piece")).limit(MAX_PIECES).collect()] for y in (0, 1)]
    compressors = Compressors(train(by[1]), train(by[0]))
    sent = spark.sparkContext.broadcast(compressors)  # two dictionaries of DICT_BYTES

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sent.value.difference(t) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(rows, pa.float64())], names=["label", "x"])

    rows = map_arrow(sample.filter("half = 1").select("label", "text"), run, "label int, x double").collect()  # per_class rows a class at most
    share = learning.share(labels, "quality", folds, fold)
    y = np.array([r[0] for r in rows], float)
    x = np.array([r[1] for r in rows]).reshape(-1, 1)
    return Model(compressors, learning.fit_logistic(x, y, 1e-4, float(share or 0.5) if len(y) and 0 < y.mean() < 1 else None))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, id_col, text_col, lambda ids, texts: {"doc_id": ids, "score": sent.value.scores(texts)}, "doc_id long, score double")
