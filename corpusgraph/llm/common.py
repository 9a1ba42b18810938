"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most this many keys can each hold a 1/HOT_SHARE part of all rows, so they may be broadcast.
HOT_SHARE = 1000
#: Most rows of a key list (8 bytes each) that is broadcast after its size was counted.
BROADCAST_KEYS = 2_000_000
#: Bytes of an Arrow batch, about; one text may be longer.
BATCH_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is configured, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: this cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts as UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: A-Z to a-z; every other ASCII character but letters and digits to a space. Bytes from 0x80 on belong to words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def word_bytes(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text, ASCII letters in lower case: runs of ASCII letters, digits and any other characters beyond ASCII."""
    return text.translate(_WORDS).split()


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lower_ascii(text: bytes) -> bytes:
    """A-Z in lower case, all else as it is, so that places stay the same."""
    return text.translate(_LOWER)


#: What a Python worker keeps from task to task, by (owner, key): one large object at a time.
_held: dict[tuple[str, str], object] = {}


def held(owner: str, key: str, make: Callable[[], object]) -> object:
    """make(), kept by the Python worker for its next tasks until another key, or a task of another owner, comes."""
    if (owner, key) not in _held:
        _held.clear()
        _held[owner, key] = make()
    return _held[owner, key]


def release(owner: str) -> None:
    """Drop what a worker that Spark reuses holds of other owners."""
    if any(of != owner for of, _ in _held):
        _held.clear()
        gc.collect()
        give_back()


def give_back() -> None:
    """Return freed memory to the system, where the C library has a call for that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, owner: str | None = None) -> DataFrame:
    """df.mapInArrow with batches of at most about BATCH_BYTES, so that neither side holds many long texts at once.

    The session keeps that bound; a smaller one that it has already is left as it is. Spark reuses Python workers for
    further stages, so a task first drops what other operators (owner: fn's module) hold, and gives back memory at its end.
    """
    owner = owner or fn.__module__
    spark = df.sparkSession
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgt]?)i?b?", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").lower()).groups()
    now = int(number) << 10 * " kmgt".index(unit or " ")
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(owner)
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def map_texts(df: DataFrame, id_col: str, text_col: str, fn: Callable[[list, list[bytes]], dict[str, list]], schema: str) -> DataFrame:
    """Run fn(ids, texts) on each Arrow batch of two columns; it returns the columns of schema.

    Only the two named columns are read, so further columns, whatever their names, don't matter.
    """
    spark = df.sparkSession
    out = arrow_schema(spark, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = fn(batch.column(0).to_pylist(), utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return map_arrow(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, schema, fn.__module__)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of rows to one row per key, where some keys may hold a large part of all rows.

    Keys with at least 1/HOT_SHARE of all rows number HOT_SHARE at most; their groups are broadcast, all
    others meet in a shuffled join in which no key is large.
    """
    hot = groups.filter(F.col(count) * HOT_SHARE >= total)
    cold = groups.filter(F.col(count) * HOT_SHARE < total)
    of_hot = rows.join(F.broadcast(hot), key)
    of_cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return of_hot.unionByName(of_cold)
