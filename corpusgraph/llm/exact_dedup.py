"""Exact deduplication by Grace hashing.

Equal texts are collapsed inside each map task first, so that a text that a third of all rows share reaches
the shuffle once per task and not once per row. The remaining records are dealt by a digest of the content.
Each receiving task runs a Grace hash: records enter an open-addressing table that compares complete
contents; once the table has used its memory, records of contents that it doesn't hold go to spill files by
further bits of their hash, and each file is then treated in the same way, as deep as needed.

Texts are equal when identical after each run of ASCII white space became one space; null counts as empty.
Of equal texts the row with the smallest doc_id stays; a null id is larger than any other. Rows that repeat
id and text are one document: all carry the same mark in `duplicate_groups`, and `drop_duplicates` keeps one.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, join_groups, map_arrow, map_texts, materialise, partitions, utf8

#: Bytes of contents that a table holds before it spills, and spill files per level.
TABLE_BYTES = 96 << 20
LOCAL_BYTES = 32 << 20
FANOUT = 16
SPACE = b" \t\n\x0b\x0c\r"


def normalise(text: bytes) -> bytes:
    """Each run of ASCII white space as one space (bytes.split knows the same six characters)."""
    words = text.split()
    if not words:
        return b" " if text else b""
    return b" " * (text[0] in SPACE) + b" ".join(words) + b" " * (text[-1] in SPACE)


class Table:
    """Open addressing with linear probing over complete contents."""

    def __init__(self) -> None:
        self.contents: list[bytes] = []
        self.hashes: list[int] = []
        self.values: list[list] = []
        self.used = 0
        self._size = 1 << 10
        self._slots = array("q", [-1]) * self._size

    def find(self, key: int, content: bytes) -> tuple[int, int]:
        """The entry of content or -1, and the slot where the probe ended."""
        mask, slots = self._size - 1, self._slots
        at = key & mask
        while (entry := slots[at]) >= 0:
            if self.hashes[entry] == key and self.contents[entry] == content:
                return entry, at
            at = (at + 1) & mask
        return -1, at

    def insert(self, key: int, content: bytes, value: list, slot: int) -> None:
        self._slots[slot] = len(self.contents)
        self.contents.append(content)
        self.hashes.append(key)
        self.values.append(value)
        self.used += len(content) + 200
        if 2 * len(self.contents) > self._size:
            self._size *= 4
            self._slots = array("q", [-1]) * self._size
            mask = self._size - 1
            for entry, other in enumerate(self.hashes):
                at = other & mask
                while self._slots[at] >= 0:
                    at = (at + 1) & mask
                self._slots[at] = entry


def first(a: list, b: list) -> list:
    """Of two [count, id, payload] the one with the smaller id, with both counts."""
    keep, other = (a, b) if b[1] is None or a[1] is not None and a[1] <= b[1] else (b, a)
    return [keep[0] + other[0], keep[1], keep[2]]


def grace(records: Iterable[tuple[bytes, list]], budget: int = TABLE_BYTES, depth: int = 0) -> Iterator[tuple[bytes, list]]:
    """Records (content, [count, id, payload]) with one row per content, in bounded memory.

    depth seeds the hash anew, so that a level's spill files divide what the level above put together.
    """
    table, files = Table(), None
    folder = None
    try:
        for content, value in records:
            key = xxhash.xxh3_64_intdigest(content, seed=depth)
            entry, slot = table.find(key, content)
            if entry >= 0:
                table.values[entry] = first(table.values[entry], value)
            elif files is None and (table.used < budget or not table.contents):
                table.insert(key, content, value, slot)
            else:
                if files is None:
                    folder = tempfile.TemporaryDirectory(prefix="grace-")
                    files = [open(f"{folder.name}/{i}", "w+b") for i in range(FANOUT)]
                pickle.dump((content, value), files[(key >> 48) % FANOUT], pickle.HIGHEST_PROTOCOL)
        yield from zip(table.contents, table.values, strict=True)
        del table
        for file in files or ():
            file.seek(0)
            yield from grace(_unspill(file), budget, depth + 1)
            file.truncate(0)
    finally:
        for file in files or ():
            file.close()
        if folder:
            folder.cleanup()


def _unspill(file) -> Iterator[tuple[bytes, list]]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _collapse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (id, text, count, bucket) per text and map task; the table is emptied when it is full."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("count", pa.int64()), ("bucket", pa.binary())])

    def flush(table: Table) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(table.contents), 2000):
            contents, values = table.contents[at : at + 2000], table.values[at : at + 2000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v[1] for v in values], pa.int64()), pa.array(contents, pa.binary()), pa.array([v[0] for v in values], pa.int64()), pa.array([hashlib.sha256(c).digest() for c in contents], pa.binary())], schema=schema
            )

    table = Table()
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            content = normalise(text)
            key = xxhash.xxh3_64_intdigest(content)
            entry, slot = table.find(key, content)
            if entry >= 0:
                table.values[entry] = first(table.values[entry], [1, doc, None])
            else:
                table.insert(key, content, [1, doc, None], slot)
                if table.used >= LOCAL_BYTES:
                    yield from flush(table)
                    table = Table()
    yield from flush(table)


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("sha", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])

    def records() -> Iterator[tuple[bytes, list]]:
        for batch in batches:
            for doc, content, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield content, [n, doc, None]

    rows = []
    for content, (n, doc, _) in grace(records()):
        rows.append((hashlib.sha256(content).digest(), doc, n))  # by which the members find their group
        if len(rows) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _members(ids: list, texts: list[bytes]) -> dict[str, list]:
    """The ids of each text in a batch, so that a frequent text is one row per batch in the join that follows."""
    found: dict[bytes, list] = {}
    for doc, text in zip(ids, texts, strict=True):
        found.setdefault(hashlib.sha256(normalise(text)).digest(), []).append(doc)
    return {"sha": list(found), "members": list(found.values())}


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    An empty table gives an empty result. Other columns of docs are not read.
    """
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    collapsed = map_arrow(two, _collapse, "doc_id long, text binary, count long, bucket binary")
    dealt = collapsed.repartition(partitions(docs.sparkSession), "bucket").select("doc_id", "text", "count")
    groups = materialise(map_arrow(dealt, _groups, "sha binary, keep_id long, group_size long"), "groups")
    members = materialise(map_texts(docs, id_col, text_col, _members, "sha binary, members array<long>"), "members")
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    return (
        join_groups(members, groups, "sha", "group_size", total)
        .select(F.explode("members").alias("doc_id"), "keep_id", "group_size", F.lower(F.hex("sha")).alias("text_sha256"))
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: the one with the smallest id of each text."""
    spark = docs.sparkSession
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names may repeat or clash
    id_at, text_at = names.index(id_col), names.index(text_col)
    ddl = ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes))
    out = arrow_schema(spark, ddl)
    local = arrow_schema(spark, ddl + ", bucket binary")

    def winners(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A text that the task has passed on goes again only with a smaller id; the table starts anew when it is full.
        table = Table()
        for batch in batches:
            took, marks = [], []
            for i, (doc, text) in enumerate(zip(batch.column(id_at).to_pylist(), utf8(batch.column(text_at)), strict=True)):
                content = normalise(text)
                key = xxhash.xxh3_64_intdigest(content)
                entry, slot = table.find(key, content)
                if entry < 0:
                    if table.used >= LOCAL_BYTES:
                        table = Table()
                        slot = table.find(key, content)[1]
                    table.insert(key, content, [1, doc, None], slot)
                elif first(table.values[entry], [1, doc, None])[1] == table.values[entry][1]:
                    continue
                else:
                    table.values[entry] = [1, doc, None]
                took.append(i)
                marks.append(hashlib.sha256(content).digest())
            rows = batch.take(pa.array(took, pa.int64()))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(rows.columns, out, strict=True)] + [pa.array(marks, pa.binary())], schema=local)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple[bytes, list]]:
            for batch in batches:
                for text, row in zip(utf8(batch.column(text_at)), batch.to_pylist(), strict=True):
                    yield normalise(text), [1, row[f"c{id_at}"], row]

        rows = []
        for _, value in grace(records(), TABLE_BYTES // 2):
            rows.append(value[2])
            if len(rows) == 500:
                yield pa.RecordBatch.from_pylist(rows, schema=out)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    sent = map_arrow(plain, winners, ddl + ", bucket binary").repartition(partitions(spark), "bucket").drop("bucket")
    return map_arrow(sent, keep, ddl).toDF(*names)
