"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised alike on both sides: A-Z in lower case, words of digits, letters and all characters
outside ASCII, one space between words and at both ends. The automaton holds every window of consecutive
words of the questions and answers (an item with fewer words is one window), and each document is scanned
once. A match gives word positions; `spans` maps them back to character offsets of the original text.

The windows are broadcast, in blocks of BLOCK_WINDOWS windows and BLOCK_BYTES bytes at most. For a question set
beyond one block the hits so far are written before the next block is scanned, and then united with its hits, so
that a worker holds one automaton at any time.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, held, map_arrow, materialise, utf8

WINDOW = 13
BLOCK_WINDOWS = 200_000
BLOCK_BYTES = 32 << 20

#: Bytes of a UTF-8 text to normalised bytes: what is no part of a word becomes a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def windows_of(text: bytes, size: int) -> list[bytes]:
    words = words_of(text)
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(max(1, len(words) - size + 1))] if words else []


def blocks(items: DataFrame, id_col: str, text_col: str, size: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """The windows of all items as (item_id, window) in blocks of bounded size; one block is held at a time."""
    block, used = [], 0
    for item, text in items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator():
        for window in windows_of((text or "").encode(), size):
            if block and (len(block) >= BLOCK_WINDOWS or used + len(window) > BLOCK_BYTES):
                yield block
                block, used = [], 0
            block.append((item, window))
            used += len(window)
    if block:
        yield block


def _automaton(block: list[tuple[int | None, bytes]]) -> ahocorasick.Automaton:
    """Its values are (number of words, item ids)."""
    found: dict[bytes, tuple[int, set]] = {}
    for item, window in block:
        found.setdefault(window, (window.count(b" ") - 1, set()))[1].add(item)
    made = ahocorasick.Automaton()
    for window, value in found.items():
        made.add_word(window.decode("latin-1"), value)
    if found:
        made.make_automaton()
    return made


def scan(automaton: ahocorasick.Automaton, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
    """Matched word ranges (from, to), merged and in order, and the items whose windows occur."""
    if not words or not len(automaton):
        return [], set()
    norm = b" " + b" ".join(words) + b" "
    ends, items = [], set()
    for at, (n, of) in automaton.iter(norm.decode("latin-1")):
        ends.append((at, n))
        items |= of
    ranges: list[tuple[int, int]] = []
    last, count = 0, 0
    for at, n in sorted(ends):
        count += norm.count(b" ", last, at)  # words that end before this space
        last = at
        ranges.append((count - n, count))
    return merge(ranges), items


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def offsets(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as character offsets of the original text, end exclusive."""
    if not ranges:
        return []
    places = [m.span() for m in _WORD.finditer(text.decode(errors="replace"))]
    return [(places[a][0], places[b - 1][1]) for a, b in ranges]


def find_contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """docs with a further struct column `contamination`: n_words, n_hit, items (sorted ids), spans, word_spans.

    Null and empty texts have no words and no hits; items without words match nothing; an item without an id
    marks words but is not listed. If docs has a column of that name already, the new one comes after it.
    """
    spark = docs.sparkSession
    names = docs.columns
    text_at = names.index(text_col)
    ddl = ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes))
    hit = "n_words long, n_hit long, items array<long>, spans array<struct<start:int,end:int>>, word_spans array<struct<start:int,end:int>>"
    out = arrow_schema(spark, f"{ddl}, hit struct<{hit.replace(' long', ':bigint').replace(' array', ':array').replace(', ', ',')}>")
    df = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def add(df: DataFrame, block: list[tuple[int | None, bytes]], more: bool) -> DataFrame:
        sent, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = held(__name__, key, lambda: _automaton(sent.value))
            for batch in batches:
                before = batch.column(len(names)).to_pylist() if more else None
                made = []
                for i, text in enumerate(utf8(batch.column(text_at))):
                    words = words_of(text)
                    ranges, of = scan(automaton, words)
                    if more:
                        of |= set(before[i]["items"])
                        ranges = merge([*ranges, *((x["start"], x["end"]) for x in before[i]["word_spans"])])
                    made.append(
                        {"n_words": len(words), "n_hit": sum(b - a for a, b in ranges), "items": sorted(x for x in of if x is not None), "spans": [{"start": a, "end": b} for a, b in offsets(text, ranges)], "word_spans": [{"start": a, "end": b} for a, b in ranges]}
                    )
                kept = [c.cast(f.type) for c, f in zip(batch.columns[: len(names)], out, strict=False)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(made, out[-1].type)], schema=out)

        return map_arrow(df, run, f"{ddl}, hit struct<{hit.replace(' long', ':bigint').replace(' array', ':array').replace(', ', ',')}>")

    done = 0
    for block in blocks(items, item_id, item_text, size):
        df, done = add(materialise(df, "hits") if done else df, block, done > 0), done + 1
    if not done:
        df = add(df, [], False)
    return df.toDF(*names, "contamination")


def items_sha256(ids: F.Column) -> F.Column:
    """SHA-256 of the ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform(ids, lambda x: x.cast("string"))), ","), 256)


def is_contaminated(n_hit: F.Column, n_words: F.Column, share: int = 20) -> F.Column:
    """At least 1/share of the words lie in windows of the benchmark."""
    return (n_hit > 0) & (share * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without contaminated rows, with the same columns."""
    names = docs.columns
    found = find_contamination(docs, items, text_col).toDF(*[f"c{i}" for i in range(len(names))], "hit")
    return found.filter(~is_contaminated(F.col("hit.n_hit"), F.col("hit.n_words"))).drop("hit").toDF(*names)


