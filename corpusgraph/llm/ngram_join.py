"""N-gram Jaccard self-join: classes of documents whose sets of word shingles overlap.

Two documents link when den * |A n B| >= num * |A u B| over their distinct k-word shingles (hashed to 64 bits
for candidates, compared as words in the last step). The result is the connected components of the links.

1. *Sketch* (one pass over the texts). Sets of more than SHORT shingles: hashes fall into ranges of the hash space. A link allows a
   symmetric difference of at most D shingles, so of D + 1 + e ranges at least 1 + e are untouched, and equal
   on both sides. Each document emits one key per range: the sum of the range's mixed hashes. Ranges without
   shingles emit nothing, save for documents with more than e of them. So no link is lost, and only documents
   that agree in a whole range meet. Shingles that many documents share, by a sample, are left out of all ranges:
   the rest of two linked sets differs no more than the whole. Short sets, whose ranges would be too alike, meet by prefixes instead: with
   shingles in order of frequency among short sets, linked sets share one of their first n - ceil(num n / den) + 1.
   The sketch also holds GROUPS group counts (more for long documents), the document's point.
2. *Blocks*: the documents of one key. Copies of one set, and keys seen before in the same batch, are
   collapsed before the shuffle. Each document is compared with the smallest document of its blocks: first by
   summed coordinate minima, which bound the overlap from above, then by their texts.
3. *R-tree*: blocks that still hold several components are searched exhaustively. The points of a block form
   an R-tree, packed by size and counts; every document outside the block's largest component descends into
   those nodes whose summed minima allow a link. Large blocks are dealt as tiles of CHUNK x CHUNK documents.
   Before that, in blocks of several tiles, each document looks for its likeliest partner in one tile only, NEAR_SCOUTS
   times, so that a large group of near copies becomes one component in linear work. In the first SCOUTS searches of
   all tiles each document names its likeliest pair only; their links join most of the components that are left, and
   the last search takes every pair still apart. All these are verified by their texts.
4. Components: contraction to the neighbour of least hash, round by round, until no edge is left.

A document without words has no shingles and links with nothing; with fewer than k words the whole sequence
is its one shingle; null text is empty text. Rows without an id link with nothing and have no component.
Rows that repeat an id are one node with several texts: it links by any of them. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, join_groups, map_arrow, map_texts, materialise, partitions, utf8

#: A document's point has GROUPS coordinates; long ones get more, up to MOST_GROUPS, and are summed to GROUPS in the tree.
GROUPS, MOST_GROUPS = 256, 2048
#: The tree's nodes use sums of groups.
COARSE = 32
#: Keys that a task remembers because it met them in several documents.
REMEMBERED = 200_000
CHUNK = 2048
#: Shingles in COMMON_SHARE of about SAMPLE sampled documents are left out of ranges: at most MOST_COMMON.
SAMPLE, COMMON_SHARE, MOST_COMMON = 4000, 0.005, 50_000
LEAF = 32
#: Sets of at most so many shingles meet by prefixes; so do those that link with one.
SHORT = 64
SCOUTS = 1
#: Before that, documents of blocks of several tiles look for a partner in one tile each, so often.
NEAR_SCOUTS = 1
#: Upper ends of the size bands grow by this factor.
BAND = 1.5

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240517))
_BYTE = _RNG.integers(1, 2**64, 256, dtype=_U)
_STEP = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = np.ones(1, _U), np.ones(1, _U)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _steps(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _STEP and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        _powers = tuple(np.cumprod(np.concatenate([np.ones(1, _U), np.full(size, s, _U)]), dtype=_U) for s in (_STEP, _INVERSE))
    return _powers


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a UTF-8 text."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.empty(0, _U)
    b = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
    up, down = _steps(len(b) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[b] * up[: len(b)], dtype=_U)])
    h = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))
    size = min(k, len(words))
    out = np.zeros(len(words) - size + 1, _U)
    for i in range(size):
        out = out * _U(0xD1342543DE82EF95) + h[i : i + len(out)]
    return np.unique(mix(out + _U(size)))


def shingles(text: bytes, k: int) -> set[tuple[bytes, ...]]:
    words = text.translate(_LOWER).split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def linked(a: set, b: set, num: int, den: int) -> bool:
    both = len(a & b)
    return both > 0 and den * both >= num * (len(a) + len(b) - both)


def bands(n: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """For a set of n: (band, ranges, spare ranges) of its own band and of each that its partners may be in."""
    lo, k, out = 1, 0, []
    while den * n >= num * lo:
        hi = max(lo + 1, int(np.ceil(lo * BAND)))
        if n < hi:
            differ = 2 * (hi - 1) * (den - num) // (den + num)
            if differ:  # else only equal sets link
                spare = 6 + differ // 8
                out.append((k, differ + 1 + spare, spare))
        lo, k = hi, k + 1
    return out


def range_keys(hashes: np.ndarray, num: int, den: int, common: np.ndarray) -> np.ndarray:
    """The keys of a document's ranges of the hash space, over all its bands; common shingles are left out of the ranges."""
    n = len(hashes)
    if len(common):
        hashes = hashes[common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] != hashes]
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(hashes ^ _U(0x5851F42D4C957F2D)), dtype=_U)])
    out = []
    for band, ranges, spare in bands(n, num, den):
        cuts = np.searchsorted(hashes, np.arange(ranges, dtype=_U) * _U(2**64 // ranges))
        cuts = np.append(cuts, len(hashes))
        keys = mix((sums[cuts[1:]] - sums[cuts[:-1]]) + mix(np.arange(ranges, dtype=_U) + _U(band << 32)))
        full = cuts[1:] > cuts[:-1]
        out.append(keys if ranges - full.sum() > spare else keys[full])
    return np.concatenate(out) if out else np.empty(0, _U)


def _sketch(k: int, num: int, den: int, common: Broadcast):
    """Per document: n, digest, vec; leads for the first with this set in the task, which also gives its keys and, apart
    from them, those that the task has met before, each with a document that gave it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        known, owners = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            if len(seen) > REMEMBERED:
                seen = set()
            n, digests, vecs, leads, keys, small = [], [], [], [], [], []
            none = np.empty(0, np.int64)
            for i in order:
                hashes = shingle_hashes(texts[i], k)
                n.append(len(hashes))
                if not len(hashes) or ids[i] is None:
                    digests.append(None)
                    vecs.append(None)
                    leads.append(False)
                else:
                    digests.append(digest := hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                    vecs.append(point_bytes(hashes))
                    leads.append(digest not in seen)
                    seen.add(digest)
                keys.append(range_keys(hashes, num, den, common.value).view(np.int64) if leads[-1] and len(hashes) > SHORT else none)
                small.append(hashes.view(np.int64) if leads[-1] and num * len(hashes) <= den * SHORT else none)
            docs = np.array([ids[i] or 0 for i in order], np.int64)
            row = np.repeat(np.arange(len(order)), [len(x) for x in keys])
            key = np.concatenate([none, *keys])
            distinct, at, which, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            owner, fresh = docs[row[at]] if len(at) else none, np.ones(len(distinct), bool)
            if len(known):
                place = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
                fresh = known[place] != distinct
                owner = np.where(fresh, owner, owners[place])
            new = fresh[which] & (at[which] == np.arange(len(key)))
            again = fresh & (times > 1)
            if len(known) + again.sum() > REMEMBERED:
                known, owners = none, none
            known, owners = np.concatenate([known, distinct[again]]), np.concatenate([owners, owner[again]])
            sort = np.argsort(known)
            known, owners = known[sort], owners[sort]
            met = pa.StructArray.from_arrays([pa.array(key[~new]), pa.array(owner[which][~new])], names=["key", "pivot"])
            lists = lambda rows, values: pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(len(order) + 1)), pa.int32()), values)
            of_small = np.repeat(np.arange(len(order)), [len(x) for x in small])
            arrays = [pa.array([ids[i] for i in order], pa.int64()), pa.array(n, pa.int32()), pa.array(digests, pa.binary()), pa.array(vecs, pa.binary()), pa.array(leads)]
            yield pa.RecordBatch.from_arrays([*arrays, lists(row[new], pa.array(key[new])), lists(row[~new], met), lists(of_small, pa.array(np.concatenate([none, *small])))], names=["doc_id", "n", "digest", "vec", "leads", "keys", "met", "small"])

    return run


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, doc_id) in order: those of keys with two documents or more, with the key's smallest document."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("pivot", pa.int64())])
    key = pivot = None
    for batch in batches:
        keys, docs = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:2])
        if not len(keys):
            continue
        begins = np.flatnonzero(np.concatenate([[key is None or keys[0] != key], keys[1:] != keys[:-1]]))
        if not len(begins) or begins[0]:
            starts, pivots = np.concatenate([[0], begins]), np.concatenate([[pivot], docs[begins]])
        else:
            starts, pivots = begins, docs[begins]
        pivots = np.repeat(pivots, np.diff(np.append(starts, len(keys)))).astype(np.int64)
        other = docs != pivots
        key, pivot = keys[-1], pivots[-1]
        yield pa.RecordBatch.from_arrays([pa.array(x[other], pa.int64()) for x in (keys, docs, pivots)], schema=schema)


def _verify(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) whose texts link."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    if ids.count() <= BROADCAST_KEYS:  # counted: 16 MB at most
        ids = F.broadcast(ids)
    texts = materialise(docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), "texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, have = None, np.empty(0, _U)
        for batch in batches:
            found: tuple[list, list] = ([], [])
            for a, b, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), utf8(batch.column(3)), strict=True):
                if last != tb:
                    last, have = tb, shingle_hashes(tb, k)
                mine = shingle_hashes(ta, k)
                both = len(np.intersect1d(mine, have, assume_unique=True))
                # Equal shingles have equal hashes, so what fails here can't link.
                if den * both >= num * (len(mine) + len(have) - both) and linked(shingles(ta, k), shingles(tb, k), num, den):
                    found[0].append(a)
                    found[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

    return map_arrow(both.select("a", "b", "ta", "tb"), run, "a long, b long").distinct()


def point_bytes(hashes: np.ndarray) -> bytes:
    """The group counts of a document: a byte for the width of a count, then the counts. Groups are ranges of the hash space."""
    groups = GROUPS
    while groups < MOST_GROUPS and groups * 16 < len(hashes):
        groups *= 2
    counts = np.diff(np.searchsorted(hashes, np.arange(1, groups, dtype=_U) * _U(2**64 // groups)), prepend=0, append=len(hashes))
    return b"\x01" + counts.astype("u1").tobytes() if counts.max() < 256 else b"\x04" + counts.astype("<u4").tobytes()


def point_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "u1" if raw[0] == 1 else "<u4", offset=1).astype(np.int32)


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    return point if len(point) == groups else point.reshape(groups, -1).sum(axis=1)


def overlap_bound(a: np.ndarray, b: np.ndarray) -> int:
    """Summed coordinate minima, in the finest groups that both points have."""
    groups = min(len(a), len(b))
    return int(np.minimum(folded(a, groups), folded(b, groups)).sum())


class RTree:
    """Points packed bottom-up: sorted by size, then by their counts, LEAF to a node; a node keeps the largest counts, and the least and largest size."""

    def __init__(self, points: list[np.ndarray]) -> None:
        level = np.array([folded(p, GROUPS) for p in points])
        sizes = level.sum(axis=1)
        coarse = level.reshape(len(level), COARSE, -1).sum(axis=2)
        self.order = np.lexsort((*coarse.T[:4], sizes)) if len(points) > LEAF else np.arange(len(points))
        self.points = [points[i] for i in self.order]
        self.level, self.coarse, self.sizes = level[self.order], coarse[self.order], sizes[self.order]
        self.levels = []
        top, low, high = self.coarse, self.sizes, self.sizes
        while True:
            cuts = np.arange(0, len(top), LEAF)
            top, low, high = np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((top, low, high))
            if len(top) <= LEAF:
                break

    def search(self, point: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (of the points given) whose summed minima with point allow a link, and those sums."""
        size, level = point.sum(), folded(point, GROUPS)
        coarse = level.reshape(COARSE, -1).sum(axis=1)
        nodes = np.arange(len(self.levels[-1][0]))
        for top, low, high in self.levels[::-1]:
            nodes = nodes[nodes < len(top)]
            bound = np.minimum(top[nodes], coarse).sum(axis=1)
            fits = ((num + den) * bound >= num * (size + low[nodes])) & (den * size >= num * low[nodes]) & (den * high[nodes] >= num * size)
            nodes = (nodes[fits][:, None] * LEAF + np.arange(LEAF)).ravel()
        nodes = nodes[nodes < len(self.points)]
        for of, mine in ((self.coarse, coarse), (self.level, level)):
            bound = np.minimum(of[nodes], mine).sum(axis=1)
            fits = (num + den) * bound >= num * (size + self.sizes[nodes])
            nodes, bound = nodes[fits], bound[fits]
        if len(point) > GROUPS and len(nodes):
            bound = np.array([overlap_bound(self.points[i], point) for i in nodes])
            fits = (num + den) * bound >= num * (size + self.sizes[nodes])
            nodes, bound = nodes[fits], bound[fits]
        return self.order[nodes], bound


def tile_pairs(doc: np.ndarray, comp: np.ndarray, asks: np.ndarray, vec: list[bytes], num: int, den: int, best: bool) -> tuple[list[int], list[int], bool]:
    """Pairs of a tile that may link and have different components; best: for each asking document only the likeliest.

    The third value says if a document had more than that one.
    """
    there, ask = np.flatnonzero(~asks), np.flatnonzero(asks)
    a, b, more = [], [], False
    if len(there) and len(ask):
        points = {i: point_of(vec[i]) for i in range(len(vec))}
        tree = RTree([points[i] for i in there])
        for i in ask:
            hits, bound = tree.search(points[i], num, den)
            hits = there[hits]
            other = comp[hits] != comp[i]
            hits, bound = hits[other], bound[other]
            if best and len(hits) > 1:
                hits, more = hits[[np.argmax(bound)]], True
            a += np.maximum(doc[hits], doc[i]).tolist()
            b += np.minimum(doc[hits], doc[i]).tolist()
    return a, b, more


def _tree_pairs(num: int, den: int, best: bool):
    """Rows (key, x, y, doc_id, comp, asks, vec), sorted by tile, to the pairs (a, b) of each tile, with its key where more are left; a tile has few rows and may go on in the next batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None

        def work(table: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
            tile = np.stack([table.column(c).to_numpy() for c in ("key", "x", "y")])
            starts = np.flatnonzero(np.concatenate([[True], (tile[:, 1:] != tile[:, :-1]).any(axis=0)])) if table.num_rows else np.empty(0, np.int64)
            ends = np.append(starts[1:], table.num_rows)
            if not last and len(starts):
                starts, ends, rest = starts[:-1], ends[:-1], table.slice(starts[-1])
            else:
                rest = table.slice(table.num_rows)
            doc, comp, asks = (table.column(c).to_numpy() for c in ("doc_id", "comp", "asks"))
            vec = table.column("vec").to_pylist()
            a, b, again = [], [], []
            for s, e in zip(starts, ends, strict=True):
                found = tile_pairs(doc[s:e], comp[s:e], asks[s:e], vec[s:e], num, den, best)
                a += found[0]
                b += found[1]
                again += [tile[0, s] if found[2] else None] * len(found[0])
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, again)], names=["a", "b", "again"]), rest

        for batch in batches:
            table = pa.Table.from_batches([batch])
            out, left = work(pa.concat_tables([left, table]) if left is not None else table, False)
            yield out
        if left is not None and left.num_rows:
            yield work(left, True)[0]

    return run


def _may_link(num: int, den: int):
    """Pairs (a, b, va, vb) whose summed minima allow a link."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = []
            for va, vb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = point_of(va), point_of(vb)
                fits.append(bool((num + den) * overlap_bound(x, y) >= num * (x.sum() + y.sum())))
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    return run


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, comp) of all nodes of the edges (a, b); comp is the smallest node of the component.

    Each round maps a node to the neighbour (or itself) of least hash and contracts the edges by this map.
    """
    edges = materialise(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    ends = edges.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    label = ends.select("doc_id", F.col("doc_id").alias("at"))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        to = materialise(both.select(F.col("a").alias("at"), order("a").alias("own"), order("b").alias("m")).groupBy("at", "own").agg(F.min("m").alias("m")).select("at", F.least("own", "m")["id"].alias("to")), "to")
        label = materialise(label.join(to, "at", "left").select("doc_id", F.coalesce("to", "at").alias("at")), "label")
        moved = edges.join(to.select(F.col("at").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("at").alias("b"), F.col("to").alias("y")), "b")
        edges = materialise(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    least = label.groupBy("at").agg(F.min("doc_id").alias("comp"), F.count("*").alias("members"))
    return label.join(least, "at").select("doc_id", "comp")


def similarity_classes(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    common = spark.sparkContext.broadcast(_common(docs, k))  # MOST_COMMON hashes at most
    sketch = materialise(map_arrow(docs, _sketch(k, num, den, common), "doc_id long, n int, digest binary, vec binary, leads boolean, keys array<bigint>, met array<struct<key:bigint,pivot:bigint>>, small array<bigint>"), "sketch")
    total = sketch.count()
    known = sketch.filter("digest IS NOT NULL")
    classes = materialise(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")

    short = _prefixes(known.filter("size(small) > 0").select("doc_id", "digest", "small"), num, den)
    rows = known.select(F.explode("keys").alias("key"), "doc_id").unionByName(short).repartition(partitions(spark), "key").sortWithinPartitions("key", "doc_id")
    met = known.select("doc_id", F.explode("met").alias("m")).select(F.col("m.key").alias("key"), "doc_id", F.col("m.pivot").alias("pivot"))
    blocks = materialise(map_arrow(rows, _runs, "key long, doc_id long, pivot long").unionByName(met), "blocks")

    firsts = known.filter("leads").select("doc_id", "digest", "vec").dropDuplicates(["doc_id", "digest"])
    pairs = blocks.groupBy("doc_id").agg(F.min("pivot").alias("pivot"))
    other = firsts.toDF("pivot", "digest_b", "vec_b")
    pairs = materialise(pairs.join(firsts, "doc_id").join(other, "pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b"), "vec", "vec_b", F.expr("digest = digest_b").alias("equal")), "pairs")
    same = firsts.join(classes, "digest").filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    star = _verify(map_arrow(pairs.filter("NOT equal").select("a", "b", "vec", "vec_b"), _may_link(num, den), "a long, b long"), docs, k, num, den)
    edges = materialise(star.unionByName(pairs.filter("equal").select("a", "b")).unionByName(same), "links")

    # Blocks with the same documents are searched once.
    members = blocks.select("key", "doc_id").unionByName(blocks.select("key", F.col("pivot").alias("doc_id"))).distinct()
    marks = members.groupBy("key").agg(F.count("*").alias("docs"), F.bit_xor(F.xxhash64("doc_id")).alias("m1"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("m2"))
    chosen = materialise(marks.groupBy("docs", "m1", "m2").agg(F.min("key").alias("key")), "chosen")
    members = materialise(join_groups(members, chosen.select("key", "docs"), "key", "docs", chosen.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]).select("key", "doc_id"), "members")
    for near in range(NEAR_SCOUTS):
        found = _search(members, components(edges), firsts, num, den, True, near)
        if found is None or found.isEmpty():
            break
        edges = materialise(edges.unionByName(_verify(found.select("a", "b").distinct(), docs, k, num, den)), "links")
    for best in (True,) * SCOUTS + (False,):
        found = _search(members, components(edges), firsts, num, den, best)
        if found is not None:
            edges = materialise(edges.unionByName(_verify(found.select("a", "b").distinct(), docs, k, num, den)), "links")
            # Components only grow, so pairs still apart were among the hits of these blocks before.
            members = members.join(found.filter("again IS NOT NULL").select(F.col("again").alias("key")).distinct(), "key", "left_semi")
    return _result(sketch, classes, components(edges), total)


def _common(docs: DataFrame, k: int) -> np.ndarray:
    """Sorted hashes of shingles that many documents share, from a sample. The choice bears on speed alone: any set gives the same links."""
    total = docs.count()
    every = max(1, total // SAMPLE)
    some = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(every)) == 0)

    def hashes(ids: list, texts: list[bytes]) -> dict[str, list]:
        return {"h": [x for t in texts for x in shingle_hashes(t, k).view(np.int64).tolist()]}

    counts = map_texts(some, "doc_id", "text", hashes, "h bigint").groupBy("h").agg(F.count("*").alias("n"))
    least = max(3.0, COMMON_SHARE * total / every)
    rows = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(MOST_COMMON).select("h").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(_U))


def _prefixes(short: DataFrame, num: int, den: int) -> DataFrame:
    """(key, doc_id): the rarest shingles of each short set, as many as linked sets need to share one; those of one set alone are left out."""
    rows = materialise(short.select("doc_id", "digest", F.explode("small").alias("key")), "short")
    often = rows.groupBy("key").agg(F.count("*").alias("df"))
    ranked = join_groups(rows, often, "key", "df", rows.count())
    of = ranked.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("all"))  # SHORT * den / num at most
    n = F.size("all")
    first = F.slice("all", F.lit(1), (n - F.ceil((n * num).cast("double") / F.lit(float(den))) + 1).cast("int"))
    return of.select("doc_id", F.explode(first).alias("x")).filter("x.df > 1").select(F.xxhash64("x.key", F.lit("prefix")).alias("key"), "doc_id")


def _search(members: DataFrame, comps: DataFrame, firsts: DataFrame, num: int, den: int, best: bool, near: int | None = None) -> DataFrame | None:
    """Pairs (a, b) of the same block and different components that may link; None if no block has several components.

    near: only blocks of several tiles, each document in one tile, by the number of this deal.
    """
    members = members.join(comps, "doc_id", "left").select("key", "doc_id", F.coalesce("comp", "doc_id").alias("comp"))
    sizes = members.groupBy("key", "comp").agg(F.count("*").alias("docs")).groupBy("key").agg(F.count("*").alias("comps"), F.sum("docs").alias("docs"), F.max_by("comp", F.struct("docs", "comp")).alias("main"), F.max("docs").alias("most")).filter("comps > 1")
    sizes = materialise(sizes.select("key", "main", "docs", F.expr(f"bigint(ceil(docs / {CHUNK}))").alias("chunks"), F.expr(f"bigint(ceil((docs - most) / {CHUNK}))").alias("ask_chunks")), "sizes")
    if near is not None:
        sizes = sizes.filter("chunks > 1")
    of_open = join_groups(members, sizes, "key", "docs", sizes.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]).drop("docs")
    open_ = materialise(of_open.join(firsts.select("doc_id", "vec"), "doc_id"), "open")
    if open_.isEmpty():
        return None
    deal = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n))
    there = open_.select("key", deal("chunks").alias("x"), F.explode(F.expr("sequence(0L, ask_chunks - 1L)")).alias("y"), "doc_id", "comp", "vec", F.lit(False).alias("asks"))
    ask = open_.filter("comp <> main").select("key", F.explode(F.expr("sequence(0L, chunks - 1L)")).alias("x"), deal("ask_chunks").alias("y"), "doc_id", "comp", "vec", F.lit(True).alias("asks"))
    if near is not None:
        tile = F.pmod(F.xxhash64("doc_id", F.lit(near)), F.col("chunks"))
        here = open_.select("key", tile.alias("x"), F.lit(0).cast("long").alias("y"), "doc_id", "comp", "vec", (F.col("comp") != F.col("main")).alias("asks"))
        there, ask = here.withColumn("asks", F.lit(False)), here.filter("asks")
    dealt = there.unionByName(ask).repartition(partitions(members.sparkSession), "key", "x", "y").sortWithinPartitions("key", "x", "y")
    tiles = map_arrow(dealt, _tree_pairs(num, den, best), "a long, b long, again long")
    return materialise(tiles.distinct(), "found")


def _result(sketch: DataFrame, classes: DataFrame, comps: DataFrame, total: int) -> DataFrame:
    """Copies follow their class; a class of one is its own component."""
    of = classes.join(comps.withColumnRenamed("doc_id", "rep"), "rep", "left").select("digest", "copies", F.coalesce("comp", "rep").alias("component_id"))
    rows = sketch.select("doc_id", "n", "digest")
    out = join_groups(rows.filter("digest IS NOT NULL"), of, "digest", "copies", total).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    lone = rows.filter("digest IS NULL").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(lone)


def drop_near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs of which each component keeps its smallest doc_id; rows without an id stay."""
    stay = similarity_classes(docs, k, num, den).filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(stay, "doc_id", "left_semi").unionByName(docs.filter("doc_id IS NULL"))
