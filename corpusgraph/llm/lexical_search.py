"""The best documents for each of a set of text queries, by MaxScore with bounds for pairs of terms.

1. One scan of the texts writes, for each document, its length and the counts of those of its terms that some query
   asks for; document frequencies and lengths are summed from that table.
2. An index row per block of documents holds the block's postings with their impacts and, for pairs of terms that
   queries share, the intersection list (a bitmap of the block) with the largest joint impact.
3. Each task walks its blocks and keeps a running list of the best k for each query. Within a block, a query's terms
   are matched into pairs where the joint maximum lies below the sum of the two maxima; the units (pairs and single
   terms) of least bound that together can't reach the list's last score are only looked up for documents that the
   other units bring up, and only as long as a document's bound (by the bitmap: both terms, or at most one of them)
   can still reach it. The tasks' lists, k rows a query each, meet in a ranked window.

Queries are taken in blocks of bounded size, since their words are what tasks hold in memory. Skipping is by `less
than`, so ties are never lost: the result is that of scoring every document.

Defined results: a null or empty text has no terms, neither as a document (it counts nowhere) nor as a query (no
rows). Repeated documents are ranked each by itself; a null id ranks after all others of its score. Repeated queries
are answered each by itself. Empty tables give no rows. Other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialise, utf8, word_bytes

#: Documents of a block; postings of a block, about.
BLOCK_DOCS, BLOCK_POSTINGS = 4096, 500_000
#: Bytes of query text that are answered together, about (one query may be longer).
QUERY_BYTES = 2 << 20
#: Pairs of terms that get an intersection list, those shared by most queries first; a query offers pairs of this many of its commonest terms.
MAX_PAIRS, COMMONEST = 1024, 10
INDEX = "doc_ids binary, known binary, terms binary, starts binary, places binary, impacts binary, pairs binary, joint binary, both binary"


@dataclass(frozen=True)
class Queries:
    """Numbers of all terms, and the distinct terms of each query as numbers."""

    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]


def read_queries(rows: list[tuple[str | None]]) -> Queries:
    vocabulary: dict[bytes, int] = {}
    terms = [np.array(sorted({vocabulary.setdefault(w, len(vocabulary)) for w in word_bytes((text or "").encode())}), dtype=np.int64) for text in rows]
    return Queries(vocabulary, terms)


def forward(docs: DataFrame, doc_id: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of each document with a term: n of all its terms, the rest for those of the vocabulary."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, terms, counts = [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                words = word_bytes(t)
                if words:
                    of = [(vocabulary[w], c) for w, c in Counter(words).items() if w in vocabulary]
                    ids.append(i)
                    sizes.append(len(words))
                    terms.append([a for a, _ in of])
                    counts.append([c for _, c in of])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, ints), pa.array(counts, ints)], names=["doc_id", "n", "terms", "counts"])

    return map_arrow(docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")), run, "doc_id long, n long, terms array<int>, counts array<int>", __name__)


def frequencies(table: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term; one row a term reaches the driver, as many as the query block has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["term", "df"])

    out = np.zeros(size, dtype=np.int64)
    for row in map_arrow(table.select("terms"), run, "term int, df long", __name__).groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[row["term"]] = row["df"]
    return out


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)


def shared_pairs(queries: Queries, df: np.ndarray) -> np.ndarray:
    """The pairs of common terms that most queries share, as rows (a, b), a < b."""
    seen: Counter = Counter()
    for terms in queries.terms:
        common = sorted(terms[np.argsort(-df[terms], kind="stable")][:COMMONEST].tolist())
        seen.update((a, b) for i, a in enumerate(common) for b in common[i + 1 :])
    best = sorted(seen, key=lambda p: (-seen[p], p))[:MAX_PAIRS]
    return np.array(best, dtype=np.int64).reshape(-1, 2)


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """The whole numbers that a document's score adds up."""
    m = 10 + (90 * n * n_docs) // all_terms
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def build_block(ids: list, sizes: list, terms: list, counts: list, weight: np.ndarray, pairs: np.ndarray, n_docs: int, all_terms: int) -> list[bytes]:
    """The columns of INDEX for these documents."""
    paired = np.unique(pairs)
    of = np.searchsorted(paired, pairs)
    size = len(ids)
    place = np.repeat(np.arange(size, dtype=np.int32), [len(t) for t in terms])
    term, tf = (np.concatenate(x).astype(np.int64) for x in (terms, counts))
    impact = impacts(weight[term], tf, np.array(sizes, dtype=np.int64)[place], n_docs, all_terms)
    order = np.lexsort((place, term))
    term, place, impact = term[order], place[order], impact[order]
    present, starts = np.unique(term, return_index=True)
    starts = np.append(starts, len(term))
    dense = np.zeros((len(paired), size), dtype=np.int64)
    at = np.searchsorted(present, paired)
    for row, (i, t) in enumerate(zip(at, paired, strict=True)):
        if i < len(present) and present[i] == t:
            dense[row, place[starts[i] : starts[i + 1]]] = impact[starts[i] : starts[i + 1]] + 1  # present, even with impact 0
    kept, joint, both = [], [], []
    for p, (a, b) in enumerate(of):
        meet = (dense[a] > 0) & (dense[b] > 0)
        if meet.any():
            joint.append(int((dense[a] + dense[b])[meet].max()) - 2)
            both.append(np.packbits(meet))
            kept.append(p)
    known = np.array([i is not None for i in ids])
    arrays = [np.array([i or 0 for i in ids], dtype=np.int64), np.packbits(known), present, starts.astype(np.int64), place, impact, np.array(kept, dtype=np.int64), np.array(joint, dtype=np.int64), np.concatenate(both) if both else np.zeros(0, dtype=np.uint8)]
    return [a.tobytes() for a in arrays]


def index(table: DataFrame, weight: np.ndarray, pairs: np.ndarray, n_docs: int, all_terms: int) -> DataFrame:
    """INDEX: a row for each block of documents; numbers are written as bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in INDEX.split(", ")]
        held: list[list] = [[], [], [], []]
        postings = 0

        def flush() -> pa.RecordBatch:
            row = build_block(*held, weight, pairs, n_docs, all_terms)
            for x in held:
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in row], names=names)

        for batch in batches:
            lists = [np.split(c.flatten().to_numpy(zero_copy_only=False), np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))[:-1]) for c in (batch.column(2), batch.column(3))] if batch.num_rows else [[], []]
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *lists, strict=True):
                for x, v in zip(held, row, strict=True):
                    x.append(v)
                postings += len(row[2])
                if len(held[0]) == BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                    yield flush()
                    postings = 0
        if held[0]:
            yield flush()

    return map_arrow(table.filter(F.size("terms") > 0).select("doc_id", "n", "terms", "counts"), run, INDEX, __name__)


class Best:
    """A query's best k so far, ordered by falling score, then id, null ids last."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.id, self.known = k, *(np.zeros(0, dtype=t) for t in (np.int64, np.int64, bool))

    def last(self) -> int:
        """The score that a further document must reach."""
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        score, ids, known = np.append(self.score, score), np.append(self.id, ids), np.append(self.known, known)
        order = np.lexsort((ids, ~known, -score))[: self.k]
        self.score, self.id, self.known = score[order], ids[order], known[order]


class Block:
    """An index row, decoded."""

    def __init__(self, row: list[bytes]) -> None:
        as_ints = lambda b: np.frombuffer(b, dtype=np.int64)
        self.ids = as_ints(row[0])
        self.size = len(self.ids)
        self.known = np.unpackbits(np.frombuffer(row[1], dtype=np.uint8), count=self.size).astype(bool)
        self.terms, self.starts, self.impacts = as_ints(row[2]), as_ints(row[3]), as_ints(row[5])
        self.places = np.frombuffer(row[4], dtype=np.int32)
        self.most = np.maximum.reduceat(self.impacts, self.starts[:-1]) if len(self.terms) else np.zeros(0, dtype=np.int64)
        self.joint = dict(zip(as_ints(row[6]).tolist(), as_ints(row[7]).tolist(), strict=True))
        bits = np.frombuffer(row[8], dtype=np.uint8).reshape(-1, -(-self.size // 8))
        self.bits = dict(zip(self.joint, bits, strict=True))

    def postings(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.places[self.starts[i] : self.starts[i + 1]], self.impacts[self.starts[i] : self.starts[i + 1]]

    def search(self, terms: np.ndarray, offers: list[tuple[int, int, int]], best: Best) -> tuple[int, int]:
        """Add this block's documents to best; offers: (pair, place of one term in terms, place of the other). Returns (documents looked at, documents)."""
        at = np.searchsorted(self.terms, terms)
        here = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms)
        most = np.where(here, self.most[np.minimum(at, len(self.terms) - 1)], 0)
        threshold = best.last()
        free, essential = self._free(here, most, offers, threshold)
        bound = sum(limit for limit, _, _ in free)
        scores = np.zeros(self.size, dtype=np.int64)
        for i in essential:
            places, impact = self.postings(at[i])
            scores[places] += impact
        found = np.flatnonzero(scores)
        looked = len(found)
        for limit, pair, members in sorted(free, key=lambda u: -u[0]):
            found = found[scores[found] + bound >= threshold]
            bound -= limit
            if pair is not None and len(found):
                # Outside the intersection list a document holds at most one of the two.
                meets = (self.bits[pair][found >> 3] >> (7 - (found & 7))) & 1
                here_most = np.where(meets == 1, self.joint[pair], max(most[i] for i in members))
                found = found[scores[found] + bound + here_most >= threshold]
            for i in members if len(found) else ():
                places, impact = self.postings(at[i])
                to = np.minimum(np.searchsorted(places, found), len(places) - 1)
                scores[found] += np.where(places[to] == found, impact[to], 0)
        found = found[scores[found] >= threshold]
        best.add(scores[found], self.ids[found], self.known[found])
        return looked, self.size

    def _free(self, here: np.ndarray, most: np.ndarray, offers: list[tuple[int, int, int]], threshold: int) -> tuple[list[tuple[int, int | None, list[int]]], list[int]]:
        """The terms that together can't reach the threshold, as units (bound, pair or None, places of its terms), and the others.

        Terms come by rising maximum, as for independent bounds; each is matched with the free term with which it
        saves most, so the free set is never smaller than theirs.
        """
        saves: dict[int, list[tuple[int, int, int]]] = {}
        for pair, a, b in offers:
            if pair in self.joint and here[a] and here[b]:
                saving = int(min(most[a] + most[b] - self.joint[pair], most[a], most[b]))
                if saving > 0:
                    saves.setdefault(a, []).append((saving, b, pair))
                    saves.setdefault(b, []).append((saving, a, pair))
        order = [i for i in np.argsort(most, kind="stable").tolist() if here[i]]
        units: dict[int, tuple[int, int | None, list[int]]] = {}  # by the first of its terms
        alone: set[int] = set()
        bound = 0
        for taken, i in enumerate(order):
            saving, partner, pair = max((x for x in saves.get(i, ()) if x[1] in alone), default=(0, -1, -1))
            bound += int(most[i]) - saving
            if bound >= threshold:
                return list(units.values()), order[taken:]
            if saving:
                alone.remove(partner)
                units[partner] = (int(most[partner]) + int(most[i]) - saving, pair, [partner, i])
            else:
                alone.add(i)
                units[i] = (int(most[i]), None, [i])
        return list(units.values()), []


def search(blocks: DataFrame, queries: Queries, pairs: np.ndarray, k: int) -> DataFrame:
    """(query, doc_id, score): at least the k best documents of each query."""
    number = {tuple(p): i for i, p in enumerate(pairs.tolist())}
    asked = []
    for terms in queries.terms:
        place = {t: i for i, t in enumerate(terms.tolist())}
        asked.append((terms, [(p, place[a], place[b]) for (a, b), p in number.items() if a in place and b in place]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in asked]
        for batch in batches:
            for r in range(batch.num_rows):
                block = Block([batch.column(c)[r].as_py() for c in range(batch.num_columns)])
                for (terms, offers), top in zip(asked, best, strict=True):
                    if len(terms):
                        block.search(terms, offers, top)
        for q, top in enumerate(best):
            if len(top.score):
                ids = pa.array(top.id, mask=~top.known)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q, dtype=np.int32)), ids, pa.array(top.score)], names=["query", "doc_id", "score"])

    return map_arrow(blocks, run, "query int, doc_id long, score long", __name__)


def rank(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents with a score above 0 for each item."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("text IS NOT NULL")
    n = -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // QUERY_BYTES)
    out = spark.createDataFrame([], asked.select("item_id").schema).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    for i in range(n):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()  # about QUERY_BYTES
        queries = read_queries([r["text"] for r in rows])
        table = materialise(forward(docs, doc_id, doc_text, queries.vocabulary), "search-terms")
        totals = table.agg(F.count("*"), F.sum("n")).first()
        if not totals[0] or not queries.vocabulary:
            continue
        df = frequencies(table, len(queries.vocabulary))
        pairs = shared_pairs(queries, df)
        blocks = materialise(index(table, weights(totals[0], df), pairs, *totals), "search-index")
        found = search(blocks, queries, pairs, k)
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(rows)], asked.select(F.lit(0).alias("query"), "item_id").schema)
        part = ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        out = out.unionByName(part)
    return out
