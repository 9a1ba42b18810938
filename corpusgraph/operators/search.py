"""Ranked and exact text search: postings, fielded lexical score, hybrid score, trigram pruning, regular expressions, vectors."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import grams, lines, tokens
from ..checkpoint import cut, in_blocks
from .graph import pagerank

# Fixed values of the scores.
K1, B = 1.2, 0.75
NAME_WEIGHT, PATH_WEIGHT = 3.0, 2.0
GRAPH_WEIGHT, RESCUE = 0.5, 0.15
TEST_FACTOR = 0.35
LIMIT = 8
#: Vectors of one matrix product.
VECTORS = 2048


def postings(docs: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(id, field, term, tf) of each field."""
    out = None
    for field, column in fields.items():
        one = docs.select("id", F.lit(field).alias("field"), F.explode(tokens(F.col(column))).alias("term")).groupBy("id", "field", "term").agg(F.count("*").alias("tf"))
        out = one if out is None else out.unionByName(one)
    return out


def term_stats(post: DataFrame) -> DataFrame:
    """(term, df): documents with the term in any field."""
    return post.groupBy("term").agg(F.count_distinct("id").alias("df"))


def lexical(docs: DataFrame, query: str, name: str | None, path: str | None, body: str, factor: Column | None = None) -> DataFrame:
    """(id, lexical) of documents with a positive fielded score.

    The statistics are those of the documents given: filter first, then score. The texts are tokenised once: counts of
    the question's words and lengths are written as a table, of which both the statistics and the scores are made.
    """
    spark = docs.sparkSession
    terms = spark.range(1).select(F.explode(tokens(F.lit(query))).alias("term")).groupBy("term").agg(F.count("*").alias("qtf"))
    qtf = {r["term"]: r["qtf"] for r in terms.collect()}  # the question's words
    words = list(qtf)
    fields = {"name": name, "path": path, "body": body}
    times = lambda field, word: F.size(F.filter(field, lambda t: t == F.lit(word)))
    hot = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    rows = docs.select("id", *[tokens(F.col(c)).alias(f) if c else F.array().cast("array<string>").alias(f) for f, c in fields.items()], (factor if factor is not None else F.lit(1.0)).alias("factor"))
    counts = rows.select("id", "factor", F.size("body").alias("len"), *[F.array(*[times(f, w) for w in words]).alias(f) for f in fields] if words else [hot.alias(f) for f in fields])
    if not words:
        return counts.select("id", F.lit(0.0).alias("lexical")).filter(F.lit(False))
    counts = cut(counts, "counts")
    seen = [F.sum(F.when((F.get("name", F.lit(i)) + F.get("path", F.lit(i)) + F.get("body", F.lit(i))) > 0, 1).otherwise(0)).alias(f"df{i}") for i in range(len(words))]
    stats = counts.agg(F.count("*").alias("docs"), F.avg("len").alias("avg_len"), *seen)  # one row
    rows = counts.crossJoin(F.broadcast(stats))
    ratio = F.when(F.col("avg_len") > 0, F.col("len") / F.col("avg_len")).otherwise(1.0)
    norm = K1 * (1 - B + B * ratio)
    score = F.lit(0.0)
    for i, w in enumerate(words):
        idf = F.log(1 + F.col("docs") / (1 + F.col(f"df{i}")))
        n, p, b = (F.get(f, F.lit(i)) for f in ("name", "path", "body"))
        score = score + idf * qtf[w] * (NAME_WEIGHT * n + PATH_WEIGHT * p) + F.when(b > 0, idf * b * (K1 + 1) / (b + norm)).otherwise(0.0)
    return rows.select("id", (score * F.col("factor")).alias("lexical")).filter("lexical > 0")


def top(rows: DataFrame, score: str, limit: int = LIMIT, tie: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(score), tie).limit(limit)


def hybrid(nodes: DataFrame, edges: DataFrame, query: str, name: str | None, path: str | None, body: str, factor: Column | None = None, limit: int = LIMIT) -> DataFrame:
    """(id, lexical, graph, score): lexical score over its maximum plus half of the rank seeded by it; top by score, then id."""
    factor = factor if factor is not None else F.lit(1.0)
    lex = cut(lexical(nodes, query, name, path, body, factor), "lexical")  # seeds, maximum and scores
    rank = pagerank(nodes, edges, lex.select("id", F.col("lexical").alias("weight")))
    best = lex.agg(F.max("lexical").alias("best"))
    both = lex.join(rank, "id", "full_outer").filter(f"lexical IS NOT NULL OR score >= {RESCUE}").crossJoin(F.broadcast(best))
    both = both.join(nodes.select("id", factor.alias("factor")), "id")
    rows = both.select("id", F.coalesce(F.col("lexical") / F.col("best"), F.lit(0.0)).alias("lexical"), F.coalesce("score", F.lit(0.0)).alias("graph"), "factor")
    rows = rows.select("id", "lexical", "graph", F.round((F.col("lexical") + GRAPH_WEIGHT * F.col("graph")) * F.col("factor"), 6).alias("score"))
    return top(rows, "score", limit)


def gram_index(docs: DataFrame) -> DataFrame:
    """(gram, id)."""
    return docs.select("id", F.explode(grams(F.col("text"))).alias("gram"))


def candidates(index: DataFrame, ids: DataFrame, alternatives: list[list[str]]) -> DataFrame:
    """Ids that may hold all literals of one alternative; all ids if some alternative has no usable literal."""
    spark = index.sparkSession
    rows = []
    for i, literals in enumerate(alternatives):
        low = {g for t in literals for g in _grams(t)}
        if not low:
            return ids.select("id")
        rows += [(i, g, len(low)) for g in low]
    wanted = spark.createDataFrame(rows, "alt int, gram string, n int")  # the pattern's grams
    return index.join(F.broadcast(wanted), "gram").groupBy("alt", "id").agg(F.count_distinct("gram").alias("have"), F.first("n").alias("n")).filter("have = n").select("id").distinct()


def postings_of(docs: DataFrame, alternatives: list[list[str]]) -> DataFrame:
    """(gram, id): the rows that gram_index has for the grams of these literals, by one scan of the texts and without an index."""
    wanted = sorted({g for literals in alternatives for t in literals for g in _grams(t)})
    low = docs.select("id", F.translate("text", string.ascii_uppercase, string.ascii_lowercase).alias("low"))
    return low.select("id", F.explode(F.filter(F.array(*[F.lit(g) for g in wanted]).cast("array<string>"), lambda g: F.contains("low", g))).alias("gram")).select("gram", "id")


def _grams(literal: str) -> set[str]:
    low = "".join(c.lower() if c.isascii() else c for c in literal)
    return {low[i : i + 3] for i in range(len(low) - 2) if low[i : i + 3].isascii()}


def grep(docs: DataFrame, pattern: str, ids: DataFrame | None = None, fixed: bool = False, ignore_case: bool = False) -> DataFrame:
    """(id, line_no, line) of matching lines. Look-around and back-references are refused."""
    import re

    if not fixed and re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", pattern):
        raise ValueError("look-around and back-references are not supported")
    if ids is not None:
        docs = docs.join(ids, "id", "left_semi")
    text = F.col("text")
    if fixed:
        hit = lambda c: F.contains(F.lower(c), F.lit(pattern.lower())) if ignore_case else F.contains(c, F.lit(pattern))
    else:
        hit = lambda c: c.rlike(("(?i)" if ignore_case else "") + pattern)
    if fixed:
        whole = docs.filter(hit(text))
    elif re.search(r"\\[AzZG]", pattern):  # ends of the text, which for a line are those of the line: no filter by document
        whole = docs
    else:
        whole = docs.filter(text.rlike("(?m" + ("i" if ignore_case else "") + ")" + pattern))
    return lines(whole, "id", "text").filter(hit(F.col("line")))


def search_counters(docs: DataFrame, ids: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: in_scope, binary, candidates, with_hits, hits."""
    marks = docs.select("id", F.contains("text", F.lit("\x00")).alias("is_binary")).join(ids.withColumn("c", F.lit(1)), "id", "left").join(hits.groupBy("id").agg(F.count("*").alias("h")), "id", "left")
    return marks.agg(F.count("*").alias("in_scope"), F.count_if("is_binary").alias("binary"), F.count("c").alias("candidates"), F.count("h").alias("with_hits"), F.coalesce(F.sum("h"), F.lit(0)).alias("hits"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query, id, score, rank) by cosine, the query itself excluded: a stated query set against all vectors, in blocks of queries.

    Each task multiplies its vectors with a block as matrices and carries the best k of each query; scores are then summed
    in order and rounded as the plain expression does. Rows with nulls, odd lengths or extreme entries take that expression.
    """
    q = queries.select(F.col("id").alias("query"), F.col("vec").cast("array<double>").alias("q"))
    v = vectors.select("id", F.col("vec").cast("array<double>").alias("v"))
    squares = lambda c: F.aggregate(c, F.lit(0.0), lambda s, y: s + y * y)
    unit = lambda c: F.transform(c, lambda x: x / F.sqrt(squares(c)))
    dot = F.aggregate(F.zip_with(unit(F.col("q")), unit(F.col("v")), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    usual = lambda c: F.coalesce(squares(c).between(1e-200, 1e300), F.lit(False))
    plain = lambda rows, block: rows.join(F.broadcast(block), F.col("id") != F.col("query")).select("query", "id", F.round(dot, 6).alias("score"))

    def best(block: DataFrame) -> DataFrame:
        width = block.filter(usual(F.col("q"))).agg(F.max(F.size("q"))).first()[0] or 0
        fits = lambda c: usual(F.col(c)) & (F.size(c) == width)
        asked = block.filter(fits("q")).collect()  # a block at most
        pairs = plain(v, block.filter(~fits("q"))).unionByName(plain(v.filter(~fits("v")), block.filter(fits("q"))))
        if asked:
            schema = f"query {queries.schema['id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"
            pairs = pairs.unionByName(v.filter(fits("v")).mapInArrow(_best_of([r.query for r in asked], [r.q for r in asked], k), schema))
        return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    return in_blocks(q, "query", best)


def _rounded(scores: np.ndarray) -> np.ndarray:
    """Six places, halves away from zero by the shortest decimal form, as F.round does."""
    size = np.abs(scores) * 1e6
    units = np.floor(size + 0.5)
    for i in np.flatnonzero(np.abs(size - np.floor(size) - 0.5) < 1e-6):
        units[i] = int(Decimal(repr(float(abs(scores[i])))).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP))
    return np.sign(scores) * units / 1e6 + 0.0


def _units(rows: np.ndarray) -> np.ndarray:
    """Vectors of length 1; squares are summed in order."""
    squares = np.zeros(len(rows))
    for i in range(rows.shape[1]):
        squares += rows[:, i] * rows[:, i]
    return rows / np.sqrt(squares)[:, None]


def _best_of(query_ids: list, query_vectors: list, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function for mapInArrow that gives (query, id, score) of the best k of each query in a partition of (id, v)."""
    q = _units(np.array(query_vectors))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.array(query_ids)
        at, ids, scores, kind = np.empty(0, np.int64), None, np.empty(0), None
        for batch in batches:
            kind = batch.column("id").type
            for start in range(0, batch.num_rows, VECTORS):
                part = batch.slice(start, VECTORS)
                names = part.column("id").to_numpy(zero_copy_only=False)
                v = _units(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, q.shape[1]))
                rough = v @ q.T
                rough[names[:, None] == asked[None, :]] = -np.inf
                # All that could be among the best k once it is summed in order and rounded.
                least = np.partition(rough, -k, axis=0)[-k] if len(rough) > k else np.full(len(asked), -2.0)
                row, col = np.nonzero((rough >= least - 2e-6) & (rough > -np.inf))
                exact = np.zeros(len(row))
                for i in range(q.shape[1]):
                    exact += q[col, i] * v[row, i]
                at, scores = np.concatenate([at, col]), np.concatenate([scores, _rounded(exact)])
                ids = names[row] if ids is None else np.concatenate([ids, names[row]])
                order = np.lexsort((np.unique(ids, return_inverse=True)[1], -scores, at))
                at, ids, scores = at[order], ids[order], scores[order]
                place = np.arange(len(at)) - np.searchsorted(at, at)
                at, ids, scores = at[place < k], ids[place < k], scores[place < k]
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(asked[at], kind), pa.array(ids, kind), pa.array(scores)], names=["query", "id", "score"])

    return best
