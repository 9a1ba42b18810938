"""Ranks over blocks of edges: against all pairs in numpy, with many small blocks and parts, and what their rounds move."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgraph.checkpoint import cut
from corpusgraph.operators import graph

NODES = [f"n{i}" for i in range(60)] + ["n3", "n3", None, "alone", "loop"]
EDGES = [(f"n{i}", f"n{i * i % 7}") for i in range(50)] + [(f"n{i}", "n50") for i in range(45)] + [("n50", "n51"), ("n51", "n50"), ("loop", "loop"), ("n1", "n2"), ("n1", "n2"), ("n8", "gone"), ("gone", "n52"), ("gone", "n1"), ("gone", "gone"), (None, "n1"), ("n1", None)]
SEEDS = [(f"n{i}", 1.0 + i % 3) for i in range(0, 60, 4)] + [("alone", 2.0), ("n4", 0.5), ("gone", 9.0), ("n5", 0.0), ("n6", -1.0), (None, 3.0)]


def dense(nodes, edges, seeds, restart, steps):
    ids = sorted({n for n in nodes if n is not None})
    at = {n: i for i, n in enumerate(ids)}
    a, r = np.zeros((len(ids), len(ids))), np.zeros(len(ids))
    for s, t in edges:
        if s in at and t in at:
            a[at[s], at[t]] += 1
            a[at[t], at[s]] += 1
    for s, w in seeds:
        if s in at and w > 0:
            r[at[s]] += w
    r, degree = r / r.sum(), a.sum(0)
    x = r
    for _ in range(steps):
        x = (1 - restart) * a @ np.divide(x, degree, out=np.zeros(len(x)), where=degree > 0) + r * (restart + (1 - restart) * x[degree == 0].sum())
    return {n: x[i] / x.max() for n, i in at.items() if x[i] > 0}


def tables(spark, nodes=NODES, edges=EDGES, seeds=SEEDS):
    edges = [(s, t, "calls") for s, t in edges] + [("n9", "alone", "contains")]
    return spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(edges, "source string, target string, relation string"), spark.createDataFrame(seeds, "id string, weight double")


def same(found, want):
    got = {r.id: r.score for r in found.collect()}
    assert got.keys() == want.keys() and found.count() == len(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)


@pytest.mark.parametrize("most, chunk, steps", [((6_000_000, 1_000_000), 1 << 20, 25), ((9, 3), 4, 6), ((5, 100), 1, 1)])
def test_rank_of_odd_graphs_in_blocks_of_any_size(spark, monkeypatch, most, chunk, steps):
    monkeypatch.setattr(graph, "EDGES", most[0], raising=False)
    monkeypatch.setattr(graph, "PLACES", most[1], raising=False)
    if hasattr(graph, "blocks"):
        monkeypatch.setattr(graph.blocks, "CHUNK", chunk)
    same(graph.pagerank(*tables(spark), steps=steps), dense(NODES, EDGES, SEEDS, graph.RESTART, steps))


def test_rounds_of_a_rank_move_no_edges(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(graph, "cut", lambda df, name: kept.append((name, df, cut(df, name))) or kept[-1][2])
    edges = [(f"n{i}", f"n{i % 7}") for i in range(3000)]
    nodes, seeds = [f"n{i}" for i in range(3000)], [("n20", 1.0)]
    same(graph.pagerank(*tables(spark, nodes, edges, seeds), steps=10), dense(nodes, edges, seeds, graph.RESTART, 10))
    rounds = [(df, made) for name, df, made in kept if name == "moved"]
    assert len(rounds) == 2 and all("Join" not in df._jdf.queryExecution().executedPlan().toString() and made.count() < 9 for df, made in rounds)
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_ranks_tell_equal_numbers_apart(spark, monkeypatch):
    plain, tables_ = F.xxhash64, []
    # With seed 0 all ids of a length share a number; with seed 1 the loose end `gone` has that of n1.
    fake = lambda seed, c, *rest: plain(seed, c, *rest) if rest or not str(seed).count("'0'") else plain(seed, F.length(c))
    monkeypatch.setattr(graph.F, "xxhash64", lambda seed, c: plain(seed, c) if isinstance(seed, str) else fake(seed, F.when(c == "gone", "n1").otherwise(c)))
    monkeypatch.setattr(graph, "cut", lambda df, name: tables_.append(name) or cut(df, name))
    seeds = [s for s in SEEDS if s[0] != "gone"]
    same(graph.pagerank(*tables(spark, seeds=seeds), steps=4), dense(NODES, EDGES, seeds, graph.RESTART, 4))
    assert tables_.count("numbers") == 2


def test_rank_without_edges_is_the_restart(spark):
    same(graph.pagerank(*tables(spark, edges=[("x", "y")])), dense(NODES, [], SEEDS, graph.RESTART, 25))
