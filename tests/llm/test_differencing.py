"""Differencing against a plain version over sets of items."""

import random

from corpusgraph.llm import sharding


def plain(sizes, shards):
    """Combine, again and again, the two partial partitions of largest spread, the fullest part of one with the emptiest of the other."""
    parts = [[(s, {i})] + [(0, set())] * (shards - 1) for i, s in enumerate(sizes)]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0][0] - p[-1][0])
        a, b = parts.pop(), parts.pop()
        parts.append(sorted(((x + y, p | q) for (x, p), (y, q) in zip(a, reversed(b), strict=True)), key=lambda p: -p[0]))
    return parts[0]


def test_shards_are_those_of_plain_differencing():
    rng = random.Random(9)
    for shards, n in ((2, 12), (3, 25), (5, 60), (24, 200)):
        for _ in range(5):
            sizes = [rng.randrange(1, 10**9) for _ in range(n)]  # no two alike, so there are no ties
            got = sharding.difference(sizes, shards)
            groups = {frozenset(i for i, s in enumerate(got) if s == k) for k in range(shards)}
            assert groups == {frozenset(items) for _, items in plain(sizes, shards)}


def test_differencing_is_near_the_best_split():
    rng = random.Random(3)
    for _ in range(20):
        sizes = [rng.randrange(1, 1000) for _ in range(10)]
        best = min(abs(sum(sizes) - 2 * sum(s for i, s in enumerate(sizes) if mask >> i & 1)) for mask in range(1 << 10))
        got = sharding.difference(sizes, 2)
        spread = abs(sum(s if k else -s for s, k in zip(sizes, got, strict=True)))
        assert best <= spread <= best + max(sizes) // 2
