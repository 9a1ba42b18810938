"""The null of the randomness battery: uniform at most under ordinary text, in each group of encodings."""

import hashlib
import random
from collections import Counter

from corpusgraph.llm import secrets

SYLLABLES = "the and ing er on th ti es or en re ha is ou ea nd st ed".split()


def ordinary(n, seed):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choices(SYLLABLES, range(len(SYLLABLES), 0, -1), k=rng.randrange(1, 5))) for _ in range(rng.randrange(10, 80))) for _ in range(n)]


def decoys(texts):
    out = Counter()
    for t in texts:
        for x in secrets.candidates(t, secrets.base_spans(t))[1]:
            out[x["cls"], x["bin"]] += 1
    return out


def test_p_values_of_ordinary_text_are_not_small():
    p, other = secrets.p_values(decoys(ordinary(3000, 1))), decoys(ordinary(3000, 2))
    for group in range(3):
        total = sum(n for k, n in other.items() if k[0] % 3 == group)
        assert total == 3000
        for level in (0.02, 0.05, 0.1, 0.3):
            assert sum(n for k, n in other.items() if k[0] % 3 == group and p[k] <= level) <= (level + 0.015) * total


def p_of(value, p):
    x = secrets._tested(0, len(value), value)
    return p[x["cls"], x["bin"]]


def test_hexadecimal_strings_are_told_apart():
    p = secrets.p_values(decoys(ordinary(3000, 1)))
    keys = sorted(p_of(hashlib.sha256(str(i).encode()).hexdigest()[:40], p) for i in range(200))
    assert keys[120] < 0.05
    for odd in ("0123456789abcdef0123456789abcdef", "deadbeef" * 5, "0" * 31 + "1", "20240101000000002024010100000000", "aaaabbbbccccddddeeeeffff00001111"):
        assert p_of(odd, p) > 0.2
