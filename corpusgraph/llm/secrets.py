"""Secret scan: fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

Base spans come from three patterns (assignments, access keys, hexadecimal strings). Every base span's value, and
every other run of at least SHORTEST key letters (digits alone are no key), is a candidate: its encoding is inferred from its alphabet, and
tests ask whether it looks random there: chi-squared uniformity over the alphabet with repeated letters, runs above
and below the alphabet's middle, and serial correlation of neighbours. Fisher's method makes one statistic of them.
The tests depend on each other, so the statistic is not read as a probability but set against ordinary text.

Every document gives one decoy, letters from its ordinary text, of the length class that its own length picks, which is
tested under each group of encodings: as it is for letters, folded onto the sixteen digits for hexadecimal, so that the
null keeps a text's uneven and dependent letters in every alphabet. The p-value of a candidate is the share of decoys of its length class that look as random or
more under its group of encodings (classes with fewer than LEAST_DECOYS are pooled with their neighbours). Benjamini-Hochberg over all candidates of all documents then finds
the largest p-value at which the expected share of false reports is FALSE_SHARE or less.

Only counts by length class and bin of the statistic reach the driver. Null text is empty text; bytes that are no UTF-8
count as U+FFFD. Rows that repeat each count and report for themselves. Columns other than id and text are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialise

SHORTEST = 16
FALSE_SHARE = 0.05
LENGTHS = (16, 20, 24, 32, 48, 64)
BINS = 40
#: Decoys that a p-value should rest on.
LEAST_DECOYS = 40
KINDS = ("assign", "access", "hex", "random")

# Fixed patterns of the base spans.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
NOT_LETTERS = re.compile(r"[A-Za-z0-9+/_=-]{16,}|[^A-Za-z]+")

#: Encodings from the narrowest; the first whose alphabet holds all letters is inferred.
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("base36", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("BASE36", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Groups of encodings: hexadecimal, letters of one case, more letters.
GROUPS = {"hex": 0, "HEX": 0, "base32": 1, "lower": 1}
_SETS = [(name, frozenset(letters), {c: i for i, c in enumerate(letters)}) for name, letters in ALPHABETS]


def _normal_tail(z: float) -> float:
    """Two-sided p-value of a standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared by the Wilson-Hilferty cube root."""
    if df <= 0:
        return 1.0
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def encoding(token: str) -> tuple[str, dict[str, int]] | None:
    letters = set(token)
    return next(((name, index) for name, known, index in _SETS if letters <= known), None)


def randomness(token: str, found: tuple[str, dict[str, int]] | None = None) -> float:
    """The combined statistic of the battery under random letters of an encoding, the inferred one if none is given; 0 where none fits."""
    token = token.rstrip("=")
    found = found or encoding(token)
    n = len(token)
    if found is None or n < SHORTEST:
        return 0.0
    index = found[1]
    values = [index[c] for c in token]
    k = len(index)
    # Letters in as many equal cells as the length can fill.
    cells = max(2, min(k, n // 3))
    counts = [0] * cells
    for v in values:
        counts[v * cells // k] += 1
    share = [0] * cells
    for v in range(k):
        share[v * cells // k] += 1
    chi = sum((c - n * s / k) ** 2 / (n * s / k) for c, s in zip(counts, share, strict=True))
    p_uniform = _chi_tail(chi, cells - 1)
    # Repeated letters, which coarse cells don't see.
    same = sum(c * (c - 1) for c in (token.count(x) for x in set(token))) / 2
    expect = n * (n - 1) / (2 * k)
    p_repeat = _normal_tail(max(0.0, same - expect) / math.sqrt(expect * (1 - 1 / k)))
    middle = [v >= k / 2 for v in values]
    above = sum(middle)
    below = n - above
    if above and below:
        runs = 1 + sum(a != b for a, b in zip(middle, middle[1:], strict=False))
        mean = 1 + 2 * above * below / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = _normal_tail((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    avg = sum(values) / n
    total = sum((v - avg) ** 2 for v in values)
    p_serial = _normal_tail(sum((a - avg) * (b - avg) for a, b in zip(values, values[1:], strict=False)) / total * math.sqrt(n)) if total else 0.0
    ps = [max(p, 1e-12) for p in (min(1.0, 2 * min(p_uniform, p_repeat)), p_runs, p_serial)]
    half = -sum(map(math.log, ps))
    return math.exp(-half) * sum(half**i / math.factorial(i) for i in range(len(ps)))


def bin_of(p: float) -> int:
    """0 for what fails outright, BINS for p = 1; in steps of a fifth of a decade."""
    return max(0, min(BINS, BINS + math.floor(5 * math.log10(max(p, 1e-9)))))


def length_class(n: int) -> int:
    return max(i for i, least in enumerate(LENGTHS) if n >= least)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted."""
    low = text.lower()
    out = []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _tested(start: int, end: int, value: str) -> dict | None:
    value = value.rstrip("=")
    if len(value) < SHORTEST:
        return None
    found = encoding(value)
    return {"start": start, "end": end, "cls": 3 * length_class(len(value)) + (GROUPS.get(found[0], 2) if found else 2), "bin": bin_of(randomness(value, found))}


_BY_NAME = {name: (name, index) for name, _, index in _SETS}
#: Letters onto hexadecimal digits, the later ones again from 0 on.
_FOLD = str.maketrans({chr(97 + i): "0123456789abcdef"[i % 16] for i in range(26)})


def _decoy(letters: str) -> list[float]:
    """The statistic of ordinary letters under each group of encodings."""
    low = letters.lower()
    return [randomness(low.translate(_FOLD), _BY_NAME["hex"]), randomness(low, _BY_NAME["lower"]), randomness(letters, _BY_NAME["base62"])]


def candidates(text: str, base: list[tuple[int, int, int]]) -> tuple[list[dict], list[dict]]:
    """Base spans' values and runs apart from them, each with class (three for each length, by group of encodings) and bin; and the text's decoys."""
    found, decoys = [], []
    covered, at = 0, 0  # the largest end of the base spans that start before a run ends
    for start, kind, end in base:
        value = text[start:end]
        if kind == 0:
            value = ASSIGN.match(text, start, end).group(2)
        found.append(_tested(start, end, value))
    for m in CANDIDATE.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            covered, at = max(covered, base[at][2]), at + 1
        if covered <= m.start() and not m.group().isdigit():
            found.append(_tested(*m.span(), m.group()))
    plain = NOT_LETTERS.sub("", text)
    if len(plain) >= SHORTEST:
        fits = sum(len(plain) >= n for n in LENGTHS)
        cls = len(text) * 104729 % 1000003 % fits
        at = (len(text) * 7919 + cls) % (len(plain) - LENGTHS[cls] + 1)
        decoys += [{"cls": 3 * cls + group, "bin": bin_of(x)} for group, x in enumerate(_decoy(plain[at : at + LENGTHS[cls]]))]
    return [x for x in found if x], decoys


def _scan(ids: list, texts: list[bytes]) -> dict[str, list]:
    out: dict[str, list] = {"doc_id": ids, "base": [], "found": [], "decoys": []}
    for raw in texts:
        text = raw.decode(errors="replace")
        base = base_spans(text)
        found, decoys = candidates(text, base)
        out["base"].append([{"start": a, "kind": k, "end": b} for a, k, b in base])
        out["found"].append(found)
        out["decoys"].append(decoys)
    return out


def p_values(decoys: dict[tuple[int, int], int]) -> dict[tuple[int, int], float]:
    """The p-value of each (class, bin): the share of decoys at or above the bin, of so many neighbouring lengths of the same group as give LEAST_DECOYS."""
    out = {}
    for cls in range(3 * len(LENGTHS)):
        for reach in range(len(LENGTHS)):
            near = {k: n for k, n in decoys.items() if k[0] % 3 == cls % 3 and abs(k[0] - cls) <= 3 * reach}
            total = sum(near.values())
            if total >= LEAST_DECOYS:
                break
        for b in range(BINS + 1):
            out[cls, b] = (1 + sum(n for (_, x), n in near.items() if x >= b)) / (1 + total)
    return out


def discoveries(found: dict[tuple[int, int], int], p: dict[tuple[int, int], float]) -> set[tuple[int, int]]:
    """Benjamini-Hochberg over counts of candidates by (class, bin): the bins reported."""
    total, limit = sum(found.values()), 0.0
    for at in sorted({p[k] for k in found}):
        if total * at <= FALSE_SHARE * sum(n for k, n in found.items() if p[k] <= at):
            limit = at
    return {k for k in p if k[1] > 0 and p[k] <= limit}


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, base and spans (arrays of start, kind, end; kind indexes KINDS), by start; and
    random: of all spans (start, end) those whose values look random, base spans too."""
    tested = "array<struct<start:int,end:int,cls:int,bin:int>>"
    scanned = materialise(map_texts(docs, id_col, text_col, _scan, f"doc_id long, base array<struct<start:int,kind:int,end:int>>, found {tested}, decoys array<struct<cls:int,bin:int>>"), "secrets")
    counts = lambda c: {(r[0], r[1]): r[2] for r in scanned.select(F.explode(c).alias("x")).groupBy("x.cls", "x.bin").count().collect()}  # noqa: E731  3 * len(LENGTHS) * (BINS + 1) rows at most
    least: dict[int, int] = {}
    for cls, b in discoveries(counts("found"), p_values(counts("decoys"))):
        least[cls] = min(b, least.get(cls, b))
    passes = lambda x: F.coalesce(*[F.when((x["cls"] == c) & (x["bin"] >= b), True) for c, b in least.items()], F.lit(False))
    random = F.transform(F.filter("found", passes), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    rows = scanned.select("doc_id", "base", random.alias("random"))
    is_base = lambda x: F.exists("base", lambda y: (y["start"] == x["start"]) & (y["end"] == x["end"]))
    more = F.transform(F.filter("random", lambda x: ~is_base(x)), lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", more)).alias("spans"), "random")


def as_text(spans: F.Column) -> F.Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
