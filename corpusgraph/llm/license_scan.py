"""License scan: ordered signature rules behind a keyword prefilter.

An Aho-Corasick automaton finds, in a text's words joined by spaces, the keywords of the rules; only rules with a
keyword there are run over the whole text. Of overlapping detections, one that lies within the interval of a
detection of a stronger priority, or of a longer one (of equal ones: an earlier rule's) of its own priority, is
suppressed. The base phrases are counted apart and always give their labels.

Defined results: a null text counts as empty and has no words, no places and score 0. Texts of any length are scanned
whole. Rows are scanned each by itself, so repeated and null ids keep their rows. An empty table gives no rows. Other
columns, whatever their names, don't matter.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame

from .common import held, lower_ascii, map_texts, word_bytes
from .license_rules import CONFIDENCE, RULES, Rule

# The phrases whose words are looked for, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Score of a text in which a phrase is found and no rule holds.
PHRASE_ONLY = 0.5
SCHEMA = "doc_id long, n_words long, base array<struct<label: string, word: long>>, detections array<struct<label: string, priority: int, start: long, end: long>>, score double"
_PHRASES = [([w.encode() for w in phrase.split()], label) for phrase, label in PHRASES.items()]


def places(words: list[bytes]) -> list[tuple[int, str]]:
    """(word, label) of each place where a phrase stands, in order."""
    found = []
    for phrase, label in _PHRASES:
        at = -1
        try:
            while True:
                at = words.index(phrase[0], at + 1)
                if words[at : at + len(phrase)] == phrase:
                    found.append((at, label))
        except ValueError:
            pass
    return sorted(found)


def automaton(rules: list[Rule]):
    import ahocorasick

    by_keyword: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        for keyword in rule.keywords:
            by_keyword.setdefault(keyword, []).append(i)
    made = ahocorasick.Automaton()
    for keyword, numbers in by_keyword.items():
        made.add_word(keyword, (keyword, numbers))
    made.make_automaton()
    return made


def gated(joined: str, rules: list[Rule]) -> list[int]:
    """The rules with a keyword in the words, in order."""
    seen: dict[str, list[int]] = {}
    for _, (keyword, numbers) in held("license_scan", "automaton", lambda: automaton(RULES)).iter(joined) if rules is RULES else automaton(rules).iter(joined):
        seen[keyword] = numbers
    return sorted({i for numbers in seen.values() for i in numbers})


def detect(text: str, numbers: list[int], rules: list[Rule] = RULES) -> list[tuple[int, int, int]]:
    """(rule, start, end) of all matches of these rules in a text in lower case."""
    out = []
    for i in numbers:
        rule = rules[i]
        group = "hit" if "hit" in rule.pattern.groupindex else 0
        out += [(i, *m.span(group)) for m in rule.pattern.finditer(text)]
    return out


def resolve(found: list[tuple[int, int, int]], rules: list[Rule] = RULES) -> list[tuple[int, int, int]]:
    """The detections that no stronger one contains, by start."""
    kept: list[tuple[int, int, int]] = []
    levels: dict[int, list[tuple[int, int, int]]] = {}
    for d in found:
        levels.setdefault(rules[d[0]].priority, []).append(d)
    for level in sorted(levels):
        strong = sorted((s, e) for _, s, e in kept)
        starts, reach, far = [s for s, _ in strong], [], -1
        for _, e in strong:
            far = max(far, e)
            reach.append(far)
        far = -1  # of this level, whose earlier ones start no later
        for i, s, e in sorted(levels[level], key=lambda d: (d[1], -d[2], d[0])):
            at = bisect.bisect_right(starts, s) - 1
            if far < e and (at < 0 or reach[at] < e):
                kept.append((i, s, e))
                far = e
    return sorted(kept, key=lambda d: (d[1], d[2], d[0]))


def scan_text(text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, int]]]:
    """(number of words, places of phrases, kept detections) of a text."""
    words = word_bytes(text)
    numbers = gated(b" ".join(words).decode(errors="replace"), RULES)
    if not numbers:
        return len(words), places(words), []
    return len(words), places(words), resolve(detect(lower_ascii(text).decode(errors="replace"), numbers))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """SCHEMA: the places of base phrases, the kept detections with their spans in code points, and a score for each row."""

    def run(ids: list, texts: list[bytes]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": ids, "n_words": [], "base": [], "detections": [], "score": []}
        for t in texts:
            n, base, kept = scan_text(t)
            out["n_words"].append(n)
            out["base"].append([{"label": label, "word": at} for at, label in base])
            out["detections"].append([{"label": RULES[i].label, "priority": RULES[i].priority, "start": s, "end": e} for i, s, e in kept])
            out["score"].append(max([CONFIDENCE[RULES[i].priority] for i, _, _ in kept] + [PHRASE_ONLY] * bool(base), default=0.0))
        return out

    return map_texts(docs, doc_id, text, run, SCHEMA)
