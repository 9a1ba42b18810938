"""Toxicity by a weighted finite-state pattern grammar.

Words become tags, and five transducers with explicit states, arcs and weights, composed into two (one reads a
clause backwards, so that a target may follow), read the tags clause by clause:

* lexicon: a trie of word stems and whole words maps a word to insult, threat, target, negation or report,
  insults with a weight learned from the labels;
* negation: an insult or threat within a few words after a negation keeps a small part of its weight;
* reported speech: after a verb of saying, the rest of the sentence keeps half of its weight;
* target: an insult or threat within a few words of a word for a person is aimed;
* clause patterns: an aimed insult or threat gains weight, an insult alone keeps its own, a threat alone has none.

What leaves the composition is one weight per matched clause. A document's score is a logistic function of
its matched clauses (sum, strongest, number, share of all words), fitted on a bounded sample of labels
(`learning.MAX_PER_CLASS` rows a class). Null and empty texts match nothing and get the score of no match.
Labels, language, source and id never enter a score. Columns other than id and text are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import learning
from .common import arrow_schema, map_arrow, map_texts, materialise, utf8

# Words of each role.
INSULTS = "idiot idiots stupid moron morons loser losers scum trash worthless pathetic disgusting dumb imbecile vermin trottel arschloch dreckskerl connard salaud abruti imbécile idiota estúpido imbécil basura".split()
THREATS = "kill hurt destroy murder stab shoot töten umbringen vernichten tuer détruire matar destruir".split()
TARGETS = "you your yours yourself he him she her they them du dich dir ihr euch sie tu toi vous te il elle tú usted ustedes ti él ella eres are".split()
NEGATIONS = "not no never nobody isn aren don nicht kein keine nie niemals pas jamais aucun ne nunca jamás ningún".split()
REPORTS = "said says say called wrote quoted reported alleged claimed sagte sagt schrieb nannte dit disait écrit dijo dice escribió llamó".split()

#: Most learned entries of the lexicon, least G-squared of an entry, and stem lengths.
MAX_LEXICON = 4000
LEAST_EVIDENCE = 20.0
STEMS = range(3, 9)
NEGATION_SPAN, TARGET_SPAN = 3, 5
NEGATED, REPORTED, TARGETED, THREAT = 0.2, 0.5, 1.5, 3.0
#: Words that a Python worker remembers.
CACHE = 150_000

_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:\n]+|,(?=\s)")
_SENTENCE = ".!?\n"


def stems(word: str) -> list[str]:
    """A word as lexicon entries: its stems, and itself with an end mark."""
    return [word[:k] for k in STEMS if len(word) >= k] + [word + "$"]


class Lexicon:
    """Longest and heaviest entry wins; roles have precedence over learned insults."""

    def __init__(self, learned: dict[str, float]) -> None:
        self.learned = learned
        self.roles = {w: ("insult", 2.0) for w in INSULTS} | {w: ("threat", THREAT) for w in THREATS} | {w: ("target", 0.0) for w in TARGETS} | {w: ("negation", 0.0) for w in NEGATIONS} | {w: ("report", 0.0) for w in REPORTS}
        self.cache: dict[str, tuple[str, float] | None] = {}

    def tag(self, word: str) -> tuple[str, float] | None:
        weight = max((self.learned[s] for s in stems(word) if s in self.learned), default=0.0)
        role = self.roles.get(word)
        if weight > 0 and (role is None or role[0] == "insult"):
            return "insult", max(weight, role[1] if role else 0.0)
        return role

    def tags(self, words: list[str]) -> list[tuple[str, float] | None]:
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        out = []
        for w in words:
            if w not in cache:
                cache[w] = self.tag(w)
            out.append(cache[w])
        return out


class Transducer:
    """A deterministic weighted transducer over tags: arcs (state, tag) to (state, tag, weight); state 0 is the first."""

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, str, float]]) -> None:
        self.arcs = arcs

    def __matmul__(self, after: Transducer) -> Transducer:
        """Composition: after reads what this one writes; weights multiply. Only states that can be reached are made."""
        number, arcs, todo = {(0, 0): 0}, {}, [(0, 0)]
        while todo:
            state = todo.pop()
            for tag in TAGS:
                mine, middle, w = self.arcs[state[0], tag]
                theirs, out, v = after.arcs[state[1], middle]
                to = mine, theirs
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                arcs[number[state], tag] = number[to], out, w * v
        return Transducer(arcs)

    def run(self, tags: Iterable[str], state: int = 0) -> tuple[list[tuple[str, float]], int]:
        out, arcs = [], self.arcs
        for tag in tags:
            state, written, weight = arcs[state, tag]
            out.append((written, weight))
        return out, state


#: Tags: another word, insult, threat, target, negation, verb of saying, end of a clause, end of a sentence; A and B are an insult and a threat with a target.
TAGS = "_ITGNR,.AB"
_OF_ROLE = {"insult": "I", "threat": "T", "target": "G", "negation": "N", "report": "R"}


def negation() -> Transducer:
    """States: how many more words the last negation reaches. What it reaches weighs NEGATED; a clause's end ends its reach."""
    arcs = {}
    for left in range(NEGATION_SPAN + 1):
        for tag in TAGS:
            to = NEGATION_SPAN if tag == "N" else 0 if tag in ",." else max(0, left - 1)
            arcs[left, tag] = to, tag, NEGATED if left and tag in "ITAB" else 1.0
    return Transducer(arcs)


def reported() -> Transducer:
    """State 1 from a verb of saying to the sentence's end: what stands there weighs REPORTED."""
    return Transducer({(s, tag): (1 if tag == "R" else 0 if tag == "." else s, tag, REPORTED if s and tag in "ITAB" else 1.0) for s in (0, 1) for tag in TAGS})


def aimed() -> Transducer:
    """States: how many more words the last target reaches. I and T in its reach become A and B."""
    arcs = {}
    for left in range(TARGET_SPAN + 1):
        for tag in TAGS:
            to = TARGET_SPAN if tag == "G" else 0 if tag in ",." else max(0, left - 1)
            arcs[left, tag] = to, {"I": "A", "T": "B"}.get(tag, tag) if left else tag, 1.0
    return Transducer(arcs)


def clause_patterns() -> Transducer:
    """What an occurrence weighs by the pattern it is part of: insult with a target, threat with a target, insult alone; a threat alone is none."""
    return Transducer({(0, tag): (0, tag, {"A": TARGETED, "B": TARGETED, "T": 0.0}.get(tag, 1.0)) for tag in TAGS})


#: A target may follow: this one reads a clause from its end. The other reads what it writes from the beginning.
BACKWARD = aimed()
FORWARD = negation() @ reported() @ aimed() @ clause_patterns()


def clause_weights(text: str, lexicon: Lexicon) -> tuple[list[float], int]:
    """The weight of each matched clause, and the number of words."""
    text = text.lower()
    words = _WORD.findall(text)
    if not any(t and t[0] in ("insult", "threat") for t in set(lexicon.tags(words))):
        return [], len(words)
    out, state, at = [], 0, 0
    ends = [(m.start(), m.end(), m.group()) for m in _CLAUSE.finditer(text)] + [(len(text), len(text), ".")]
    for start, end, mark in ends:
        tags = lexicon.tags(_WORD.findall(text, at, start))
        line = [_OF_ROLE[t[0]] if t else "_" for t in tags]
        marks = [tag for tag, _ in BACKWARD.run(reversed(line))[0]][::-1]
        written, state = FORWARD.run([*marks, "." if any(c in _SENTENCE for c in mark) else ","], state)
        weight = sum(w * t[1] for (tag, w), t in zip(written, tags, strict=False) if tag in "ITAB")
        if weight > 0:
            out.append(weight)
        at = end
    return out, len(words)


def features(text: str, lexicon: Lexicon) -> list[float]:
    weights, words = clause_weights(text, lexicon)
    total = sum(weights)
    return [np.log1p(total), min(max(weights, default=0.0), 12.0), np.log1p(len(weights)), min(1.0, total / (words + 10))]


def _count_stems(label_at: int, text_at: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for y, text in zip(batch.column(label_at).to_pylist(), utf8(batch.column(text_at)), strict=True):
                counts[y].update({s for w in set(_WORD.findall(text.decode(errors="replace").lower())) for s in stems(w)})
            keys = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], names=["stem", "ones", "zeros"])

    return run


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Stems that go with label 1, with their smoothed log odds; at most MAX_LEXICON reach the driver."""
    counts = map_arrow(sample.select("label", "text"), _count_stems(0, 1), "stem string, ones long, zeros long").groupBy("stem").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    by = dict(sample.groupBy("label").count().collect())
    n0, n1 = by.get(0, 0), by.get(1, 0)
    if not n0 or not n1:
        return {}
    share = n1 / (n0 + n1)
    term = lambda c, e: F.when(c > 0, c * F.log(c / e)).otherwise(0.0)
    n = F.col("ones") + F.col("zeros")
    evidence = 2 * (term(F.col("ones"), n * share) + term(F.col("zeros"), n * (1 - share)))
    odds = F.log((F.col("ones") + 0.5) / (n1 + 1.0)) - F.log((F.col("zeros") + 0.5) / (n0 + 1.0))
    rows = counts.select("stem", odds.alias("odds"), evidence.alias("evidence")).filter(f"evidence >= {LEAST_EVIDENCE} AND odds >= 1.5").orderBy(F.desc("evidence"), "stem").limit(MAX_LEXICON).collect()
    learned: dict[str, float] = {}
    for stem, weight, _ in sorted(rows, key=lambda r: (len(r[0]), r[0])):
        if weight > max((learned[p] for p in (stem[:k] for k in STEMS) if p in learned and p != stem), default=0.0) + 0.5:
            learned[stem] = weight
    return learned


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray) -> None:
        self.lexicon, self.weights = lexicon, weights

    def scores(self, texts: list[bytes]) -> list[float]:
        if not texts:
            return []
        return learning.logistic(np.array([features(t.decode(errors="replace"), self.lexicon) for t in texts]), self.weights).tolist()

    def __getstate__(self) -> dict:
        return {"learned": self.lexicon.learned, "weights": self.weights}

    def __setstate__(self, state: dict) -> None:
        self.lexicon, self.weights = Lexicon(state["learned"]), state["weights"]


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, per_class: int = learning.MAX_PER_CLASS) -> Model:
    """Learn from labelled rows outside the held-out fold. Without labels of both classes only the fixed words count."""
    sample = materialise(learning.sample(docs, labels, "toxic", folds, fold, per_class), "sample")
    lexicon = Lexicon(learn_lexicon(sample))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.decode(errors="replace"), lexicon) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["label", "x"])

    rows = map_arrow(sample.select("label", "text"), run, "label int, x array<double>").collect()  # 2 * per_class at most
    y = np.array([r[0] for r in rows], float)
    x = np.array([r[1] for r in rows]).reshape(-1, 4)
    if not len(y) or y.min() == y.max():
        return Model(lexicon, np.array([1.0, 0.3, 0.5, 2.0, -3.0]))
    return Model(lexicon, learning.fit_logistic(x, y, 1e-3, learning.share(labels, "toxic", folds, fold)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # MAX_LEXICON entries at most
    return map_texts(docs, id_col, text_col, lambda ids, texts: {"doc_id": ids, "score": sent.value.scores(texts)}, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is below the limit, with all their columns."""
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)
    ddl = ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes))
    out, at = arrow_schema(docs.sparkSession, ddl), names.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array([s < limit for s in sent.value.scores(utf8(batch.column(at)))], pa.bool_()))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(kept.columns, out, strict=True)], schema=out)

    return map_arrow(docs.toDF(*[f"c{i}" for i in range(len(names))]), run, ddl).toDF(*names)
