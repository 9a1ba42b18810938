"""Whitening, ranked search and the license scan on small tables, against plain versions."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from corpusgraph.llm import lexical_search, license_rules, license_scan, registry, whitening
from corpusgraph.llm.common import word_bytes

SF = "/root/testdata/sf0.001"


# Whitening.


def plain_whitening(vectors, k=4):
    x = np.floor(256 * np.array(vectors, dtype=np.float64)).astype(np.int64)
    once = np.unique(x, axis=0)
    n, sums = len(once), once.sum(axis=0)
    c = once - sums / n
    values, parts = np.linalg.eigh(c.T @ c / n)
    values, parts = values[::-1][:k], parts[:, ::-1][:, :k]
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ (parts / np.sqrt(values)), values / (c**2).sum() * n


def vectors_of(n, d, seed):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) * np.exp(-np.arange(d) / 4)).astype(np.float32)


def test_whitening_by_plain_eigenvectors(spark):
    v = vectors_of(300, 12, 1)
    v[50:120] = v[3]  # a hot vector counts once
    rows = [(i, [float(e) for e in x], 1.0) for i, x in enumerate(v)]
    rows += [(900, None, 1.0), (901, [1.0] * 11 + [None], 1.0), (902, [1.0] * 11 + [float("nan")], 1.0), (903, [1.0] * 11 + [float("-inf")], 1.0), (904, [1.0], 1.0), (905, [], 1.0), (None, rows[7][1], 1.0), (7, rows[7][1], 1.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened double").withColumns({c: F.lit(1) for c in ("x", "n", "dim", "part", "component")})
    model = whitening.fit(df)
    n, deviation, want, explained = plain_whitening([*v, v[7], v[7]])
    got = whitening.whiten(df, model).collect()
    assert len(got) == 4 * 302 and model.n == n == len(np.unique(np.floor(256 * v), axis=0))
    for r in got:
        at = 7 if r.vec_id is None else r.vec_id
        assert r.n == n and r.deviation == deviation[at] and abs(abs(r.whitened) - abs(want[at, r.component - 1])) < 1e-9
        assert abs(r.explained - explained[r.component - 1]) < 1e-12 and r.identity_error < 1e-9
    for c in range(1, 5):
        mine = np.array([r.whitened for r in sorted((r for r in got if r.component == c and r.vec_id is not None), key=lambda r: r.vec_id)])
        plain = np.array([want[i, c - 1] for i in sorted([*range(300), 7])])
        assert min(np.abs(mine - plain).max(), np.abs(mine + plain).max()) < 1e-9


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    of = lambda rows: whitening.whiten(d := spark.createDataFrame(rows, schema), whitening.fit(d)).collect()
    assert of([]) == [] and of([(1, None)]) == [] and of([(1, [])]) == []
    assert of([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    line = of([(1, [1.0, 2.0, 3.0]), (2, [2.0, 4.0, 6.0]), (3, [3.0, 6.0, 9.0])])
    assert {r.component for r in line} == {1} and all(abs(r.explained - 1) < 1e-12 for r in line)


def test_leading_pairs_by_dense_solver():
    for d, n, seed in ((64, 400, 1), (5, 40, 2), (90, 3, 3), (200, 500, 4), (30, 1000, 5)):
        x = np.floor(256 * np.random.default_rng(seed).standard_normal((n, d)))
        c = x - x.mean(axis=0)
        v = c.T @ c / n
        jobs = []
        values, parts = whitening.leading(lambda b: jobs.append(1) or c.T @ (c @ b) / n, d, 4)  # noqa: B023
        want = np.sort(np.linalg.eigvalsh(v))[::-1][:4]
        assert np.abs(values - want).max() < 1e-13 * want[0] and np.linalg.norm(v @ parts - parts * values, axis=0).max() < 1e-13 * want[0] and len(jobs) < 120


# Ranked search.


def plain_rank(docs, items, k):
    words = [word_bytes((t or "").encode()) for _, t in docs]
    n_docs, total = sum(1 for w in words if w), sum(map(len, words))
    df = {}
    for w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for (doc, _), w in zip(docs, words, strict=True):
            score = 0
            for t in set(word_bytes((text or "").encode())):
                tf = w.count(t)
                if tf:
                    m = 10 + (90 * len(w) * n_docs) // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if score:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if null else doc, -score) for r, (score, null, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def some_texts(n, seed, length=(0, 1, 5, 30)):
    rng = random.Random(seed)
    common, rare = "the of and to in is".split(), [f"w{i}" for i in range(300)]
    return [" ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(rng.choice(length))) for _ in range(n)]


def test_rank_by_scoring_every_document(spark):
    docs = [(i, t) for i, t in enumerate(some_texts(600, 1))]
    docs += [(None, docs[5][1]), (None, "The OF w7"), (3, docs[3][1]), (700, None), (701, "w1 " * 5000), (702, "é漢 W1-w2_the"), (703, "  ")]
    items = [(i, t) for i, t in enumerate(some_texts(40, 2, (1, 4, 12)))] + [(90, None), (91, ""), (92, "unheard words"), (None, "w3 w4 the"), (0, "the of w9")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "terms", "score", "rank", "query", "item_id")})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("query", "doc_id", "rank")})
    for k in (1, 10, 1000):
        got = sorted((tuple(r) for r in lexical_search.rank(frame, asked, k).collect()), key=repr)
        assert got == plain_rank(docs, items, k)
    assert lexical_search.rank(frame.limit(0), asked).count() == 0 and lexical_search.rank(frame, asked.limit(0)).count() == 0
    assert lexical_search.rank(frame.select("doc_id", F.lit(None).cast("string").alias("text")), asked).columns == ["item_id", "rank", "doc_id", "score"]


def test_pair_bounds_skip_and_lose_nothing():
    texts = some_texts(3000, 4, (3, 10, 40))
    queries = lexical_search.read_queries([t for t in some_texts(30, 5, (6, 12))])
    words = [word_bytes(t.encode()) for t in texts]
    rows = [[(queries.vocabulary[w], ws.count(w)) for w in dict.fromkeys(ws) if w in queries.vocabulary] for ws in words]
    sizes, total = [len(w) for w in words], sum(map(len, words))
    df = np.bincount([t for r in rows for t, _ in r], minlength=len(queries.vocabulary))
    weight, pairs = lexical_search.weights(len(texts), df), lexical_search.shared_pairs(queries, df)
    blocks = []
    for at in range(0, 3000, 600):
        part = rows[at : at + 600]
        blocks.append(lexical_search.Block(lexical_search.build_block(list(range(at, at + 600)), sizes[at : at + 600], [np.array([t for t, _ in r], dtype=np.int32) for r in part], [np.array([c for _, c in r], dtype=np.int32) for r in part], weight, pairs, len(texts), total)))
    number = {tuple(p): i for i, p in enumerate(pairs.tolist())}
    looked = {True: 0, False: 0}
    for terms in queries.terms:
        place = {t: i for i, t in enumerate(terms.tolist())}
        offers = [(p, place[a], place[b]) for (a, b), p in number.items() if a in place and b in place]
        lists = []
        for paired in (True, False):
            best = lexical_search.Best(10)
            looked[paired] += sum(b.search(terms, offers if paired else [], best)[0] for b in blocks)
            lists.append((best.score.tolist(), best.id.tolist()))
        whole = {}
        for i, r in enumerate(rows):
            for t, c in r:
                if t in place:
                    whole[i] = whole.get(i, 0) + int(lexical_search.impacts(weight[t], np.int64(c), np.int64(sizes[i]), len(texts), total))
        want = sorted(((-s, i) for i, s in whole.items() if s))[:10]
        assert lists[0] == lists[1] == ([-s for s, _ in want], [i for _, i in want])
    assert looked[True] < looked[False] < len(queries.terms) * 3000


# License scan.

SAMPLES = [
    "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0 OR MIT", "This work is licensed under the GNU General\n * Public License, version 3.", "Licensed under CC BY-NC 4.0.", "cc by sa", "CC\nBY",
    "Creative Commons Attribution-ShareAlike 3.0", "https://creativecommons.org/licenses/by-nd/2.5/", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Redistribution and use in source and binary forms, with or without modification, are permitted", "New BSD License", "three-clause BSD", "zlib license", "\"license\": \"GPL-2.0-or-later\"", "mozilla public license 2.0", "MPL 2.0", "Copyright (c) 2019 Someone. All rights reserved.",
    "released into the public domain", "CC0 1.0 Universal", "the Unlicense", "AGPLv3", "LGPL v2.1", "gnu gpl", "BSD-style license", "Do what the fuck you want to public license", "EUPL 1.2", "Boost Software License 1.0", "OpenRAIL-M", "Llama 3 Community License", "PHP license 3.01",
    "Neither the name of the Foo Project nor the names of its contributors may be used to endorse or promote products derived from this software", "http://www.gnu.org/licenses/old-licenses/gpl-2.0.html", "Python Software Foundation License", "server-side public license", "mit", "mit der licen", "gnu general public", "",
]


def plain_scan(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    base = sorted((i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    found = []
    for i, rule in enumerate(license_rules.RULES):
        found += [(i, *m.span("hit" if "hit" in rule.pattern.groupindex else 0)) for m in rule.pattern.finditer(low)]
    level = lambda d: license_rules.RULES[d[0]].priority
    beats = lambda a, b: (level(a), a[1] - a[2], a[0]) < (level(b), b[1] - b[2], b[0])
    kept = [d for d in found if not any(e[1] <= d[1] and d[2] <= e[2] and beats(e, d) for e in found)]
    return len(words), base, sorted(kept, key=lambda d: (d[1], d[2], d[0]))


def test_scan_by_all_rules_without_gates():
    rng = random.Random(3)
    texts = SAMPLES + [" ".join(rng.choice(SAMPLES + ["é word", "plain text. ", "cc", "apache", "license"]) for _ in range(rng.randrange(1, 9))) for _ in range(120)]
    for t in texts:
        assert license_scan.scan_text(t.encode()) == plain_scan(t), t
    hit = {license_rules.RULES[i].label for t in SAMPLES for i, _, _ in license_scan.scan_text(t.encode())[2]}
    assert len(license_rules.RULES) > 300 and {"apache-2.0", "mit", "gpl-3.0", "gpl-2.0", "cc-by-nc-4.0", "cc-by-nd-2.5", "bsd-3-clause", "cc0-1.0", "mpl-2.0", "lgpl-2.1", "agpl-3.0"} <= hit


def test_scan_of_odd_rows(spark):
    rows = [(1, "Licensed under the Apache License, Version 2.0."), (2, None), (3, ""), (None, "MIT License"), (1, "cc by"), (4, "word " * 40_000 + "mit license")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n_words", "base", "detections", "score")})
    got = {(r.doc_id, r.n_words, len(r.base), ",".join(d.label for d in r.detections), r.score) for r in license_scan.scan(df).collect()}
    assert got == {(1, 8, 1, "apache-2.0", 0.9), (2, 0, 0, "", 0.0), (3, 0, 0, "", 0.0), (None, 2, 1, "mit", 0.9), (1, 2, 1, "cc-by", 0.7), (4, 40_002, 1, "mit", 0.9)}
    assert license_scan.scan(df.limit(0)).count() == 0


def test_license_query_keeps_base_labels(spark):
    got = registry.queries()["op13_license_scan"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        n, base, kept = plain_scan(texts[r.doc_id] or "")
        labels = {b for _, b in base}
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(base), *((base[0][0], base[-1][0]) if base else (None, None)))
        assert r.base_labels == ",".join(sorted(labels)) and r.labels == ",".join(sorted(labels | {license_rules.RULES[i].label for i, _, _ in kept})) and 0 <= r.score <= 1
