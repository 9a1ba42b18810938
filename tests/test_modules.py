"""Releases, merge events, collapsed views, headers and canonical JSON on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import canonical
from corpusgraph.operators import collapse, headers, merges, scouting
from corpusgraph.sources import files

SUBJECTS = "pos int, fixture string, stack string, kind string, name string, version string, held boolean"
RELEASES = "kind string, name string, version string, pre boolean"


def test_newest_release_of_each_line(spark):
    subjects = [
        (1, "f", "a", "runtime", "go", "1.27", False), (2, "f", "a", "runtime", "go", "1.25", False), (3, "f", "a", "runtime", "go", "0.9", False), (4, "g", "a", "runtime", "node", "26", False), (5, "g", "b", "runtime", "node", "24", False), (6, "g", "a", "runtime", "node", "22", False),
        (7, "h", "a", "runtime", "node", "24", False), (8, "f", "a", "crate", "lib", "0.4", False), (9, "f", "a", "runtime", "held", "1.0", True), (10, "k", "a", "crate", "tail", "4.1", False), (11, "k", "a", "runtime", "py", "3.14", False), (12, "k", "a", "runtime", "py", "x", False),
    ]
    releases = [
        *[("runtime", "go", v, "rc" in v or "beta" in v) for v in ("1.27.4", "v1.26.1", "1.28rc1", "1.28beta2", "1.28rc10", "1.28rc2", "0.10.1", "junk")], ("runtime", "node", "27.0.0-alpha.0.0.0", True), ("runtime", "node", "27.0.0-alpha.2", True), ("runtime", "node", "24.9", False),
        ("crate", "lib", "0.5", True), ("crate", "lib", "0.4.9", False), ("runtime", "held", "9.0", False), ("crate", "tail", "5.0", False), ("crate", "tail", "4.2.3", False), ("runtime", "py", "3.15", False), ("runtime", "py", "3.16.0a1", True), ("runtime", "py", "4.0", False), ("runtime", "py", "3.20", True),
    ]
    frames = spark.createDataFrame(subjects, SUBJECTS), spark.createDataFrame(releases, RELEASES)
    got = {(r.fixture, r.stack, r.name, r.major, r.found, r.version) for r in scouting.newest(*frames, followers=("tail",)).collect()}
    # A held line asks for nothing; patches never count; the highest major of each stack of a fixture that holds the highest looks for a greater one.
    assert got == {("f", "a", "go", 1, "pre", "1.28rc10"), ("f", "a", "go", 0, "new", "0.10"), ("g", "a", "node", 26, "pre", "27.0.0-alpha.2"), ("g", "b", "node", 24, "pre", "27.0.0-alpha.2"), ("k", "a", "tail", 4, "new", "4.2"), ("k", "a", "py", 3, "new", "4.0")}


def test_settled_announcements(spark):
    subjects = spark.createDataFrame([(1, "f", "a", "runtime", "go", "1.27", False), (2, "f", "b", "crate", "go", "2.1", False), (3, "g", "a", "runtime", "py", "3", False)], SUBJECTS)
    titles = ["f/go 1.27 is out", "f/go 1.28 is out", "f@b/go 1.0 is out", "f@b/crate:go 2.0.9 is out", "f/go 1.27.5 is out", "g/py 3.1 is out", "g/py 3.16.0a1 is out", "g/py 3.16.0a2 is out", "py 3 is past end of support", "py 2 is past end of support", "odd"]
    got = {r.title: (r.resolved, r.superseded) for r in scouting.settled(spark.createDataFrame([(t,) for t in titles], "title string"), subjects, spark.createDataFrame([("g/py 3.16.0a2 is out",)], "title string")).collect()}
    yes, no = (True, False), (False, False)
    assert got == {titles[0]: yes, titles[1]: no, titles[2]: no, titles[3]: yes, titles[4]: no, titles[5]: no, titles[6]: (False, True), titles[7]: no, titles[8]: no, titles[9]: yes, "odd": no}


def test_merges_land_whole_or_wait(spark):
    events = spark.createDataFrame([(1, "r1", ["x"]), (2, "r1", ["y"]), (3, "r1", ["x"]), (4, "r2", ["x"]), (5, "r2", ["z"]), (6, "r3", ["x"]), (7, "none", ["x"]), (8, "r4", ["x"]), (9, "r1", [])], "event int, repo string, evidence array<string>")
    areas = spark.createDataFrame([(f"a{i}", f"r{i}") for i in (1, 2, 3, 4)], "scope string, repo string")
    pages = spark.createDataFrame([("a1", "p", "planned"), ("a1", "q", "planned"), ("a1", "done", "implemented"), ("a2", "p", "partial"), ("a2", "q", "planned"), ("a3", "p", "planned"), ("a3", "q", "planned"), ("a4", "p", "implemented")], "scope string, path string, state string")
    cases = spark.createDataFrame([("a2", "p", "merge", "has x and w"), ("a3", "p", "source", "x"), ("a1", "done", "source", "")], "scope string, path string, trigger string, package string")
    decided, new = merges.land(events, areas, pages, cases, ["planned", "partial"])
    assert {(r.event, r.decision) for r in decided.collect()} == {(1, "landed"), (2, "deferred"), (3, "landed"), (4, "landed"), (5, "deferred"), (6, "deferred"), (7, "unknown"), (8, "landed"), (9, "landed")}
    assert {tuple(r) for r in new.collect()} == {("a1", "p", 1), ("a1", "q", 1), ("a2", "q", 4)}
    # What waits comes with the next batch, against the cases that then stand.
    later = spark.createDataFrame([("a1", "p", "merge", "x\ny"), ("a1", "q", "merge", "y"), ("a2", "p", "merge", "x"), ("a2", "q", "merge", "x")], cases.schema)
    again = events.join(decided.filter("decision = 'deferred'").select("event"), "event")
    assert {(r.event, r.decision) for r in merges.land(again, areas, pages, later, ["planned", "partial"])[0].collect()} == {(2, "landed"), (5, "deferred"), (6, "landed")}


def test_view_opens_from_the_top(spark):
    nodes = spark.createDataFrame([(i, p) for p in ("a/b/f.py", "a/c/g.py", "d/h.py", "top.py") for i in (p, f"{p}#s", f"{p}#t")], "id string, path string")
    opened = spark.createDataFrame([(x,) for x in ("a", "a/b", "a/b/f.py", "d/h.py", "gone")], "element string")
    edges = [("a/b/f.py#s", "a/b/f.py#t", "calls"), ("a/b/f.py#s", "d/h.py#s", "calls"), ("a/b/f.py#s", "d/h.py#t", "calls"), ("d/h.py#s", "d/h.py#t", "calls"), ("a/c/g.py#s", "top.py", "calls"), ("a/c/g.py", "a/c/g.py#s", "contains"), ("a/b/f.py", "ext:x", "calls")]
    elements, rolled = collapse.view(nodes, spark.createDataFrame([(*e, "extracted") for e in edges], "source string, target string, relation string, confidence string"), opened, ["calls"])
    assert {tuple(r) for r in elements.collect()} == {("a/b/f.py", "file", 1), ("a/b/f.py#s", "symbol", 1), ("a/b/f.py#t", "symbol", 1), ("a/c", "directory", 3), ("d", "directory", 3), ("top.py", "file", 3)}
    assert {tuple(r) for r in rolled.collect()} == {("a/b/f.py#s", "a/b/f.py#t", "calls/extracted", 1), ("a/b/f.py#s", "d", "calls/extracted", 2), ("a/c", "top.py", "calls/extracted", 1)}
    docs = spark.createDataFrame([("x.md",), ("y.md",), ("z.md",)], "path string")
    links = spark.createDataFrame([("x.md", "y.md"), ("x.md", "y.md"), ("x.md", "x.md"), ("x.md", "no.md")], "source string, target string")
    refs = spark.createDataFrame([("x.md", "y.md", None), ("x.md", "z.md", None), ("x.md", "a/b/f.py", "a/b/f.py#s"), ("x.md", "a/b", None), ("x.md", "d/h.py", None), ("x.md", "nowhere", None), ("y.md", "d", None), ("out.md", "d", None)], "page string, path string, symbol string")
    shown, joined = collapse.with_documents(nodes, opened, docs, links, refs)
    assert {(r.path, tuple(r.missing)) for r in shown.collect()} == {("x.md", ("nowhere",)), ("y.md", ()), ("z.md", ())}
    assert {tuple(r) for r in joined.collect()} == {("x.md", "y.md", "link", 2), ("x.md", "z.md", "link", 1), ("x.md", "a/b/f.py#s", "ref", 1), ("x.md", "a/b", "ref", 1), ("x.md", "d", "ref", 1), ("y.md", "d", "ref", 1)}


PAGE = """---
title: 'A page'
type: Attested Computation
# remark
tags:
  - one
  - "two words"
sources:
  - id: s1
    resource: r1
  - resource: r2
generated:
  by:
runtime:
---
[a](x.md#s) ![p](pic.png) [[wiki link|shown]] ![[embed]] [e](https://h/x)
"""


def test_headers_and_their_findings(spark):
    rows = [("d/p.md", PAGE), ("q.md", "plain"), ("index.md", "---\nokf: 1\nmore: 2\n---\n"), ("d/index.md", "---\r\nokf: 1\r\n---\r\n"), ("r.md", "---\ntitle: x"), ("s.md", "---\na: 1\n}{\n---\n"), ("t", None), ("u.md", "---\ntags: [x, 'y']\ntype: z\n---\n")]
    pages = headers.read_pages(spark.createDataFrame(rows, "path string, text string").withColumns({c: F.lit(1) for c in ("title", "links", "body")}))
    got = {r.path: r for r in pages.collect()}
    p = got["d/p.md"]
    assert (p.title, p.type, p.tags, p.sources, p.generated, p.links) == ("A page", "Attested Computation", ["one", "two words"], [{"id": "s1", "resource": "r1"}, {"resource": "r2"}], {"by": ""}, ["https://h/x", "wiki link", "x.md#s"])
    assert [(got[x].title, got[x].has_header, got[x].broken) for x in ("q.md", "r.md", "s.md", "t")] == [("q", False, None), ("r", False, "no end"), ("s", True, "}{"), ("t", False, None)]
    assert got["u.md"].tags == ["x", "y"] and got["d/index.md"].keys == ["okf"]
    found = {(r.path, r.rule, r.message) for r in headers.header_findings(pages, "okf").collect()}
    assert found == {("d/p.md", "generated-by-missing", ""), ("d/p.md", "computation-runtime-missing", ""), ("d/p.md", "source-id-missing", "sources[1]"), ("index.md", "index-frontmatter-misplaced", "not allowed: more"), ("d/index.md", "index-frontmatter-misplaced", "only the root catalog may have a header"), ("r.md", "frontmatter-unparsable", "no end"), ("s.md", "frontmatter-unparsable", "}{")}


def test_catalog_entries(spark):
    text = "* [a](a.md) - first\n[f](f.md) one [g](g.md) two [h](h.md) three\n* [b](b%20c.md?x=1#y) —\n[c](/d/c.md) text [d](../d/d.md)\n[s](sub/) [l](log.md)\n[t](e.md \"title\")"
    rows = [("d/index.md", text)] + [(f"d/{x}.md", "") for x in ("a", "b c", "c", "d", "e", "log")] + [("d/sub/x.md", ""), ("f/y.md", "")]
    pages = headers.read_pages(spark.createDataFrame(rows, "path string, text string"))
    assert {(r.target, r.description) for r in headers.entries(pages).collect()} == {("a.md", "first"), ("f.md", "one [g](g.md) two [h](h.md) three"), ("g.md", "two [h](h.md) three"), ("h.md", "three"), ("b%20c.md?x=1", ""), ("/d/c.md", "text [d](../d/d.md)"), ("../d/d.md", ""), ("sub/", "[l](log.md)"), ("log.md", "")}
    assert {r.message for r in headers.undescribed(pages).collect()} == {"b%20c.md?x=1", "../d/d.md"}
    assert {tuple(r)[::3] for r in headers.unlisted(pages).collect()} == {("d/index.md", "e.md")}


def test_canonical_json_and_strict_keys(spark, tmp_path):
    rows = ['{"b": 1, "a": {"z": [3, {"y": 1, "x": 2}], "e": "q\\"é"}}', '{"a":{"e":"q\\"é","z":[3,{"x":2,"y":1}]},"b":1}', "nope", None]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select(canonical.canonical_json(F.col("t")).alias("c"), canonical.json_hash(F.col("t")).alias("h"), canonical.field(F.col("t"), "$.a.z[1].x", "int").alias("x")).collect()
    assert got[0].c == json.dumps(json.loads(rows[0]), sort_keys=True, separators=(",", ":"), ensure_ascii=False) and got[0][:2] == got[1][:2] and got[0].x == 2 and got[2].c is None and got[3].x is None
    row = {"run": "r", "node": "n", "seq": 1, "input_hash": "h", "outcome": "done", "seconds": 0.5}
    for name, changed in (("good", row), ("more", row | {"extra": 1}), ("less", {k: v for k, v in row.items() if k != "seq"})):
        (tmp_path / name).write_text(json.dumps(changed) + "\n")
    assert tuple(files.read_journal(spark, str(tmp_path / "good")).first()) == ("r", "n", 1, "h", "done", 0.5)
    for name, word in (("more", "unknown: extra"), ("less", "missing: seq")):
        with pytest.raises(Exception, match=word):
            files.read_journal(spark, str(tmp_path / name)).collect()
