"""Selectors, audits, small functions and readers on hand-made rows."""

import json
import os

from pyspark.sql import functions as F

from corpusgraph.functions import text
from corpusgraph.operators import audits, selectors
from corpusgraph.sources import files


def test_result_types(spark):
    want = {
        "func New(g *model.Graph) *Index": "Index", "func (x *T) Get() T": "T", "func f() (*other.T, error)": "", "func f()": "", "func f() ()": "", "func f(a, b int) (idx *Index, err error)": "Index", "func f() (a, b *T)": "T", "func f(cb func(int) (string, error)) Out": "Out",
        "func G[K comparable, V any](m map[K]V) Set[K]": "Set", "func f() (T, error)": "T", "func f(a func(func(int) int) int) X": "X", "func f() []T": "", "junk": "",
    }
    got = {r.s: r.t for r in spark.createDataFrame([(s,) for s in want], "s string").select("s", selectors.result_type(F.col("s")).alias("t")).collect()}
    assert got == want


def test_values_selectors_and_chains(spark):
    defs = spark.createDataFrame([("a/f.go#x", "a/f.go", "a", "x", "", "func x() *T"), ("a/g.go#y", "a/g.go", "a", "y", "", "func y() U"), ("a/g.go#z", "a/g.go", "a", "z", "", ""), ("a/f.go#z", "a/f.go", "a", "z", "", ""), ("a/g.go#T.run", "a/g.go", "a", "run", "T", ""), ("b/h.go#new", "b/h.go", "b", "new", "", "func new() T"), ("b/h.go#T.run", "b/h.go", "b", "run", "T", "")], "id string, file string, dir string, name string, owner string, signature string")
    raw = spark.createDataFrame([("1", "a/f.go", "a", "x"), ("2", "a/f.go", "a", "y"), ("3", "a/h.go", "a", "z"), ("4", "a/f.go", "a", "z"), ("5", "a/e_test.go", "a", "y"), ("6", "c/x.go", "c", "y")], "raw_id string, file string, dir string, name string")
    packages = spark.createDataFrame([("a/f.go", "a"), ("a/e_test.go", "a_test")], "file string, package string")
    found = selectors.resolve_values(raw, defs.select("id", "file", "dir", "name"), packages)
    assert {(r.raw_id, r.target, r.step) for r in found.collect()} == {("1", "a/f.go#x", "file"), ("2", "a/g.go#y", "directory"), ("4", "a/f.go#z", "file")}
    imports = spark.createDataFrame([("a/f.go", 1, "q", "b"), ("a/f.go", 2, "", "b"), ("a/f.go", 3, "_", "a"), ("a/f.go", 4, "out", None), ("a/f.go", 5, None, "a")], "file string, pos int, alias string, dir string")
    clauses = spark.createDataFrame([("b", "yaml"), ("a", "out")], "dir string, package string")
    asks = spark.createDataFrame([(str(i), "a/f.go", r, n) for i, (r, n) in enumerate([("q", "new"), ("yaml", "new"), ("b", "new"), ("out", "x"), ("_", "x"), ("yaml", "gone")])], "raw_id string, file string, receiver string, name string")
    assert {tuple(r) for r in selectors.resolve_selectors(asks, imports, clauses, defs.filter("owner = ''")).collect()} == {("0", "b/h.go#new"), ("1", "b/h.go#new")}
    calls = spark.createDataFrame([("c1", "1", "run"), ("c2", "2", "run"), ("c3", "0", "run")], "raw_id string, via string, name string")
    inner = spark.createDataFrame([("1", "a/f.go#x", False), ("2", "a/g.go#y", True), ("0", "b/h.go#new", True)], "raw_id string, target string, inferred boolean")
    assert {tuple(r) for r in selectors.resolve_chained(calls, inner, defs).collect()} == {("c1", "a/g.go#T.run", False), ("c3", "b/h.go#T.run", True)}


def test_audits(spark):
    changes = spark.createDataFrame([("p", "src/a"), ("p", "docs/wikipedia.md"), ("q", "src/a"), ("q", "docs/wiki/x"), ("r", "x"), ("s", "docs/wiki/x")], "project string, path string")
    wikis = spark.createDataFrame([("p", "docs/wiki"), ("q", "docs/wiki"), ("r", "."), ("s", "docs/wiki")], "project string, wiki string")
    assert [tuple(r) for r in audits.wiki_drift(changes, wikis).collect()] == [("p", 2)]
    areas = spark.createDataFrame([("a", True), ("a/b", False), ("c", False)], "scope string, shared boolean")
    sources = spark.createDataFrame([("a", str(i), r) for i, r in enumerate(["brain:a/x", "Brain:/c/y#z", "brain:ab", "brain://", "http://c", "brain:c?q", None])] + [("c", "9", "brain:c")], "scope string, path string, resource string")
    assert {(r.path, r.cited) for r in audits.wrong_direction(sources, areas).collect()} == {("1", "c/y"), ("2", "ab"), ("5", "c")}
    marked = spark.createDataFrame([("g/a.gd", "#mark\r\nx"), ("g/in/b.gd", "#mark"), ("h/c.gd", "#mark"), ("g/d.gd", "x\n#mark"), ("g/e.py", "#mark")], "path string, text string")
    settings, profiles = spark.createDataFrame([("g", "p"), ("g/in", "p")], "dir string, profile string"), spark.createDataFrame([("p", "#mark", ".gd")], "profile string, marker string, extension string")
    assert {r.path for r in audits.instrumented(marked, settings, profiles).collect()} == {"g/a.gd", "g/in/b.gd"}
    declared = spark.createDataFrame([("x", "go-test"), ("x", "ruff"), ("x", "go-vet")], "project string, tool string")
    lanes = spark.createDataFrame([("x", 1, "cargo test"), ("x", 2, " (go test ./...)"), ("x", 3, "go test;go vet"), ("x", 4, "truff ruffle")], "project string, pos int, lane string")
    gaps = audits.tool_gaps(declared, lanes)
    assert {(r.tool, r.lane) for r in gaps.collect()} == {("go-test", "(go test ./...)"), ("ruff", None), ("go-vet", "go test;go vet")} and round(audits.tool_coverage(gaps).first().covered, 4) == 66.6667


def test_small_functions(spark):
    row = spark.range(1).select(
        text.link_target(F.lit("a%20b+c?x#y")).alias("a"), text.link_target(F.lit("a%zz")).alias("b"), text.sortable_id(F.lit(5), F.lit("p"), F.lit("q")).alias("c"), text.sortable_id(F.lit(6), F.lit("p"), F.lit("q")).alias("d"), text.collection_name(F.lit("/A b//C_1/")).alias("e"),
        text.rendered_counts(F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(1))).alias("f"), text.stale(F.lit("x"), F.current_timestamp()).alias("g"), text.rooted(F.lit("a/../b")).alias("h"), text.rooted(F.lit("../b")).alias("i"), text.rooted(F.lit("a/..")).alias("j"),
    ).first()
    assert (row.a, row.b, row.e, row.f, row.g, row.h, row.i, row.j) == ("a b+c", "a%zz", "a-b-c-1", "a: 1, b: 2", None, "b", None, None)
    assert len(row.c) == 19 and row.c < row.d and row.c[9:] == row.d[9:]


def test_readers_of_state_and_reports(spark, tmp_path):
    os.makedirs(tmp_path / "s")
    for name, body in (("one.json", '{"blocks": 2, "base": "b"}'), ("bad.json", "{"), ("none.json", '{"x": 1}'), ("other.txt", '{"blocks": 1}')):
        (tmp_path / "s" / name).write_text(body)
    assert [tuple(r)[:3] for r in files.read_sessions(spark, str(tmp_path / "s")).collect()] == [("one", 2, "b")]
    (tmp_path / "t.json").write_text(json.dumps({"suite": "a", "at": "now", "results": [{"name": "x", "ms": 1.5, "runs": 3}, {"name": "b", "ms": 2.0, "runs": 1}]}, indent=1))
    rows = files.read_timings(spark, str(tmp_path / "t.json"))
    files.write_timings(rows, str(tmp_path / "out"))
    assert sorted(map(tuple, files.read_timings(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, rows.collect())) == [("a", "now", "b", 2.0, 1), ("a", "now", "x", 1.5, 3)]
    (tmp_path / "refs").write_text('{"main": "1", "dev": "2"}')
    assert {tuple(r) for r in files.read_refs(spark, str(tmp_path / "refs")).collect()} == {("main", "1"), ("dev", "2")}
    pages = spark.createDataFrame([("d/b c.md", "B", "second"), ("d/a.md", None, None), ("d/index.md", "I", ""), ("d/e/f/x.md", "X", ""), ("top.md", "T", "t")], "path string, title string, description string")
    assert [tuple(r) for r in files.catalog_rows(pages).orderBy("dir", "place").collect()] == [("", 1, "* [T](top.md) - t"), ("", 2, "* [d](d/)"), ("d", 1, "* [a.md](a.md)"), ("d", 2, "* [B](b%20c.md) - second"), ("d", 3, "* [e](e/)"), ("d/e", 1, "* [f](f/)"), ("d/e/f", 1, "* [X](x.md)")]
    files.write_catalogs(pages, str(tmp_path / "cat"))
    assert [r.value for r in spark.read.text(f"{tmp_path}/cat/dir=d").collect()] == ["* [a.md](a.md)", "* [B](b%20c.md) - second", "* [e](e/)"]
    (tmp_path / "p.diff").write_text("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1,2 @@\n-a\n+b\n+c\ndiff --git a/y b/y\n--- a/y\n+++ b/y\n@@ -3 +2,0 @@\n-gone\n")
    assert [(r.path, r.line_from, r.line_to, r.lines) for r in files.read_patches(spark, str(tmp_path / "p.diff")).orderBy("hunk").collect()] == [("x", 1, 2, ["-a", "+b", "+c"]), ("y", 2, 2, ["-gone"])]
