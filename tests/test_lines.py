"""Line state, diffs, markers and ignore rules against plain Python."""

import random

from corpusgraph.operators import ignore, line_state, references

LINES = "path string, line_no long, line string"


def as_lines(spark, files):
    return spark.createDataFrame([(p, i + 1, x) for p, text in files.items() for i, x in enumerate(text)], LINES)


def test_fences_of_two_kinds(spark):
    rng = random.Random(1)
    files = {f"f{i}": [rng.choice(["```", "~~~ sql", " ```py", "text", "> [!conflict]"]) for _ in range(rng.randrange(0, 40))] for i in range(60)}
    for matching in (True, False):
        want = set()
        for path, text in files.items():
            fence = ""
            for i, x in enumerate(text):
                kind = next((k for k in ("```", "~~~") if x.strip().startswith(k)), "")
                inside = bool(fence or kind)
                if fence:
                    fence = "" if kind and (kind == fence or not matching) else fence
                else:
                    fence = kind
                want.add((path, i + 1, x, inside))
        assert {tuple(r) for r in line_state.fences(as_lines(spark, files), matching=matching).collect()} == want


PATCH = """diff --git a/x b/x
--- a/x
+++ b/x
@@ -1,2 +1,2 @@ def
--- a/not a header
 same
-old
+new
\\ No newline at end of file
@@ -9 +8,0 @@
-gone
@@ -3,1 +0,0 @@
-top
diff --git a/y b/y
--- a/y
+++ /dev/null
@@ -1,40 +0,0 @@
""".split("\n")[:-1] + [f"-line {i}" for i in range(40)] + [x for n in range(12) for x in ("--- /dev/null", "+++ b/z", f"@@ -0,0 +{n * 30 + 1},20 @@", *[f"+{n} {i}" for i in range(20)])]


def test_hunks_follow_their_counts_and_caps(spark):
    patch = list(PATCH)
    patch[3] = "@@ -1,3 +1,2 @@ def"
    got = sorted(tuple(r) for r in line_state.hunks(as_lines(spark, {"d": patch})).collect())
    head = [(f, h, a, b, len(x), o) for _, f, h, a, b, x, o in got]
    assert head[:4] == [("x", 1, 1, 2, 3, 0), ("x", 2, 8, 8, 1, 0), ("x", 3, 1, 1, 1, 0), ("y", 4, 1, 1, 24, 16)]
    assert got[0][5] == ["--- a/not a header", "-old", "+new"]
    assert head[4:] == [("z", 5 + n, n * 30 + 1, n * 30 + 20, 20 if n < 10 else 0, 0 if n < 10 else 20) for n in range(12)]


def test_change_listings(spark):
    rows = [("a", "M\x00x\x00R100\x00old\x00new\x00A\x00M\x00"), ("b", "Q\x00x\x00"), ("c", "M\x00"), ("d", "U\x00x\x00"), ("e", ""), ("f", None), ("g", "C75\x00one\x00")]
    got = {tuple(r) for r in line_state.name_status(spark.createDataFrame(rows, "path string, text string"), "text").collect()}
    assert got == {("a", "M", "x", None, None), ("a", "R", "new", "old", None), ("a", "A", "M", None, None), *[(p, None, None, None, m) for p, m in (("b", "unknown status"), ("c", "status without a path"), ("d", "unmerged"), ("g", "status without a path"))]}


def test_markers_and_their_reasons(spark):
    files = {
        "a.py": ["x = 1  # coverage:exempt: slow", "# coverage:exempt - why", "y", 's = "coverage:exempt"', "a -- coverage:exempt", "-- coverage:exempt", "z", "# coverage:exempt-files"],
        "b.py": ["// coverage:exempt-file"], "c.py": ["# coverage:exempt-file: made */ x", "# begin", "a", "# begin", "b", "# end", "# end", "c", "# begin", "d"], "d.go": ["# begin"],
        "e.py": ["# a reason", "x  # nocov", "x  # nocov because", "# nocov", "y", "[Exclude]", "f()", "[Exclude] g()"],
    }
    natives = [line_state.Marker("nocov", "nocov", (".py",)), line_state.Marker("block", "begin", (".py",), "start", True), line_state.Marker("block", "end", (".py",), "stop", True), line_state.Marker("attr", r"\[Exclude\]", (".py",), "", True)]
    lines, whole, found = line_state.exemptions(as_lines(spark, files), natives)
    assert {tuple(r) for r in lines.collect()} == {("a.py", 1, True, True), ("a.py", 3, True, True), ("a.py", 7, True, False)} | {("c.py", n, False, False) for n in (2, 3, 4, 5, 6, 9, 10)} | {("e.py", n, False, False) for n in (2, 3, 4, 5, 6, 7, 8)}
    assert {tuple(r) for r in whole.collect()} == {("b.py", True, False, False), ("c.py", True, True, False)}
    assert {tuple(r) for r in found.collect()} == {("b.py", 0, "coverage:exempt-file without a reason"), ("c.py", 9, "block without a stop"), ("e.py", 4, "nocov without a reason")}


def test_last_rule_decides(spark):
    rules = [
        (0, "", 1, "*.log"), (1, "", 1, "secret/"), (2, "", 1, "# comment"), (2, "", 2, "  "), (2, "", 3, "build/"), (2, "", 4, "!keep.log"), (2, "", 5, "/top.txt"), (2, "", 6, "a/**/z.md"), (2, "", 7, "tail "), (2, "", 8, "sp\\ "),
        (2, "", 9, "[!a-c]1.py"), (2, "", 10, "\\!odd"), (2, "", 11, "x.?s"), (2, "sub", 1, "!*.log"), (2, "sub", 2, "!build/"), (2, "sub/deep", 1, "*.log\r"), (2, "", 12, "abc/**"), (2, "", 13, "q+(1).md"),
    ]
    want = {
        "a.log": True, "keep.log": False, "d/keep.log": False, "top.txt": True, "d/top.txt": False, "build/x/y.py": True, "build": False, "secret/k": True, "a/z.md": True, "a/b/c/z.md": True, "b/a/z.md": False, "tail": True, "sp ": True,
        "d1.py": True, "a1.py": False, "!odd": True, "x.js": True, "x.jjs": False, "sub/a.log": False, "sub/build/x": False, "sub/deep/a.log": True, "sub/deep/keep.log": True, "abc/d/e": True, "abc": True, "q+(1).md": True, "qq(1).md": False, "build/tracked": False,
    }
    files = spark.createDataFrame([(p, p.endswith("tracked")) for p in want for _ in range(2)], "path string, kept boolean")
    got = ignore.ignored(files, ignore.parse_rules(spark.createDataFrame(rules, "level int, base string, line_no int, line string")), tracked="kept").collect()
    assert len(got) == 2 * len(want) and {r.path: r.ignored for r in got} == want


def test_references_outside_fences(spark):
    files = {"docs/p.md": ["see `src/a.py:3-9` and `src/b/../c.py`, `plain`, `/abs/x.py`, [x](../src/d.py#L1), [out](../../e.py), [w](https://h/x), `.git/config`", "```", "`src/no.py`", "```", "[two", "lines](q.py) ![i](img/z.png) `dir/` `../up/x`"]}
    got = {tuple(r) for r in references.document_refs(as_lines(spark, files)).collect()}
    assert got == {("docs/p.md", p, a, b) for p, a, b in (("src/a.py", 3, 9), ("src/c.py", None, None), ("src/d.py", None, None), ("docs/q.py", None, None), ("docs/img/z.png", None, None), ("dir", None, None))}
    links = references.code_links(references.document_refs(as_lines(spark, files)), spark.createDataFrame([("src/a.py",), ("dir/x",)], "path string"), spark.createDataFrame([("src/a.py", "A", 1, 20), ("src/a.py", "B", 2, 5)], "path string, id string, span_from int, span_to int"))
    assert {(r.path, r.symbol, r.missing) for r in links.collect()} == {("src/a.py", "B", False), ("dir", None, False), *[(p, None, True) for p in ("src/c.py", "src/d.py", "docs/q.py", "docs/img/z.png")]}
