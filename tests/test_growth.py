"""Rows inside a job grow with its input: operators that once paired all with all; and rounding as SQL does it."""

import os
import time

import duckdb
from pyspark.sql import functions as F

from corpusgraph.checkpoint import CLEANUP, cut
from corpusgraph.functions.text import grams
from corpusgraph.operators import bundles, callers, collapse, exports, graph, ignore, impact, line_state, merges, reports, resolution, search, selection, selectors
from corpusgraph.plans import registry, views
from corpusgraph.sources import files, index


def most_rows(df):
    """The most rows that any one step of the executed plan gave."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        plan = todo.pop()
        name, metrics, children = plan.getClass().getSimpleName(), plan.metrics(), plan.children()
        if metrics.contains("numOutputRows"):
            most = max(most, metrics.apply("numOutputRows").value())
        todo += [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else []
        todo += [children.apply(i) for i in range(children.size())]
    return most


def test_bridges_of_a_common_name_pair_no_uses_with_offers(spark):
    uses = spark.createDataFrame([(f"u{i}", "k", "n" if i else "m", f"f{i % 7}", i) for i in range(300)], "source string, namespace string, name string, file string, line int")
    offers = [(f"t{i}", "k", "n", None if i % 3 else ["f1", "f2", None]) for i in range(300)] + [("only", "k", "m", ["f0"]), ("only", "k", "m", []), ("x", "k", "m", ["f5"])]
    offers = spark.createDataFrame(offers, "target string, namespace string, name string, scope array<string>")
    found = resolution.bridge(uses, offers, spark.createDataFrame([("u9", "t9")], "source string, target string"))
    assert [tuple(r) for r in found.collect()] == [("u0", "only", 0)]
    assert most_rows(found) < 1000


def test_shared_lists_of_imports_resolve_like_imports_of_each_file(spark):
    raw = spark.createDataFrame([(str(i), f"f{i}", r, "go") for i, r in enumerate(["al", "p", "q", "al", "none"])], "raw_id string, file string, receiver string, name string")
    lists = spark.createDataFrame([(f"f{i}", i % 2) for i in range(5)], "file string, list int")
    imports = spark.createDataFrame([(0, 2, "al", "a"), (0, 1, "", "b"), (0, 3, "", "c"), (1, 1, "al", None), (1, 2, "", "a"), (1, 4, None, "c")], "file int, pos int, alias string, dir string")
    clauses = spark.createDataFrame([("b", "q"), ("c", "q"), ("a", "p")], "dir string, package string")
    functions = spark.createDataFrame([(f"{d}#go", d, "go") for d in "abc"], "id string, dir string, name string")
    each = imports.withColumnRenamed("file", "list").join(lists, "list").drop("list")
    want = {tuple(r) for r in selectors.resolve_selectors(raw, each, clauses, functions).collect()}
    assert {tuple(r) for r in selectors.resolve_selectors(raw, imports, clauses, functions, lists).collect()} == want == {("0", "a#go"), ("1", "a#go"), ("2", "b#go")}


def test_selectors_write_out_no_imports_per_file(spark):
    # 1,500 files import 45,000 names between them, in 50 lists.
    assert most_rows(registry.queries()["j5_selectors"](spark, "/root/testdata/sf0.01")) < 20_000


def test_of_equal_ignore_rules_the_last_decides_and_no_other_is_tried(spark):
    lines = [(2, "a", i, f"p{i % 4}.*" if i % 8 < 4 else f"!p{i % 4}.*") for i in range(402)] + [(2, "a", 500, "p3.*/"), (2, "a", 501, "q[0-9]?.md"), (2, "a", 502, "/deep/**/*.c")]
    rules = ignore.parse_rules(spark.createDataFrame(lines, "level int, base string, line_no int, line string"))
    last = {r.regex: (r.line_no, r.negate, r.literal) for r in ignore.last_rules(rules).filter("NOT dir_only").collect()}
    assert len(last) == 6 and {v for v in last.values()} == {(400, False, "/p0"), (401, False, "/p1"), (398, True, "/p2"), (399, True, "/p3"), (501, False, "/q"), (502, False, "/deep")}
    want = {"a/p0.x": True, "a/b/p1.y": True, "a/p2.x": False, "a/p3.x": False, "a/p3.d/z": True, "p0.x": False, "a/q1x.md": True, "a/qq.md": False, "a/deep/b/c/x.c": True, "a/deep/x.c": True}
    files = spark.createDataFrame([(p,) for p in want], "path string")
    assert {r.path: r.ignored for r in ignore.ignored(files, rules).collect()} == want


def test_timings_round_as_sql_does(spark):
    pairs = [(175.969313, 0.4), (25.039263, 6.0), (105.358119, 12.4), (84.472565, 0.08), (82.569492, 0.32), (15.908249, 1.84), (188.528471, 8.72), (3.0, 7.0), (-1.0, 2.0)]
    rows = spark.createDataFrame([(f"n{i}", a, b) for i, (a, b) in enumerate(pairs)], "name string, a double, b double")
    got = {r.name: r.factor for r in reports.compare_timings(rows.selectExpr("name", "a AS mean"), rows.selectExpr("name", "b AS mean")).collect()}
    con = duckdb.connect()
    con.register("t", rows.toPandas())
    assert got == dict(con.sql("SELECT name, CASE WHEN a > 0 AND b > 0 THEN round(a / b, 6) ELSE 0 END FROM t").fetchall())


def test_grams_of_odd_texts_and_of_a_long_one_in_one_pass(spark):
    texts = ["", "ab", "abc", "aBcD", "a\nb\x00c", "naïve text", "😀abc😀ab", "aaaaa", None, "x" * 5 + "ÄÖ" + "yz\r\n"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", grams(F.col("text")).alias("g")).collect()
    fold = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    for r in got:
        want = None if r.text is None else sorted({g for g in (fold(r.text)[i : i + 3] for i in range(len(r.text) - 2)) if g.isascii()})
        assert (r.g if r.g is None else sorted(r.g)) == want and (r.g is None or len(r.g) == len(set(r.g)))


def test_an_index_holds_the_parts_that_are_asked(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"p{i}.md", f"the license number {i}") for i in range(40)], "id long, path string, text string")
    made = index.write(docs, "text", {"path": "path", "body": "text"}, str(tmp_path / "i"), parts=("grams",))
    assert not os.path.exists(tmp_path / "i/terms") and made.manifest().count() == 40
    assert index.candidates(made, docs, "text", [["license"]]).count() == 40
    later = docs.withColumn("text", F.concat("text", F.lit(" changed")))
    assert index.refresh(made, later, "text", {"path": "path", "body": "text"}, limit=10)[0].parts == ("grams",)


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_cut_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = cut(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).agg(F.count("*").alias("n")), "t")
    until = time.time() + 10
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and rows.count() == 700 and spark.conf.get(CLEANUP) == "false"


def test_merges_pair_no_events_with_occupied_pages(spark):
    events = [(i, "r", [f"a{i % 3}", f"b{i}"] if i % 2 else [f"a{i % 3}"]) for i in range(300)] + [(900, "s", ["x"]), (901, "q", None), (902, "q", ["y", None])]
    events = spark.createDataFrame(events, "event long, repo string, evidence array<string>")
    areas = spark.createDataFrame([("A", "r"), ("B", "s"), ("C", "q")], "scope string, repo string")
    pages = spark.createDataFrame([("A", f"p{i}", "planned") for i in range(301)] + [("B", "p", "planned"), ("C", "p", "planned")], "scope string, path string, state string")
    cases = [("A", f"p{i}", "merge", f"a0 a1 b3 {i}") for i in range(300)] + [("B", "p", "source", "x"), ("C", "p", None, "y")]
    cases = spark.createDataFrame(cases, "scope string, path string, trigger string, package string")
    decided, new = merges.land(events, areas, pages, cases, ["planned"])
    assert most_rows(decided) < 2000
    got = {r.event: r.decision for r in decided.collect()}
    # Event 0 takes the area's free page, so later ones land only if it quotes them.
    want = {i: "landed" if i % 6 == 0 else "deferred" for i in range(300)} | {900: "deferred", 901: "landed", 902: "landed"}
    assert got == want
    assert [tuple(r) for r in new.collect()] == [("A", "p300", 0)]


def test_hunks_read_a_diff_once_and_cap_by_hunk_and_file(spark):
    patch = []
    for f, hunks in (("a", 9), ("b", 1), ("a", 3)):
        patch += [f"--- a/{f}", f"+++ b/{f}"]
        for i in range(hunks):
            patch += [f"@@ -{i * 50 + 1},30 +{i * 50 + 1},2 @@", " kept", "+new", *[f"--- {i} {j}" for j in range(29)], "--- trailing"]
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(patch)], "path string, line_no int, line string")
    out = line_state.hunks(lines)
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
    got = [(r.file, len(r.lines), r.omitted) for r in out.orderBy("hunk").collect()]
    assert got == [("a", 24, 6)] * 8 + [("a", 8, 22)] + [("b", 24, 6)] + [("a", 0, 30)] * 3
    assert out.filter("hunk = 2").first().lines[:2] == ["+new", "--- 1 0"]


def test_equal_blocks_of_a_profile_fold_before_their_lines(spark, tmp_path):
    (tmp_path / "p").write_text("mode: set\n" + "".join(f"a:b/c.go:5.2,104.9 3 {i}\n" for i in range(300)) + "a:b/c.go:104.1,105.2 1 7\n")
    found = files.read_block_profile(spark, str(tmp_path / "p"))
    assert most_rows(found) < 1000
    got = {(r.path, r.line): int(r.hits) for r in found.collect()}
    assert got == {("a:b/c.go", i): 299 for i in range(5, 105)} | {("a:b/c.go", 105): 7}


def test_nearest_carries_the_best_and_no_pairs(spark):
    rows = [(i, [float(i * i % 7 - 3), float(i % 5 - 2), 1.0]) for i in range(400)] + [(400, None), (401, [1.0, None, 2.0]), (402, [1.0, 2.0]), (403, [1.0, 2.0, float("inf")]), (404, [1e-9, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "id long, vec array<double>").repartition(3)
    asked = vectors.filter("id % 40 = 1 OR id > 399")
    unit = lambda v: f"transform({v}, x -> x / sqrt(aggregate({v}, 0D, (s, y) -> s + y * y)))"
    asked.createOrReplaceTempView("nearest_asked")
    vectors.createOrReplaceTempView("nearest_all")
    want = spark.sql(f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM (SELECT q.id AS query, v.id AS id, round(aggregate(zip_with({unit("q.vec")}, {unit("v.vec")}, (a, b) -> a * b), 0D, (s, x) -> s + x), 6) AS score
FROM nearest_asked q JOIN nearest_all v ON q.id <> v.id)) WHERE rank <= 6""")
    text = lambda df: sorted(str(tuple(r)) for r in df.select("query", "id", "score", "rank").collect())
    assert text(search.nearest(asked, vectors, 6)) == text(want)
    regular = vectors.filter("id < 400")
    assert most_rows(search.nearest(regular.filter("id % 40 = 1"), regular, 3)) < 1000


def test_images_look_up_each_path_once(spark):
    nodes = [(f"a/b/f{i % 3}.py#s{i}", f"a/b/f{i % 3}.py") for i in range(600)] + [(f"a/b/f{i}.py", f"a/b/f{i}.py") for i in range(3)] + [("c", "c"), ("a/d/g.py#t", "a/d/g.py")]
    nodes = spark.createDataFrame(nodes, "id string, path string")
    opened = spark.createDataFrame([("a",), ("a/b",), ("a/b/f1.py",), ("a/b/f1.py#s1",), ("a/d/g.py",)], "element string")
    got = collapse.images(nodes, opened)
    assert most_rows(got) < 1000
    want = lambda i, p: "a/d" if p.startswith("a/d") else p if p in ("c", "a/b/f0.py", "a/b/f2.py") else i
    assert all(r.image == want(r.id, r.path) for r in got.collect()) and got.count() == 605
    edges = spark.createDataFrame([], "source string, target string, relation string, confidence string")
    drawn = {r.element: (r.kind, r.members) for r in collapse.view(nodes, edges, opened, ["calls"])[0].collect()}
    assert len(drawn) == 205 and drawn["a/d"] == ("directory", 1) and drawn["a/b/f0.py"] == ("file", 201) and drawn["a/b/f1.py#s1"] == ("symbol", 1) and drawn["c"] == ("file", 1)


def test_hit_groups_sort_no_spans_of_other_files(spark, monkeypatch):
    seen, plain = [], callers.enclosing
    monkeypatch.setattr(callers, "enclosing", lambda points, spans: seen.append(spans) or plain(points, spans))
    nodes = spark.range(5000).selectExpr("concat('f', id % 50, '#', id) AS id", "concat('n', id) AS name", "concat('f', id % 50) AS path", "id AS span_from", "id + 1 AS span_to")
    edges = spark.range(3000).selectExpr("'x' AS source", "concat('f', id % 50, '#', id % 100) AS target", "'calls' AS relation")
    hits = spark.createDataFrame([("f3", 3, "a"), ("f3", 4, "b"), ("f7", 900, "c")], "path string, line_no long, line string")
    found = callers.hit_groups(hits, nodes, edges, 2)[0]
    assert [(r.path, r.symbol, r.in_degree, r.place) for r in found.collect()] == [("f3", "f3#3", 30, 1)]
    assert seen[0].count() == 100


def test_rounds_of_cycles_broadcast_nothing(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(graph, "cut", lambda df, name: kept.append(df) or cut(df, name))
    links = [(i, (i + 1) % 9) for i in range(9)] + [(20, 21), (21, 22), (22, 20), (8, 20), (30, 30), (40, 9), (9, 41)]
    found = graph.cycles(spark.createDataFrame(links, "source long, target long"))
    want = {(i, 0) for i in range(9)} | {(20, 20), (21, 20), (22, 20), (30, 30)}
    assert {(r.id, r.cycle) for r in found.collect()} == want
    assert not any("Broadcast" in df._jdf.queryExecution().executedPlan().toString() for df in [*kept, found])


def test_united_edges_resolve_each_part_once(spark):
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD")
    raw = spark.createDataFrame([("1", "a/f", "a", "x"), ("2", "a/f", "a", "y"), ("3", "a/t", "a", "y"), ("4", "a/t", "a", "z"), ("5", "a/f", None, "x")], "raw_id string, file string, dir string, name string")
    defs = spark.createDataFrame([("a/f#x", "a/f", "a", "x"), ("a/g#y", "a/g", "a", "y"), ("a/t#z", "a/t", "a", "z")], "id string, file string, dir string, name string")
    found = selectors.resolve_values(raw, defs, spark.createDataFrame([("a/t", "a_test"), ("a/t", "a_test"), ("a/f", "a")], "file string, package string"))
    assert scans(found) == 4  # raw names, definitions by file and by directory, packages
    edges, left = bundles.union_edges({"x": found.select("raw_id", "target")}, raw.select("raw_id"))
    assert scans(edges) == 0 and scans(left) == 1
    assert {(r.raw_id, r.target) for r in edges.collect()} == {("1", "a/f#x"), ("2", "a/g#y"), ("4", "a/t#z"), ("5", "a/f#x")} and [r.raw_id for r in left.collect()] == ["3"]


def test_spans_of_a_range_are_compared_without_pairs(spark):
    spans = [("p", f"s{i:03}", i, 1000 - i) for i in range(300)] + [("q", "a", 1, 70), ("q", "a", 5, 6), ("q", "b", 1, 200), ("q", "c", 60, 66), ("q", "d", 60, 66), ("q", "n", None, None)]
    spans = spark.createDataFrame(spans, "path string, id string, span_from long, span_to long")
    ranges = spark.createDataFrame([("p", 500, 510), ("p", 500, 510), ("p", 100, 150), ("q", 2, 190), ("q", 10, 20), ("q", 62, 62), ("q", 300, 310)], "path string, line_from long, line_to long")
    found = impact.innermost(ranges, spans)
    assert sorted(tuple(r) for r in found.collect()) == [("p", 100, 150, "s150"), ("p", 500, 510, "s299"), ("q", 10, 20, "a")]
    assert most_rows(found) < 10_000


def test_walks_move_numbers_and_tell_equal_ones_apart(spark, monkeypatch):
    plain, tables = F.xxhash64, []
    monkeypatch.setattr(graph.F, "xxhash64", lambda seed, c: plain(seed, F.left(c, F.lit(1))) if str(seed) == str(F.lit(0)) else plain(seed, c))
    monkeypatch.setattr(graph, "cut", lambda df, name: tables.append((name, df)) or cut(df, name))
    edges = [("aa", "ab", "calls", "inferred", 1), ("aa", "ab", "calls", "inferred", 2), ("ab", "ac", "calls", "extracted", 1), ("ac", "aa", "calls", "extracted", 1), ("ac", None, "calls", "extracted", 1), ("ac", "ad", "contains", "extracted", 1)]
    edges = spark.createDataFrame(edges, "source string, target string, relation string, confidence string, line int")
    starts = spark.createDataFrame([("o", "aa"), ("o", "zz"), ("p", "ac"), ("p", None)], "origin string, id string")
    got = {tuple(r) for r in graph.reach(edges, starts, False).collect()}
    assert got == {("o", "ab", 1, True), ("o", "ac", 2, True), ("p", "aa", 1, False), ("p", "ab", 2, True)}
    assert [n for n, _ in tables].count("numbers") == 2 and all("id" not in df.columns for n, df in tables if n in ("frontier", "seen"))


def test_calls_are_looked_up_once_a_part_with_the_same_rows(spark, monkeypatch):
    text = lambda name: sorted(str(tuple(r)) for r in views.view(spark, "/root/testdata/sf0.001", name).collect())
    joins = lambda name: views.view(spark, "/root/testdata/sf0.001", name)._jdf.queryExecution().optimizedPlan().toString().count("Join Inner")
    names = ("g_calls", "g_sites", "g_lines")
    light = {n: (text(n), joins(n)) for n in names}
    monkeypatch.setattr(views, "LIGHT", {})
    for n in names:
        assert light[n][0] == text(n)
    assert light["g_lines"][1] < joins("g_lines") and light["g_sites"][1] < joins("g_sites")


def test_long_walks_keep_only_edges_that_can_be_walked(spark, monkeypatch):
    tables = {}
    monkeypatch.setattr(graph, "cut", lambda df, name: tables.setdefault(name, cut(df, name)) if name == "pairs" else cut(df, name))
    edges = [("a", "b", "calls", "inferred", 1), ("b", "c", "calls", "extracted", 1)] + [(f"x{i}", "c", "calls", "extracted", 1) for i in range(50)]
    edges = spark.createDataFrame(edges, "source string, target string, relation string, confidence string, line int")
    got = {tuple(r) for r in graph.reach(edges, spark.createDataFrame([("o", "a")], "origin string, id string"), False).collect()}
    assert got == {("o", "b", 1, True), ("o", "c", 2, True)} and tables["pairs"].count() == 2


def test_source_of_spans_meets_lines_by_blocks(spark):
    lines = [("p", i, f"l{i}" if i % 50 else None) for i in range(1, 201) if i != 77] + [("p", 5, "again"), ("q", 3, "q3")]
    lines = spark.createDataFrame(lines, "path string, line_no long, line string")
    spans = [(f"s{i}", "p", i, i + 79) for i in range(1, 101)] + [("z", "p", 4, 6), ("m", "p", 76, 78), ("e", "p", 199, 500), ("g", "gone", 1, 2), ("n", "p", None, None), ("b", "q", 3, 2), ("q", "q", 0, 9)]
    found = callers.inline(spark.createDataFrame(spans, "id string, path string, span_from long, span_to long"), lines)
    got = {r.id: r.code for r in found.collect()}
    assert got["z"] == "l4\nagain\nl5\nl6" and got["m"] == "l76\n\nl78" and got["e"] == "l199\n" and got["g"] is None and got["n"] is None and got["b"] is None and got["q"] == "\n\nq3"
    assert got["s10"] == "\n".join("" if i in (50, 77) else f"l{i}" for i in range(10, 90)) and most_rows(found) < 1000


def test_questions_match_nodes_once(spark):
    nodes = [("a/f.py", "a/f.py", "a/f.py", "file", False), ("a/f.py#T.run", "run", "a/f.py", "method", False), ("a/f.py#go", "go", "a/f.py", "function", True), ("a/b.py#x", "no", "a/b.py", "function", False)]
    found = selection.resolve_symbols(spark.createDataFrame([("gone.Run",), ("T.run",), ("gone.go",), ("gone.x",), ("a.go",)], "ask string"), spark.createDataFrame(nodes, "id string, name string, path string, kind string, is_test boolean"))
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 2
    assert {tuple(r) for r in found.collect()} == {("gone.Run", "a/f.py#T.run", 3, 2), ("T.run", "a/f.py#T.run", 0, 0), ("a.go", "a/f.py#go", 1, 1)}


def test_quotes_read_the_lines_of_quoted_files_once(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(callers, "cut", lambda df, name: kept.setdefault(name, cut(df, name)))
    nodes = spark.createDataFrame([(f"f{i}#s{i}", f"s{i}", f"f{i}", 1, 9) for i in range(40)], "id string, name string, path string, span_from long, span_to long")
    edges = spark.createDataFrame([("f1#s1", "f0#s0", "calls", "extracted", 2), ("f2#s2", "f0#s0", "calls", "inferred", 0), ("f3#s3", "f0#s0", "calls", "extracted", 4)], "source string, target string, relation string, confidence string, line int")
    lines = spark.createDataFrame([(f"f{i}", j, f"s0 at {j}") for i in range(40) for j in range(1, 10)], "path string, line_no long, line string")
    found, hidden = callers.neighbours(spark.createDataFrame([("q", "f0#s0")], "ask string, id string"), nodes, edges, lines, keep=F.col("path") != "f3")
    assert {(r.id, r.line, r.quote, r.inferred) for r in found.collect()} == {("f1#s1", 2, "s0 at 2", False), ("f2#s2", 1, "s0 at 1", True)} and hidden.first().hidden == 1
    assert kept["lines"].count() == 18 and "ExistingRDD" not in found._jdf.queryExecution().executedPlan().toString()


def test_rounds_of_exports_read_tables_that_are_written_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(exports, "cut", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD"))) or cut(df, name))
    tops = spark.createDataFrame([("c", "n", "c#n", True)], "file string, name string, id string, exported boolean")
    imports = spark.createDataFrame([("a", 1, "reexport", "n", None, "b"), ("b", 1, "reexport", "*", None, "c")], "file string, pos int, kind string, name string, alias string, target string")
    got = exports.exported(spark.createDataFrame([("a", "n")], "file string, name string"), tops, imports)
    assert [tuple(r) for r in got.collect()] == [("a", "n", "c#n")]
    assert sum(n for _, n in plans) == 3  # tops, imports and questions, once each
