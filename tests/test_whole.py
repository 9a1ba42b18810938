"""Queries and operators work on all rows of their inputs."""

import random

from corpusgraph.operators import impact
from corpusgraph.plans import registry
from corpusgraph.plans.views import view

SF = "/root/testdata/sf0.001"


def test_hunks_cover_every_line_item(spark):
    assert view(spark, SF, "d_hunks").count() == view(spark, SF, "lineitem").count()


def test_signals_by_brute_force_over_long_chains(spark):
    rng = random.Random(3)
    ids = [f"n{i}" for i in range(90)]
    path = {x: f"p{i // 3}" for i, x in enumerate(ids)}
    is_test = {p: int(p[1:]) % 5 == 0 for p in path.values()}
    pairs = {(ids[i], ids[i + 1]) for i in range(60) if rng.random() < 0.9} | {tuple(rng.sample(ids, 2)) for _ in range(25)}
    changed = {p for p in is_test if rng.random() < 0.6}
    nodes = spark.createDataFrame([(x, path[x], is_test[path[x]]) for x in ids], "id string, path string, is_test boolean")
    edges = spark.createDataFrame([(a, b, "calls", "extracted", 1) for a, b in pairs], "source string, target string, relation string, confidence string, line int")
    want = {}
    for p in changed:
        seen = {x for x in ids if path[x] == p}
        todo = list(seen)
        while todo:
            at = todo.pop()
            new = {a for a, b in pairs if b == at} - seen
            seen |= new
            todo += new
        tests = {path[x] for x in seen if is_test[path[x]]}
        want[p] = "na" if is_test[p] else "none" if not tests else "changed" if tests & changed else "stale"
    got = {r.path: r.signal for r in impact.test_signal(spark.createDataFrame([(p,) for p in changed], "path string"), nodes, edges).collect()}
    assert got == want and set(want.values()) == {"na", "none", "changed", "stale"}


def rows_of(spark, name):
    return {tuple(r) for r in registry.queries()[name](spark, SF).collect()}


def test_cycles_and_orphans_see_every_link(spark):
    links = {tuple(r) for r in view(spark, SF, "t_links").collect()}
    after = {}
    for a, b in links:
        after.setdefault(a, set()).add(b)
    reached = {}
    for a in after:
        seen, todo = set(), [a]
        while todo:
            new = after.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        reached[a] = seen
    want = {(a, min(b for b in reached[a] if a in reached.get(b, ()))) for a in reached if a in reached[a]}
    assert rows_of(spark, "g13_cycles") == want
    ids = {r.doc_id for r in view(spark, SF, "t_docs").collect()}
    assert rows_of(spark, "g12_orphans") == {(x,) for x in ids - {b for a, b in links if a != b}}
    assert rows_of(spark, "g12_catalog_gap") == {(r.path,) for r in view(spark, SF, "t_docs").collect() if r.doc_id not in {b for _, b in links}}


def test_bridges_leave_out_no_symbol(spark):
    rows = [(r.id, r.kind, r.name, r.path, r.orderkey) for r in view(spark, SF, "g_symbols").collect()]
    known = {(r.source, r.target) for r in view(spark, SF, "g_calls").collect()}
    offers = {}
    for id_, kind, name, path, key in rows:
        if key % 3 != 0:
            offers.setdefault((kind, name), []).append((id_, path))
    want = set()
    for id_, kind, name, path, key in rows:
        if key % 3 == 0:
            hit = {o for o, p in offers.get((kind, name), []) if p.split("/")[1] == path.split("/")[1] or len(p) % 2 == 0}
            want |= {(id_, o, key % 7) for o in hit if len(hit) == 1 and (id_, o) not in known}
    assert rows_of(spark, "j11_bridges") == want and any(int(o.split("#o")[1]) % 3 == 2 for _, o, _ in want)


def test_overlay_ends_at_the_new_snapshot(spark):
    assert rows_of(spark, "u8_overlay") == {(r.path, r.content_hash) for r in view(spark, SF, "snap_b").collect()}
