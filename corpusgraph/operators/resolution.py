"""References to definitions: ladders of scopes in which exactly one candidate counts, prefixes, bridges, probing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve_references(raw: DataFrame, defs: DataFrame, ladder: list[tuple[str, list[str], bool]]) -> DataFrame:
    """(raw_id, target, step, inferred) for raw(raw_id, ...) and defs(id, ...).

    ladder: (step, columns that must agree, inferred), from the narrowest scope. A step answers only if exactly
    one definition agrees there; the first step that answers wins. Definitions are counted per key once, so a
    name that many files define costs one row and not one per candidate.
    """
    out = raw
    for i, (_, keys, _) in enumerate(ladder):
        only = defs.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias(f"t{i}")).filter("n = 1").drop("n")
        out = out.join(only, keys, "left")
    hit = None
    for i, (step, _, inferred) in enumerate(ladder):
        here = F.struct(F.col(f"t{i}").alias("target"), F.lit(step).alias("step"), F.lit(inferred).alias("inferred"))
        hit = F.when(F.col(f"t{i}").isNotNull(), here) if hit is None else hit.when(F.col(f"t{i}").isNotNull(), here)
    return out.withColumn("hit", hit).filter("hit IS NOT NULL").select("raw_id", "hit.*")


def longest_prefix(rows: DataFrame, path: str, roots: DataFrame) -> DataFrame:
    """rows with the nearest root above path (a column `root`), by an equi-join on all directories above it."""
    from ..functions.text import ancestors

    up = rows.select("*", F.explode(F.concat(ancestors(F.col(path)), F.array(F.col(path)))).alias("root"))
    hit = up.join(roots.select("root").distinct(), "root").groupBy(*rows.columns).agg(F.max_by("root", F.length("root")).alias("root"))
    return rows.join(hit, rows.columns, "left")


def probe(imports: DataFrame, files: DataFrame, candidates: list[Column]) -> DataFrame:
    """(import columns, path): the first candidate path that is a file."""
    tries = imports.select("*", F.posexplode(F.array(*candidates)).alias("place", "path"))
    found = tries.join(files.select("path").distinct(), "path", "left_semi").groupBy(*imports.columns).agg(F.min_by("path", "place").alias("path"))
    return imports.join(found, imports.columns, "left")


def bridge(uses: DataFrame, offers: DataFrame, existing: DataFrame, all_targets: bool = False) -> DataFrame:
    """(source, target, line): uses(source, namespace, name, file, line) meet offers(target, namespace, name, scope array or null).

    An empty or null scope offers to all files. Unless all_targets, a use with several offers gets none.
    Existing links win; of repeated links the least line stays.
    """
    wide = F.col("scope").isNull() | (F.size("scope") == 0)
    if all_targets:
        hit = uses.join(offers, ["namespace", "name"]).filter(wide | F.array_contains("scope", F.col("file")))
    else:
        # What a use sees is one target if the least and the greatest are the same; so offers fold to one row per name and
        # file before they meet the uses, and a name that many use and many offer is no product of the two.
        ends = lambda name: (F.min("target").alias(f"{name}_least"), F.max("target").alias(f"{name}_most"))
        everywhere = offers.filter(wide).groupBy("namespace", "name").agg(*ends("wide"))
        scoped = offers.filter(~wide).select("target", "namespace", "name", F.explode("scope").alias("file")).groupBy("namespace", "name", "file").agg(*ends("own"))
        seen = uses.join(everywhere, ["namespace", "name"], "left").join(scoped, ["namespace", "name", "file"], "left")
        seen = seen.select("source", "namespace", "name", "line", F.least("wide_least", "own_least").alias("least"), F.greatest("wide_most", "own_most").alias("most")).filter("least IS NOT NULL")
        single = seen.groupBy("source", "namespace", "name").agg(F.min("least").alias("target"), F.max("most").alias("most"), F.min("line").alias("line"))
        hit = single.filter("target = most").select("source", "target", "line")
    return hit.join(existing.select("source", "target"), ["source", "target"], "left_anti").groupBy("source", "target").agg(F.min("line").alias("line"))


def member_lookup(calls: DataFrame, members: DataFrame, ancestry: DataFrame) -> DataFrame:
    """(call_id, member): calls(call_id, type, name) find the member that the nearest type above declares; of equal depth exactly one counts.

    ancestry(type, base, depth) holds each type itself at depth 0 (see graph.reach for the closure).
    """
    hit = calls.join(ancestry, "type").join(members.select(F.col("type").alias("base"), "name", "member"), ["base", "name"])
    near = hit.groupBy("call_id").agg(F.min("depth").alias("depth"))
    return hit.join(near, ["call_id", "depth"]).groupBy("call_id").agg(F.count("*").alias("n"), F.min("member").alias("member")).filter("n = 1").select("call_id", "member")
