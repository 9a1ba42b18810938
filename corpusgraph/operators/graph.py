"""Graph operators: degrees, ranks, walks, roll-ups, cycles.

Graphs are two DataFrames, nodes(id, path, ...) and edges(source, target, relation, confidence, line). Edges
may be parallel and may end outside the nodes. Iterative operators write each round's small state to the
shared checkpoint folder, so plans stay short and lost executors cost one round at most.
"""

from __future__ import annotations

import struct

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ancestors
from ..checkpoint import cut
from . import blocks

# Fixed values of the rank.
RESTART = 0.25
STEPS = 25
#: At most so many edges of a rank's block, and nodes of its part, about.
EDGES, PLACES = 12_000_000, 1_000_000


def walk_edges(edges: DataFrame) -> DataFrame:
    """All relations but containment."""
    return edges.filter("relation <> 'contains'")


def in_degree(edges: DataFrame) -> DataFrame:
    """(id, in_degree): parallel edges count."""
    return walk_edges(edges).groupBy(F.col("target").alias("id")).agg(F.count("*").alias("in_degree"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, n): files, symbols, edges, edges per relation, inferred edges; one pass over either table."""
    of_nodes = nodes.groupBy(F.when(F.col("kind") == "file", "files").otherwise("symbols").alias("what")).agg(F.count("*").alias("n"))
    of_edges = edges.groupBy("relation", "confidence").agg(F.count("*").alias("n"))
    return of_nodes.unionByName(
        of_edges.select(F.explode(F.array(F.lit("edges"), F.concat(F.lit("relation:"), "relation"), F.concat(F.lit("confidence:"), "confidence"))).alias("what"), "n").groupBy("what").agg(F.sum("n").alias("n"))
    )


def resolved_both(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected adjacency (src, dst) between nodes: both directions, parallel edges and loops kept, loose ends dropped."""
    ids = nodes.select("id")
    known = walk_edges(edges).join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target")
    return known.toDF("src", "dst").unionByName(known.select(F.col("target").alias("src"), F.col("source").alias("dst")))


def with_loose_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Walk edges with the target's path, null for a loose end."""
    return walk_edges(edges).join(nodes.select(F.col("id").alias("target"), F.col("path").alias("target_path")), "target", "left")


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, restart: float = RESTART, steps: int = STEPS) -> DataFrame:
    """Personalised rank from seeds(id, weight): (id, score), the largest score 1, nodes without mass absent.

    Mass of nodes without edges is pooled and returned to the seeds. Edges are laid out once in blocks that stay where they
    are (see `blocks`); a round moves values and sums of the nodes that edges point to, once a block that names them.
    """
    spark, kind, keep = nodes.sparkSession, nodes.schema["id"].dataType, 1 - restart
    seed = 0
    while True:
        # A node's number, and a second hash that tells a loose end with that number from it.
        hashed = lambda c: (F.xxhash64(F.lit(seed), F.col(c).cast(kind)), F.hash(F.col(c).cast(kind)))
        numbers = lambda df, *rest: df.filter("id IS NOT NULL").select(hashed("id")[0].alias("no"), hashed("id")[1].alias("check"), *rest)
        every = numbers(nodes, F.lit(0.0).alias("weight"), F.lit(1).alias("here")).unionByName(numbers(seeds.filter("weight > 0"), F.col("weight").cast("double").alias("weight"), F.lit(0).alias("here")))
        every = cut(every.groupBy("no").agg(F.sum("weight").alias("weight"), F.max("here").alias("here"), F.min("check").alias("check"), F.max("check").alias("other")), "numbers")
        if every.filter("check <> other").isEmpty():
            break
        seed += 1
    ids = every.filter("here = 1").select("no", "check", "weight")
    total = ids.agg(F.sum("weight")).first()[0]
    if not total:
        return nodes.limit(0).select("id", F.lit(0.0).alias("score"))
    ids = ids.select("no", "check", (F.col("weight") / total).alias("r"))
    ends = walk_edges(edges).filter("source IS NOT NULL AND target IS NOT NULL")
    ends = cut(ends.select(*[x.alias(n) for x, n in zip(hashed("source") + hashed("target"), ("no", "check", "to", "to_check"))]), "ends")
    aims = cut(ends.select(F.col("to").alias("no"), F.col("to_check").alias("check")).distinct().join(ids, ["no", "check"]), "aims")
    cores, n_ends, n_aims = spark.sparkContext.defaultParallelism, ends.count(), aims.count()
    masses, lone = None, 1.0
    if n_aims and steps:
        of_block, of_part = (_dealt(spark, max(min(cores, n // least), -(-n // most), 1)) for n, least, most in ((n_ends, 100_000, EDGES), (n_aims, 50_000, PLACES)))
        masses, lone = _ranked(ids, ends, aims, of_block, of_part, keep, steps)
    again = F.col("r") * _returned(keep, lone, steps)[-1]
    scored = ids.withColumn("mass", again) if masses is None else ids.join(masses, "no", "left").withColumn("mass", F.coalesce("mass", again))
    scored = cut(scored.filter("mass > 0").select("no", "mass"), "masses")
    scored = scored.crossJoin(F.broadcast(scored.agg(F.max("mass").alias("top")))).select("no", (F.col("mass") / F.col("top")).alias("score"))
    return numbers(nodes, "id").drop("check").repartition("no").distinct().join(scored, "no").select("id", "score")


def _returned(keep: float, lone: float, steps: int) -> list[float]:
    """For each round the share of its restart that a node gets; lone, the restart of nodes without edges, comes back."""
    out = [1.0]
    for _ in range(steps):
        out.append(1 - keep + keep * lone * out[-1])
    return out


def _dealt(spark: SparkSession, n: int) -> list[int]:
    """n numbers that hash partitioning deals to n partitions, one each, as far as it goes."""
    at = F.pmod(F.hash("id"), F.lit(n))
    found = {r.at: r.id for r in spark.range(30 * n).groupBy(at.alias("at")).agg(F.min("id").alias("id")).collect()}
    spare = iter(sorted(set(range(30 * n)) - set(found.values())))
    return sorted(found[i] if i in found else next(spare) for i in range(n))


def _ranked(ids: DataFrame, ends: DataFrame, aims: DataFrame, of_block: list[int], of_part: list[int], keep: float, steps: int) -> tuple[DataFrame, float]:
    """((no, mass) of the nodes with edges after all rounds, the restart of those without)."""
    named = lambda keys, i: F.element_at(F.array(*[F.lit(k).cast("long") for k in keys]), (i + 1).cast("int"))
    dealt = lambda df, by: df.repartition(len(of_block if by == "block" else of_part), by)
    apply = lambda a, b, by, fn, schema=blocks.ROWS: a.groupBy(by).cogroup(dealt(b, by).groupBy(by)).applyInArrow(fn, schema)
    at = aims.withColumn("i", F.pmod("no", F.lit(len(of_part)))).withColumn("row", F.row_number().over(Window.partitionBy("i").orderBy("no")) - 1)
    at = cut(at.select("no", "check", "r", named(of_part, F.col("i")).alias("part"), "row", (F.shiftleft("i", 32) + F.col("row")).alias("at")), "places")
    aimed = ends.join(at.select(F.col("no").alias("to"), F.col("check").alias("to_check"), F.col("at").alias("to_at")), ["to", "to_check"]).select("no", "check", "to_at")
    placed = aimed.join(ids.join(at.select("no", "at"), "no", "left"), ["no", "check"])
    block = F.pmod(F.when(F.col("at").isNull(), F.col("no")).otherwise(F.xxhash64("no", "to_at")), F.lit(len(of_block)))
    laid = placed.select(named(of_block, block).alias("block"), "no", F.coalesce("at", F.lit(-1)).cast("long").alias("at"), "r", F.col("to_at").alias("to"))
    laid = cut(dealt(laid, "block").sortWithinPartitions("no").mapInArrow(blocks.fold(of_part), blocks.ROWS), "blocks")
    parts = cut(apply(dealt(at.select("part", "row", "no", "r"), "part"), laid.filter("endswith(kind, ' list')"), "part", blocks.own), "parts")
    sums = [x.a for df in (laid, parts) for x in df.filter("kind = 'restart'").select("a").collect()]
    lone = max(1 - sum(struct.unpack("d", x)[0] for x in sums), 0.0)
    # These stay where they are over all rounds.
    held = [dealt(df.filter(of), by).sortWithinPartitions(by).persist(StorageLevel.DISK_ONLY) for df, by, of in ((laid, "block", "kind IN ('plain', 'inner')"), (parts, "part", "kind = 'own' OR endswith(kind, ' list')"))]
    moved = parts.filter("startswith(kind, 'first ')").withColumn("kind", F.expr("substring(kind, 7)"))
    for step, again in enumerate(_returned(keep, lone, steps)[1:], 1):
        if step == steps:
            plain = apply(dealt(laid.filter("kind IN ('plain', 'ids')"), "block"), moved, "block", blocks.source_masses(keep, again), blocks.MASSES)
        moved = apply(held[0], moved, "block", blocks.sums(keep, again))
        moved = apply(held[1], moved, "part", blocks.settle(keep, again, step == steps), blocks.MASSES if step == steps else blocks.ROWS)
        if step % 5 == 4 and step < steps or step == steps - 1:
            moved = cut(moved, "moved")
    masses = cut(plain.unionByName(moved), "rank")
    for df in held:
        df.unpersist()
    return masses, lone


def folded(edges: DataFrame) -> DataFrame:
    """Walk edges written once, for several readers: (source, target, guess); guess is 1 if inferred. Parallel ones stay."""
    return cut(walk_edges(edges).select("source", "target", F.when(F.col("confidence") == "inferred", 1).otherwise(0).alias("guess")), "steps")


def walked(steps: DataFrame, starts: DataFrame, incoming: bool = True, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((origin, no, depth, guess), (no, id)): what starts(origin, id) reach along folded edges, themselves included; once per origin.

    Rounds move hashes of ids. Those of all ids are compared first, with the next seed should two ids share one.
    """
    a, b = ("target", "source") if incoming else ("source", "target")
    kind = steps.schema[a].dataType
    starts = cut(starts.select("origin", F.col("id").cast(kind).alias("id")).filter("id IS NOT NULL").distinct(), "starts")
    every = steps.select(F.explode(F.array("source", "target")).alias("id")).unionByName(starts.select("id")).filter("id IS NOT NULL").distinct()
    seed = 0
    while True:
        number = lambda c: F.xxhash64(F.lit(seed), c)
        ids = cut(every.select(number(F.col("id")).alias("no"), "id"), "numbers")
        if ids.groupBy("no").count().filter("count > 1").isEmpty():
            break
        seed += 1
    pairs = steps.filter("source IS NOT NULL AND target IS NOT NULL").select(number(F.col(a)).alias("at"), number(F.col(b)).alias("to"), "guess")
    seen = frontier = starts.select("origin", number(F.col("id")).alias("no"), F.lit(0).alias("depth"), F.lit(0).alias("guess"))
    if depth is None or depth > 3:
        # A step leaves a start or what another step has entered; the others are not moved again each round.
        left = pairs.select(F.col("to").alias("at")).unionByName(starts.select(number(F.col("id")).alias("at"))).distinct()
        pairs = cut(pairs.join(left, "at", "left_semi").groupBy("at", "to").agg(F.min("guess").alias("guess")), "pairs")
    d = 0
    while depth is None or d < depth:
        d += 1
        found = frontier.join(pairs.withColumnRenamed("guess", "own"), F.col("no") == F.col("at")).select("origin", F.col("to").alias("no"), F.greatest("guess", "own").alias("guess"))
        found = found.groupBy("origin", "no").agg(F.min("guess").alias("guess"))
        frontier = cut(found.join(seen.select("origin", "no"), ["origin", "no"], "left_anti").select("origin", "no", F.lit(d).alias("depth"), "guess"), "frontier")
        if frontier.isEmpty():
            break
        # Rounds are only added; long walks are written together now and then.
        seen = seen.unionByName(frontier)
        if d % 10 == 0:
            seen = cut(seen, "seen")
    return seen, ids


def reach(edges: DataFrame, starts: DataFrame, incoming: bool = True, depth: int | None = None) -> DataFrame:
    """(origin, id, depth, inferred) of all that starts(origin, id) reach along walk edges, starts themselves excluded.

    depth is the least; inferred holds unless some shortest path has no guessed link. Many origins walk at once.
    """
    seen, ids = walked(folded(edges), starts, incoming, depth)
    return seen.filter("depth > 0").join(ids, "no").select("origin", "id", "depth", (F.col("guess") == 1).alias("inferred"))


def rollup(rows: DataFrame, path: str, *sums: Column) -> DataFrame:
    """Sums over every directory above each path ('' is the root)."""
    return rows.withColumn("dir", F.explode(ancestors(F.col(path)))).groupBy("dir").agg(*sums)


def visible_edges(edges: DataFrame, closure: DataFrame) -> DataFrame:
    """Edges between visible directories by closure(id, dir): (src, dst, relation, n), inner ones dropped."""
    return (
        walk_edges(edges).join(closure.toDF("source", "src"), "source").join(closure.toDF("target", "dst"), "target").filter("src <> dst").groupBy("src", "dst", "relation").agg(F.count("*").alias("n"))
    )


def directory_buckets(files: DataFrame, share: float = 0.6) -> DataFrame:
    """(path, bucket): the first segment, or the first two where one top directory holds more than share of all files."""
    top = F.element_at(F.split("path", "/"), 1)
    per_top = files.groupBy(top.alias("top")).agg(F.count("*").alias("n"))
    split = per_top.agg((F.max("n") > share * F.sum("n")).alias("deep"))  # one row
    parts = F.split("path", "/")
    return files.crossJoin(F.broadcast(split)).select("path", F.when(F.col("deep"), F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(2), F.size(parts) - 1)), "/")).otherwise(parts[0]).alias("bucket"))


def neighbours(links: DataFrame) -> DataFrame:
    """(id, direction, others): sorted distinct neighbours, joined by commas."""
    both = links.select(F.col("source").alias("id"), F.lit("out").alias("direction"), F.col("target").alias("other")).unionByName(links.select(F.col("target").alias("id"), F.lit("in").alias("direction"), F.col("source").alias("other")))
    return both.groupBy("id", "direction").agg(F.array_join(F.transform(F.array_sort(F.collect_set("other")), lambda x: x.cast("string")), ",").alias("others"))


def orphans(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Pages that no other page links to."""
    return pages.join(links.filter("source <> target").select(F.col("target").alias("id")).distinct(), "id", "left_anti")


def cycles(links: DataFrame) -> DataFrame:
    """(id, cycle): members of strongly connected components of more than one member, or with a loop; cycle is the least id.

    Rounds: nodes without a way in or out are trimmed; then each node takes the least id that reaches it and
    the least it reaches; where both agree the component is complete.
    """
    work = cut(links.select("source", "target").distinct(), "links")
    loops = work.filter("source = target").select(F.col("source").alias("id"), F.col("source").alias("cycle"))
    work, done = work.filter("source <> target"), None
    while not work.isEmpty():
        while True:
            n = work.count()
            work = cut(work.join(_merged(work.select(F.col("target").alias("source")).distinct()), "source", "left_semi").join(_merged(work.select(F.col("source").alias("target")).distinct()), "target", "left_semi").select("source", "target"), "work")
            if work.count() == n:
                break
        if not n:
            break
        labels = _least(work, "source", "target").withColumnRenamed("label", "fw").join(_merged(_least(work, "target", "source").withColumnRenamed("label", "bw")), "id")
        labels = cut(labels, "labels")
        here = labels.filter("fw = bw").select("id", F.col("fw").alias("cycle"))
        done = here if done is None else done.unionByName(here)
        left = labels.filter("fw <> bw")
        same = left.select(F.col("id").alias("source"), F.struct("fw", "bw").alias("a")), left.select(F.col("id").alias("target"), F.struct("fw", "bw").alias("b"))
        work = cut(work.join(_merged(same[0]), "source").join(_merged(same[1]), "target").filter("a = b").select("source", "target"), "work")
    if done is None:
        return loops
    done = done.join(_merged(done.groupBy("cycle").agg(F.count("*").alias("n")).filter("n > 1")), "cycle").select("id", "cycle")
    return done.unionByName(loops.join(_merged(done.select("id")), "id", "left_anti"))


def _merged(df: DataFrame) -> DataFrame:
    """df for a shuffled join: over many rounds, tables small enough to be broadcast add up in the driver."""
    return df.hint("merge")


def _least(edges: DataFrame, start: str, end: str) -> DataFrame:
    """(id, label): the least node from which an id can be reached along start -> end, itself included."""
    labels = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("label", F.col("id"))
    labels = cut(labels, "labels")
    while True:
        sent = edges.join(_merged(labels), edges[start] == labels["id"]).select(F.col(end).alias("id"), "label")
        new = cut(labels.unionByName(sent).groupBy("id").agg(F.min("label").alias("label")), "labels")
        if new.join(_merged(labels.withColumnRenamed("label", "old")), "id").filter("label <> old").isEmpty():
            return new
        labels = new


def same_name(nodes: DataFrame) -> DataFrame:
    """(name, others): names that several nodes bear."""
    return nodes.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1")


def first_site(edges: DataFrame) -> DataFrame:
    """(source, target, relation, line): the first positive line of each link."""
    return walk_edges(edges).groupBy("source", "target", "relation").agg(F.min(F.when(F.col("line") > 0, F.col("line"))).alias("line"))
