"""What a module exports under a name, through lists, named and star re-exports."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoint import cut

KEY = ["file", "name"]


def _tables(tops: DataFrame, imports: DataFrame) -> dict[str, DataFrame]:
    """What a step looks up, written once for all rounds: by (file, name), by (file, local), by file."""
    tops, imports = cut(tops.select("file", "name", "id", "exported"), "tops"), cut(imports.withColumn("shown", F.coalesce("alias", "name")), "imports")
    to = F.when(F.col("target").isNotNull() & (F.col("name") != "*"), F.struct(F.col("target").alias("file"), "name"))
    entry = F.struct("kind", "name", F.when((F.col("kind") == "reexport") & (F.col("name") == "*"), F.col("target")).alias("whole"), F.when(F.col("kind") == "reexport", to).alias("next"))
    explicit = imports.filter("kind = 'export' OR (kind = 'reexport' AND NOT (name = '*' AND alias IS NULL))").groupBy("file", F.col("shown").alias("asked")).agg(F.min_by(entry, "pos").alias("entry"))
    # A list names a local thing: a declaration, or what an import binds.
    bound = imports.filter("kind IN ('', 'require')").groupBy("file", F.col("shown").alias("local")).agg(F.min_by(F.struct(F.when(F.col("name") == "*", F.col("target")).alias("whole"), to.alias("next")), "pos").alias("bound"))
    renamed = imports.filter("kind = 'export'").select("file", "name").distinct().withColumn("listed", F.lit(True))
    own = tops.filter("exported").select("file", "name", F.col("id").alias("own_id")).join(renamed, KEY, "left").filter("listed IS NULL").drop("listed")
    stars = imports.filter("kind = 'reexport' AND name = '*' AND alias IS NULL AND target IS NOT NULL").groupBy("file").agg(F.collect_set("target").alias("targets"))
    local = tops.select("file", F.col("name").alias("local"), F.col("id").alias("local_id"))
    return {"explicit": cut(explicit.withColumnRenamed("asked", "name"), "explicit"), "local": local, "bound": cut(bound, "bound"), "own": cut(own, "own"), "stars": cut(stars, "stars")}


def _steps(keys: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """keys with what answers first: `id`, or `next` (file, name) to ask instead, or `stars` to ask; none of them: nothing.

    Order: an export list's or a named re-export's entry, then an own exported name that no list renames, then stars.
    """
    rows = keys.join(t["explicit"], KEY, "left").withColumn("local", F.when(F.col("entry.kind") == "export", F.col("entry.name")))
    rows = rows.join(t["local"], ["file", "local"], "left").join(t["bound"], ["file", "local"], "left").join(t["own"], KEY, "left").join(t["stars"], "file", "left")
    listed, passed_on = F.col("entry").isNotNull(), F.col("entry.kind") == "reexport"
    id_ = F.when(passed_on, F.col("entry.whole")).when(listed, F.coalesce("local_id", F.when(F.col("local_id").isNull(), F.col("bound.whole")))).otherwise(F.col("own_id"))
    next_ = F.when(passed_on, F.col("entry.next")).when(listed & F.col("local_id").isNull(), F.col("bound.next"))
    star = F.when(~listed & F.col("own_id").isNull() & (F.col("name") != "default"), F.col("targets"))
    return rows.select("file", "name", id_.alias("id"), next_.alias("next"), star.alias("stars"))


def exported(asks: DataFrame, tops: DataFrame, imports: DataFrame) -> DataFrame:
    """asks(file, name) with the id that the file exports so, or null.

    tops: (file, name, id, exported), the declarations. imports: (file, pos, kind, name, alias, target): kind is '' or
    `require` (binds a name), `export` (a list entry) or `reexport`; the target is the imported file or null; `*` stands
    for the whole file. Two different answers through stars give nothing; a default never passes through a star. A ring
    of re-exports gives nothing by itself; what enters a ring of stars from outside answers for all its files. Each file
    answers for itself, whoever asks and in whatever order.

    Rounds: one a step of the longest chain to find the names concerned, the logarithm of it to follow named
    re-exports (pointers double), one a level of stars. Each round's tables are as large as the names concerned.
    """
    tables = _tables(tops, imports)
    known = cut(_steps(asks.select(*KEY).distinct(), tables), "exports")
    parts, new = [known], known
    while True:
        asked = new.filter("next IS NOT NULL").select("next.file", "next.name").unionByName(new.filter("stars IS NOT NULL").select(F.explode("stars").alias("file"), "name"))
        fresh = cut(asked.distinct().join(known.select(*KEY), KEY, "left_anti"), "exports")
        if fresh.isEmpty():
            break
        new = cut(_steps(fresh, tables), "exports")
        parts.append(new)
        known = known.unionByName(new)
    known = cut(known, "exports")
    # Named re-exports: pointers to the first key that isn't one; those that still point to one run in a ring.
    ahead = known.filter("next IS NOT NULL").select("file", "name", "next")
    for _ in range(max(1, math.ceil(math.log2(ahead.count() + 2)))):
        after = ahead.select(F.struct(*KEY).alias("next"), F.col("next").alias("further"))
        ahead = cut(ahead.join(after, "next", "left").select("file", "name", F.coalesce("further", "next").alias("next")), "ahead")
    ends = known.filter("next IS NULL").select(F.struct(*KEY).alias("next"), F.struct(*KEY).alias("end"))
    ends_at = ahead.join(ends, "next", "left").select("file", "name", "end").unionByName(known.filter("next IS NULL").select("file", "name", F.struct(*KEY).alias("end")))
    ends_at = cut(ends_at, "ends")
    # Stars: a key is settled once all that it asks is; of rings, which never are, at last by what reaches them.
    settled = cut(known.filter("next IS NULL AND stars IS NULL").select("file", "name", "id"), "settled")
    asks_of = known.filter("stars IS NOT NULL").select(F.struct(*KEY).alias("key"), F.explode("stars").alias("file"), "name").join(ends_at, KEY).filter("end IS NOT NULL").select("key", "end").distinct()
    stars = known.filter("stars IS NOT NULL").select(F.struct(*KEY).alias("key"))
    open_edges = cut(stars.join(asks_of, "key", "left"), "star")
    while True:
        done = settled.select(F.struct(*KEY).alias("end"), "id", F.lit(True).alias("done"))
        state = open_edges.join(done, "end", "left").groupBy("key").agg(F.bool_and(F.col("done").isNotNull() | F.col("end").isNull()).alias("ready"), F.collect_set("id").alias("ids"))
        ready = cut(state.filter("ready").select("key.file", "key.name", F.when(F.size("ids") == 1, F.col("ids")[0]).alias("id")), "settled")
        if ready.isEmpty():
            break
        settled = cut(settled.unionByName(ready), "settled")
        open_edges = cut(open_edges.join(ready.select(F.struct(*KEY).alias("key")), "key", "left_anti"), "star")
    reach = cut(open_edges.join(settled.select(F.struct(*KEY).alias("end"), "id"), "end").filter("id IS NOT NULL").select("key", "id").distinct(), "reach")
    spread = reach
    while not spread.isEmpty():
        come = open_edges.join(spread.select(F.col("key").alias("end"), "id"), "end").select("key", "id").distinct()
        spread = cut(come.join(reach, ["key", "id"], "left_anti"), "reach")
        reach = reach.unionByName(spread)
    rings = reach.groupBy("key").agg(F.collect_set("id").alias("ids")).filter(F.size("ids") == 1).select("key.file", "key.name", F.col("ids")[0].alias("id"))
    values = settled.unionByName(rings).filter("id IS NOT NULL").select(F.struct(*KEY).alias("end"), "id")
    found = ends_at.join(values, "end").select("file", "name", "id")
    return asks.join(found, KEY, "left")
