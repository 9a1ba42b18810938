"""Releases that a list of pinned versions doesn't know yet, and which announcements of them are settled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of a version that are compared; missing ones are 0.
WIDTH = 6
#: Pre-release stages in order.
STAGES = {"dev": 0, "a": 1, "alpha": 1, "b": 2, "beta": 2, "preview": 2, "rc": 3, "RC": 3}
_GENERAL = r"^([0-9]+)\.([0-9]+)(?:\.[0-9]+)?-?(dev|alpha|a|beta|b|preview|rc|RC)\.?([0-9]+)$"
_LINE_ALPHA = r"^([0-9]+)\.0\.0-alpha\.([0-9]+)(?:\.[0-9]+)*$"
_MAJOR_ONLY = r"^([0-9]+)-(?:draft|ea)$"


def padded(numbers: Column) -> Column:
    return F.slice(F.concat(numbers, F.array_repeat(F.lit(0), WIDTH)), 1, WIDTH)


def numbers(version: Column) -> Column:
    """The numbers of a plain version, a leading v aside; null for anything else."""
    bare = F.regexp_replace(version, "^v", "")
    return F.when(bare.rlike(r"^[0-9]+(\.[0-9]+)*$"), F.transform(F.split(bare, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0))))


def leads_to(version: Column) -> Column:
    """The numbers of the version that a pre-release leads to: major and minor, or the major alone; null for anything else."""
    at = lambda p, i: F.regexp_extract(version, p, i).try_cast("int")
    return F.when(version.rlike(_LINE_ALPHA), F.array(at(_LINE_ALPHA, 1))).when(version.rlike(_GENERAL), F.array(at(_GENERAL, 1), at(_GENERAL, 2))).when(version.rlike(_MAJOR_ONLY), F.array(at(_MAJOR_ONLY, 1)))


def stage(version: Column) -> Column:
    """[stage, number] of a pre-release: dev before alpha before beta and preview before rc."""
    word = F.regexp_extract(version, _GENERAL, 3)
    rank = F.coalesce(*[F.when(word == w, F.lit(n)) for w, n in STAGES.items()], F.lit(0))
    return F.when(version.rlike(_LINE_ALPHA), F.array(F.lit(1), F.regexp_extract(version, _LINE_ALPHA, 2).try_cast("int"))).when(version.rlike(_GENERAL), F.array(rank, F.regexp_extract(version, _GENERAL, 4).try_cast("int"))).otherwise(F.array(F.lit(0), F.lit(0)))


def newest(subjects: DataFrame, releases: DataFrame, followers: tuple[str, ...] = ()) -> DataFrame:
    """(fixture, stack, kind, name, major, found, version): per pinned line the newest release that the list lacks.

    subjects(pos, fixture, stack, kind, name, version, held); releases(kind, name, version, pre). A line is a major of a
    subject in a fixture's stack. A greater minor of its major counts if the line's first version has a minor; a greater
    major counts for the line that holds the highest major. A runtime without a new release gets its newest
    pre-release by the same rule. followers: subjects whose major another subject decides. Held ones ask for nothing.
    """
    line = ["fixture", "stack", "kind", "name", "major"]
    rows = subjects.filter("NOT held").withColumn("v", numbers(F.col("version"))).filter("v IS NOT NULL").withColumn("major", F.col("v")[0])
    lines = rows.groupBy(*line).agg(F.max(padded(F.col("v"))).alias("most"), F.least(F.min_by(F.size("v"), "pos"), F.lit(2)).alias("parts"))
    top = rows.groupBy("kind", "name").agg(F.max("major").alias("top"))
    in_fixture = lines.groupBy("fixture", "kind", "name").agg(F.max("major").alias("fixture_top"))
    in_stack = lines.groupBy("fixture", "stack", "kind", "name").agg(F.max("major").alias("stack_top"))
    lines = lines.join(top, ["kind", "name"]).join(in_fixture, ["fixture", "kind", "name"]).join(in_stack, ["fixture", "stack", "kind", "name"])
    # The highest major, or the highest of its stack where another stack of the fixture holds the highest.
    lines = lines.withColumn("leads", (F.col("major") == F.col("top")) | ((F.col("major") == F.col("stack_top")) & (F.col("fixture_top") == F.col("top"))))
    # Of a subject's releases only each minor's best can be an answer, so that lines meet few of them.
    plain = releases.filter("NOT pre").withColumn("r", numbers(F.col("version"))).filter("r IS NOT NULL").select("kind", "name", F.lit("new").alias("found"), padded(F.col("r")).alias("key"), "version", "r")
    early = releases.filter("pre").withColumn("r", leads_to(F.col("version"))).filter("r IS NOT NULL AND kind = 'runtime'").select("kind", "name", F.lit("pre").alias("found"), padded(F.concat("r", stage(F.col("version")))).alias("key"), "version", "r")
    offers = plain.unionByName(early).withColumns({"r0": F.col("r")[0], "r1": F.coalesce(F.get("r", F.lit(1)), F.lit(0))})
    offers = offers.groupBy("kind", "name", "found", "r0", "r1").agg(F.max("key").alias("key"), F.max_by("version", "key").alias("version"))
    greater = F.col("leads") & (F.col("r0") > F.col("major")) & ((F.col("found") == "pre") | ~F.col("name").isin(*followers) if followers else F.lit(True))
    minor = (F.col("parts") == 2) & (F.col("r0") == F.col("major")) & (F.col("r1") > F.col("most")[1])
    hits = lines.join(offers, ["kind", "name"]).filter(greater | minor)
    best = hits.groupBy(*line, "parts").agg(F.max(F.struct((F.col("found") == "new").alias("released"), "key", "version", "r0", "r1")).alias("b"))
    said = F.when(~F.col("b.released"), F.col("b.version")).when(F.col("parts") == 2, F.concat_ws(".", "b.r0", "b.r1")).otherwise(F.col("b.r0").cast("string"))
    return best.select(*line, F.when(F.col("b.released"), "new").otherwise("pre").alias("found"), said.alias("version"))


def title(found: DataFrame) -> Column:
    """`fixture[@stack]/label version is out`; the stack where a fixture has several, a crate with its kind."""
    return F.concat("fixture", F.when(F.col("several"), F.concat(F.lit("@"), "stack")).otherwise(""), F.lit("/"), F.when(F.col("kind") == "crate", "crate:").otherwise(""), "name", F.lit(" "), "version", F.lit(" is out"))


def settled(titles: DataFrame, subjects: DataFrame, current: DataFrame) -> DataFrame:
    """(title, resolved, superseded) of announcements.

    Resolved: the list has, for the title's line, a version at least the one it announces, as far as both have numbers;
    `name version is past end of support` is resolved when no runtime is so pinned. Superseded: it announces a
    pre-release that current(title) doesn't.
    """
    out, old = r"^([^\s/]+)/(\S+) (\S+) is out$", r"^(\S+) (\S+) is past end of support$"
    at = lambda p, i: F.regexp_extract("title", p, i)
    rows = titles.select("title").distinct()
    label = F.when(F.col("kind") == "crate", F.concat(F.lit("crate:"), "name")).otherwise(F.col("name"))
    pinned = subjects.select("fixture", F.col("stack").alias("pinned_stack"), label.alias("label"), numbers(F.col("version")).alias("v")).filter("v IS NOT NULL").distinct()
    asked = rows.filter(F.col("title").rlike(out)).select("title", F.substring_index(at(out, 1), "@", 1).alias("fixture"), F.when(F.contains(at(out, 1), F.lit("@")), F.substring_index(at(out, 1), "@", -1)).alias("stack"), at(out, 2).alias("label"), numbers(at(out, 3)).alias("want")).filter("want IS NOT NULL")
    size = F.least(F.size("v"), F.size("want"))
    enough = asked.join(pinned, ["fixture", "label"]).filter((F.col("stack").isNull() | (F.col("stack") == F.col("pinned_stack"))) & (padded(F.slice("v", F.lit(1), size)) >= padded(F.col("want")))).select("title").distinct()
    ends = rows.filter(F.col("title").rlike(old)).select("title", at(old, 1).alias("name"), at(old, 2).alias("version"))
    gone = ends.join(subjects.filter("kind = 'runtime'").select("name", "version").distinct(), ["name", "version"], "left_anti").select("title")
    resolved = enough.unionByName(gone).withColumn("resolved", F.lit(True))
    stands = current.select("title").distinct().withColumn("stands", F.lit(True))
    early = F.coalesce(leads_to(at(out, 3)).isNotNull() & F.col("title").rlike(out), F.lit(False))
    return rows.join(resolved, "title", "left").join(stands, "title", "left").select("title", F.coalesce("resolved", F.lit(False)).alias("resolved"), (early & F.col("stands").isNull()).alias("superseded"))
