"""Audits over changes, sources, tools and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ancestors, collapse


def wiki_drift(changes: DataFrame, wikis: DataFrame) -> DataFrame:
    """(project, changed) of projects with changed code and no change in their wiki: changes(project, path), wikis(project, wiki).

    `.` is a wiki that holds every path. Projects without a wiki are not judged.
    """
    rows = changes.join(wikis, "project")
    inside = (F.col("wiki") == ".") | F.col("path").startswith(F.concat("wiki", F.lit("/")))
    per = rows.groupBy("project").agg(F.count_if(~inside).alias("changed"), F.count_if(inside).alias("touched"))
    return per.filter("changed > 0 AND touched = 0").select("project", "changed")


def cited_scope(resource: Column, scheme: str) -> Column:
    """The path that a resource of this scheme names, without anchor, query and slashes around it; null for another one or none."""
    rest = F.substring_index(F.substring_index(F.substr(resource, F.lit(len(scheme) + 1)), "#", 1), "?", 1)
    bare = F.regexp_replace(rest, "^/+|/+$", "")
    return F.when((F.lower(F.left(resource, F.lit(len(scheme)))) == scheme.lower()) & (bare != ""), bare)


def wrong_direction(sources: DataFrame, areas: DataFrame, scheme: str = "brain:") -> DataFrame:
    """(scope, path, cited) where a page of a shared area cites what lies in no shared area: sources(scope, path, resource), areas(scope, shared)."""
    shared = areas.filter("shared").select("scope").distinct()
    rows = sources.join(shared, "scope", "left_semi").withColumn("cited", cited_scope(F.col("resource"), scheme)).filter("cited IS NOT NULL")
    # A scope covers itself and all below it: every path above what is cited is looked up.
    above = rows.select("cited").distinct().select("cited", F.explode(F.concat(ancestors(F.col("cited")), F.array("cited"))).alias("scope"))
    fine = above.join(shared, "scope", "left_semi").select("cited").distinct()
    return rows.join(fine, "cited", "left_anti").select("scope", "path", "cited")


def instrumented(files: DataFrame, settings: DataFrame, profiles: DataFrame) -> DataFrame:
    """(path, profile) of files(path, text) that still begin with a profile's marker.

    settings(dir, profile): where a profile is active, for all below; '' is the root. profiles(profile, marker, extension).
    """
    first = F.regexp_replace(F.substring_index("text", "\n", 1), "\r$", "")
    # The marker decides first, so that only files that bear one are looked at further.
    marked = files.select("path", first.alias("marker"), F.regexp_extract("path", r"(\.[^./]*)$", 1).alias("extension")).join(F.broadcast(profiles), ["marker", "extension"])
    return marked.select("path", "profile", F.explode(ancestors(F.col("path"))).alias("dir")).join(settings, ["dir", "profile"], "left_semi").select("path", "profile").distinct()


# Commands by which lanes run a tool.
COMMANDS = {"go-vet": "go vet", "go-test": "go test", "cargo-test": "cargo test", "dotnet-test": "dotnet test", "mvn-test": "mvn test"}


def tool_gaps(declared: DataFrame, lanes: DataFrame) -> DataFrame:
    """(project, tool, lane) of declared(project, tool): the first of the project's lanes(project, pos, lane) that runs the tool as a command of its own, or null."""
    command = F.coalesce(*[F.when(F.col("tool") == t, F.lit(c)) for t, c in COMMANDS.items()], F.col("tool"))
    word = F.concat(F.lit(r"(?:^|[ \t\n;&|(])\Q"), command, F.lit(r"\E(?:$|[ \t\n])"))
    met = declared.select("project", "tool").distinct().join(lanes, "project").withColumn("lane", F.trim("lane")).filter(F.regexp_like("lane", word))
    first = met.groupBy("project", "tool").agg(F.min_by("lane", "pos").alias("lane"))
    return declared.join(first, ["project", "tool"], "left").select("project", "tool", "lane")


def tool_coverage(gaps: DataFrame) -> DataFrame:
    """(project, covered): the share of declared tools that a lane runs, in percent."""
    return gaps.groupBy("project").agg(F.round(100.0 * F.count("lane") / F.count("*"), 6).alias("covered"))


def question_problems(questions: DataFrame, targets: DataFrame, kinds: dict[str, int]) -> DataFrame:
    """(id, problem) of questions(id, kind, question, target, evidence) against targets(target, text).

    A missing field, an id that is given twice, a kind of the wrong number (id null), a target that isn't there, evidence
    that doesn't stand in it, blanks aside.
    """
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    lacks = F.array_join(F.filter(F.array(*[F.when(text(c) == "", F.lit(c)) for c in ("id", "kind", "question", "target", "evidence")]), lambda x: x.isNotNull()), ",")
    rows = questions.withColumn("lacks", lacks)
    missing = rows.filter("lacks <> ''").select("id", F.concat(F.lit("missing: "), "lacks").alias("problem"))
    twice = questions.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 AND id IS NOT NULL").select("id", F.lit("given twice").alias("problem"))
    spark = questions.sparkSession
    wanted = spark.createDataFrame(list(kinds.items()), "kind string, wanted long")
    numbers = questions.groupBy("kind").agg(F.count("*").alias("n")).join(F.broadcast(wanted), "kind", "full_outer").filter("NOT coalesce(n, 0) <=> coalesce(wanted, 0)")
    counts = numbers.select(F.lit(None).cast("string").alias("id"), F.concat(F.lit("kind "), F.coalesce("kind", F.lit("?")), F.lit(": "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" of "), F.coalesce("wanted", F.lit(0)).cast("string")).alias("problem"))
    flat = lambda c: collapse(F.col(c), 2**30)
    asked = rows.filter("lacks = ''").join(targets, "target", "left")
    quoted = asked.select("id", F.when(F.col("text").isNull(), "no such target").when(~F.contains(flat("text"), flat("evidence")), "evidence not found").alias("problem")).filter("problem IS NOT NULL")
    return missing.unionByName(twice).unionByName(counts).unionByName(quoted)
