"""Ignore rules that files inherit along their directories; of all rules that fit, the last decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoint import join_hot
from ..functions.text import ancestors

#: Levels of a rule's source, weakest first.
GLOBAL, EXCLUDE, DIRECTORY = 0, 1, 2


def _segment(glob: Column) -> Column:
    """One segment of a pattern as a regular expression: `*` and `?` stay within it; a class is a class; a backslash quotes."""
    # Classes and quoted characters are set aside under characters that no path holds, then all else is quoted.
    out = F.regexp_replace(glob, r"\\(.)", "\x01$1\x02")
    out = F.regexp_replace(out, r"\[[!^]([^\]]+)\]", "\x03$1\x05")
    out = F.regexp_replace(out, r"\[([^\]]+)\]", "\x04$1\x05")
    out = F.regexp_replace(out, r"([.+^$(){}|\\\[\]])", r"\\$1")
    out = F.regexp_replace(out, r"\*+", "[^/]*")
    out = F.regexp_replace(out, r"\?", "[^/]")
    out = F.regexp_replace(out, "\x01\\\\?(.)\x02", r"\\Q$1\\E")
    out = F.regexp_replace(out, "\x03", "[^/")
    return F.regexp_replace(F.regexp_replace(out, "\x04", "["), "\x05", "]")


def parse_rules(lines: DataFrame) -> DataFrame:
    """Rules of ignore files given as (level, base, line_no, line): (level, base, line_no, negate, dir_only, regex over the path below base).

    Comments and blank lines are none; trailing blanks go unless quoted. A pattern with a slash inside or in front is
    anchored at its base, another one fits any base name below. `**` stands for any number of segments.
    """
    rows = lines.withColumn("line", F.regexp_replace("line", "\r$", "")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    rows = rows.withColumn("line", F.regexp_replace("line", r"((?:^|[^\\])(?:\\\\)*) +$", "$1")).filter("line <> ''")
    rows = rows.withColumn("negate", F.col("line").startswith("!")).withColumn("line", F.regexp_replace("line", "^!", ""))
    rows = rows.withColumn("dir_only", F.col("line").endswith("/")).withColumn("line", F.regexp_replace("line", "/$", "")).filter("line <> ''")
    rows = rows.withColumn("anchored", F.contains("line", F.lit("/"))).withColumn("line", F.regexp_replace("line", "^/", "")).filter("line <> ''")
    # Each segment brings the slash before it; `**` brings its own.
    steps = F.transform(F.split("line", "/"), lambda s, i: F.when(s == "**", F.lit("(?:/[^/]+)*")).otherwise(F.concat(F.lit("/"), _segment(s))))
    regex = F.when(F.col("anchored"), F.concat(F.lit("^"), F.array_join(steps, ""), F.lit("$"))).otherwise(F.concat(F.lit("/"), _segment(F.col("line")), F.lit("$")))
    return rows.select("level", "base", "line_no", "negate", "dir_only", regex.alias("regex"))


def last_rules(rules: DataFrame) -> DataFrame:
    """The rules that can decide: of equal patterns of one rule file only the last, since all of them fit the same paths.

    `literal` is what a fitting path holds at least: the pattern's plain characters in front.
    """
    last = rules.groupBy("level", "base", "regex", "dir_only").agg(F.max(F.struct("line_no", "negate")).alias("last"))
    return last.select("level", "base", "last.line_no", "last.negate", "dir_only", "regex", F.regexp_extract("regex", r"^\^?([/A-Za-z0-9_-]*)(?![*+?{])", 1).alias("literal"))


def ignored(files: DataFrame, rules: DataFrame, path: str = "path", tracked: str | None = None) -> DataFrame:
    """files with `ignored`.

    A path below an ignored directory is ignored, whatever later rules say; else the last fitting rule of the global
    ones, the excludes and the directories' files from the root down decides, and a negated one takes it back. Tracked
    files never are. Each file and each directory meets, by equal directory, only the rule files above it.
    """
    above = F.filter(ancestors(F.col(path)), lambda d: d != "")
    own = files.select(F.col(path).alias("unit"), F.lit(False).alias("is_dir")).distinct()
    units = own.unionByName(files.select(F.explode(above).alias("unit"), F.lit(True).alias("is_dir")).distinct())
    # A rule file is one row; the rules that hold everywhere are its level's in the root.
    sets = last_rules(rules).groupBy("base").agg(F.array_sort(F.collect_list(F.struct("level", "line_no", "regex", "negate", "dir_only", "literal"))).alias("rules"))
    met = join_hot(units.select("unit", "is_dir", F.explode(ancestors(F.col("unit"))).alias("base")), sets, "base")
    below = F.when(F.col("base") == "", F.concat(F.lit("/"), "unit")).otherwise(F.substr("unit", F.length("base") + 1))
    fits = F.filter("rules", lambda r: (~r["dir_only"] | F.col("is_dir")) & F.contains(F.col("below"), r["literal"]) & F.regexp_like(F.col("below"), r["regex"]))
    last = met.withColumn("below", below).select("unit", "is_dir", "base", F.get(fits, F.size(fits) - 1).alias("rule")).filter("rule IS NOT NULL")
    verdict = last.groupBy("unit", "is_dir").agg(F.max_by("rule.negate", F.struct("rule.level", F.length("base"), "rule.line_no")).alias("negate"))
    hidden = verdict.filter("NOT negate").select("unit", "is_dir")
    asked = files.select(F.col(path).alias("p")).distinct()
    asked = asked.select("p", F.explode(F.concat(F.transform(F.filter(ancestors(F.col("p")), lambda d: d != ""), lambda d: F.struct(d.alias("unit"), F.lit(True).alias("is_dir"))), F.array(F.struct(F.col("p").alias("unit"), F.lit(False).alias("is_dir"))))).alias("u")).select("p", "u.unit", "u.is_dir")
    gone = join_hot(asked.withColumn("u", F.struct("unit", "is_dir")), hidden.select(F.struct("unit", "is_dir").alias("u")), "u").select("p").distinct().withColumn("hidden", F.lit(True))
    rows = files.join(gone.withColumnRenamed("p", path), path, "left")
    held = F.coalesce(F.col(tracked), F.lit(False)) if tracked else F.lit(False)
    return rows.select(*files.columns, (F.coalesce("hidden", F.lit(False)) & ~held).alias("ignored"))
