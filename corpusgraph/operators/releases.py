"""Coverage tables, mutation rounds, audits, version matrices and reports of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def function_coverage(lines: DataFrame) -> DataFrame:
    """(path, line, func, percent) of `file:line: func percent%` rows in `value`; other rows are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    site = r"^(.+):([0-9]+):$"
    rows = lines.select(parts.alias("p")).filter("size(p) = 3")
    at = F.col("p")[0]
    out = rows.select(F.regexp_extract(at, site, 1).alias("path"), F.regexp_extract(at, site, 2).try_cast("long").alias("line"), F.col("p")[1].alias("func"), F.regexp_extract(F.col("p")[2], r"^([0-9.]+)%$", 1).try_cast("double").alias("percent"))
    return out.filter("line IS NOT NULL AND percent IS NOT NULL")


def coverage_gate(functions: DataFrame, exempt: DataFrame) -> DataFrame:
    """Functions below 100 % without an exemption(path, line, reason) with a reason on the line above."""
    held = exempt.filter("trim(reason) <> ''").select("path", (F.col("line") + 1).alias("line")).distinct()
    return functions.filter("percent < 100").join(held, ["path", "line"], "left_anti")


def speedup_counts(compared: DataFrame) -> DataFrame:
    """One row of counts over (name, state, factor)."""
    both, f = F.col("state") == "compared", F.col("factor")
    n = lambda c, name: F.count_if(c).alias(name)
    return compared.agg(n(both, "compared"), n(both & (f > 1), "faster"), n(both & (f > 0) & (f < 1), "slower"), n(both & ((f <= 0) | (f == 1)), "unclear"), n(F.col("state") == "added", "added"), n(F.col("state") == "dropped", "dropped"))


def corpus_averages(rows: DataFrame) -> DataFrame:
    """One row: mean coverage of all, mean speed-up of those with one."""
    return rows.agg(F.avg("coverage").alias("coverage"), F.avg(F.when(F.col("speedup") > 0, F.col("speedup"))).alias("speedup"))


def upsert(old: DataFrame, new: DataFrame, key: str, inherited: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; inherited text columns keep the old value where the new one is empty."""
    columns = [c for c in old.columns if c != key]
    both = old.select(key, F.struct(*columns).alias("o")).join(new.select(key, F.struct(*columns).alias("n")), key, "full_outer")
    pick = lambda c: F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit("")), F.col(f"o.{c}")) if c in inherited else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(key, *[pick(c).alias(c) for c in columns])


def mutation_summary(outcomes: DataFrame) -> DataFrame:
    """Counts per package of outcomes(package, outcome); what timed out counts as killed, too."""
    n = lambda name, *of: F.count_if(F.col("outcome").isin(*of)).alias(name)
    return outcomes.groupBy("package").agg(n("killed", "failed", "timed_out"), n("survived", "passed"), n("not_compiled", "build_failed"), n("no_mutant", "unchanged"), n("timed_out", "timed_out"))


def extraction_tally(files: DataFrame) -> DataFrame:
    """Per language of files(language, state): files, parsed, reused and failed ones."""
    n = lambda s: F.count_if(F.col("state") == s)
    return files.groupBy("language").agg(F.count("*").alias("files"), n("parsed").alias("parsed"), n("reused").alias("reused"), n("error").alias("errors"))


def select_matrix(entries: DataFrame, keys: DataFrame, fixtures: DataFrame) -> DataFrame:
    """(key, os) of entries(key, fixture, os) whose key or fixture is wanted, a row per system."""
    hit = entries.join(keys, "key", "left_semi").unionByName(entries.join(fixtures, "fixture", "left_semi").select(entries.columns)).select("key", "os").distinct()
    return hit.select("key", F.explode("os").alias("os"))


def changed_entries(now: DataFrame, old: DataFrame) -> DataFrame:
    """(key) of entries that are new or differ in any column."""
    rest = [c for c in now.columns if c != "key"]
    was = old.select("key", F.struct(*rest).alias("was"))
    return now.select("key", F.struct(*rest).alias("now")).join(was, "key", "left").filter(~F.col("now").eqNullSafe(F.col("was"))).select("key")


def end_of_support(entries: DataFrame, eol: DataFrame) -> DataFrame:
    """(runtime, version, ends) of each distinct pair by eol(runtime, cycle, ends): the whole version, else without its last part."""
    pairs = entries.select("runtime", "version").distinct()
    full = eol.select("runtime", F.col("cycle").alias("version"), F.col("ends").alias("e1"))
    short = eol.select("runtime", F.col("cycle").alias("trimmed"), F.col("ends").alias("e2"))
    rows = pairs.withColumn("trimmed", F.regexp_replace("version", r"\.[^.]*$", "")).join(full, ["runtime", "version"], "left").join(short, ["runtime", "trimmed"], "left")
    return rows.select("runtime", "version", F.coalesce("e1", "e2").alias("ends"))


def not_run(planned: DataFrame, ran: DataFrame) -> DataFrame:
    """planned(key) for which neither the key nor its stem is among ran(key)."""
    stem = F.regexp_replace("key", r"\.[^./]*$", "")
    keys = ran.select(F.col("key").alias("k")).distinct()
    rows = planned.join(keys, planned["key"] == keys["k"], "left_anti").withColumn("k", stem)
    return rows.join(keys, "k", "left_anti").select("key")


def newest_report(reports: DataFrame) -> DataFrame:
    """Per suite the report of reports(suite, number, mtime) with the latest mtime, then the greatest number."""
    return reports.groupBy("suite").agg(F.max(F.struct("mtime", "number")).alias("m")).select("suite", F.col("m.number").alias("number"))
