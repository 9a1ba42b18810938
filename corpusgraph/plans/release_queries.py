"""Queries of the operators on coverage tables, mutation rounds, audits, version matrices and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import releases, reports
from .registry import Tables, query

PARSED = r"f AS (SELECT regexp_extract(value, '^(.+):([0-9]+):\s', 1) AS path, CAST(regexp_extract(value, '^(.+):([0-9]+):\s', 2) AS BIGINT) AS line, regexp_extract(value, '\s(\S+)\s', 1) AS func, CAST(regexp_extract(value, '\s([0-9.]+)%$', 1) AS DOUBLE) AS percent FROM f_table WHERE ends_with(value, '%'))"


@query("s16_function_coverage", f"WITH {PARSED} SELECT * FROM f")
def functions(t: Tables) -> DataFrame:
    return releases.function_coverage(t.f_table)


@query("a13_coverage_gate", f"WITH {PARSED} SELECT path, line, func, percent FROM f WHERE percent < 100 AND NOT EXISTS (SELECT 1 FROM f_exempt x WHERE x.path = f.path AND x.line + 1 = f.line AND trim(reason) <> '')")
def gate(t: Tables) -> DataFrame:
    return releases.coverage_gate(releases.function_coverage(t.f_table), t.f_exempt).select("path", "line", "func", "percent")


@query(
    "a15_speedups",
    """WITH b AS (SELECT series, round(avg(ms), 6) AS a FROM b_timings WHERE seq % 2 = 0 GROUP BY series), c AS (SELECT series, round(avg(ms), 6) AS b FROM b_timings WHERE seq % 2 = 1 GROUP BY series),
j AS (SELECT a, b, CASE WHEN a > 0 AND b > 0 THEN round(a / b, 6) ELSE 0 END AS f FROM b FULL JOIN c USING (series))
SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS compared, count(*) FILTER (f > 1) AS faster, count(*) FILTER (f > 0 AND f < 1) AS slower, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND (f <= 0 OR f = 1)) AS unclear, count(*) FILTER (a IS NULL) AS added, count(*) FILTER (b IS NULL) AS dropped FROM j""",
)
def speedups(t: Tables) -> DataFrame:
    mean = lambda k: t.b_timings.filter(F.col("seq") % 2 == k).groupBy(F.col("series").alias("name")).agg(F.round(F.avg("ms"), 6).alias("mean"))
    return releases.speedup_counts(reports.compare_timings(mean(0), mean(1)))


@query("a16_corpus_averages", "SELECT round(avg(size), 6) AS coverage, round(avg(CASE WHEN partkey % 5 - 1 > 0 THEN partkey % 5 - 1 END), 6) AS speedup FROM s_tree")
def averages(t: Tables) -> DataFrame:
    found = releases.corpus_averages(t.s_tree.select(F.col("size").alias("coverage"), (F.col("partkey") % 5 - 1).alias("speedup")))
    return found.select(F.round("coverage", 6).alias("coverage"), F.round("speedup", 6).alias("speedup"))


@query(
    "a17_upsert",
    """WITH o AS (SELECT c_custkey AS slug, c_mktsegment AS segment, 1 AS run FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS slug, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'new' END AS segment, 2 AS run FROM customer WHERE c_custkey % 2 = 0)
SELECT slug, coalesce(nullif(n.segment, ''), o.segment) AS segment, coalesce(n.run, o.run) AS run FROM o FULL JOIN n USING (slug)""",
)
def upsert(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    old = t.customer.filter(key % 3 != 0).select(key.alias("slug"), F.col("c_mktsegment").alias("segment"), F.lit(1).alias("run"))
    new = t.customer.filter(key % 2 == 0).select(key.alias("slug"), F.when(key % 4 == 0, "").otherwise("new").alias("segment"), F.lit(2).alias("run"))
    return releases.upsert(old, new, "slug", ["segment"])


@query("a21_mutants", "SELECT package, count(*) FILTER (outcome IN ('failed', 'timed_out')) AS killed, count(*) FILTER (outcome = 'passed') AS survived, count(*) FILTER (outcome = 'build_failed') AS not_compiled, count(*) FILTER (outcome = 'unchanged') AS no_mutant, count(*) FILTER (outcome = 'timed_out') AS timed_out FROM u_outcomes GROUP BY package")
def mutants(t: Tables) -> DataFrame:
    return releases.mutation_summary(t.u_outcomes)


@query("a5_tally", "SELECT regexp_extract(lower(path), '[.]([a-z]+)$', 1) AS language, count(*) AS files, count(*) FILTER (size % 3 = 0) AS parsed, count(*) FILTER (size % 3 = 1) AS reused, count(*) FILTER (size % 3 = 2) AS errors FROM s_tree GROUP BY 1")
def tally(t: Tables) -> DataFrame:
    state = F.when(F.col("size") % 3 == 0, "parsed").when(F.col("size") % 3 == 1, "reused").otherwise("error")
    return releases.extraction_tally(t.s_tree.select(F.regexp_extract(F.lower("path"), r"\.([a-z]+)$", 1).alias("language"), state.alias("state")))


@query("j36_matrix", "SELECT key, unnest(os) AS os FROM x_entries WHERE key % 10 = 0 OR fixture = 'Brand#11'")
def matrix(t: Tables) -> DataFrame:
    return releases.select_matrix(t.x_entries, t.x_entries.filter("key % 10 = 0").select("key"), t.spark.createDataFrame([("Brand#11",)], "fixture string"))


@query("j37_changed_entries", "SELECT n.key FROM x_entries n LEFT JOIN x_old o ON o.key = n.key WHERE o.key IS NULL OR o.version <> n.version")
def changed(t: Tables) -> DataFrame:
    return releases.changed_entries(t.x_entries, t.x_old)


@query("j38_end_of_support", "SELECT DISTINCT x.runtime, x.version, coalesce(a.ends, b.ends) AS ends FROM x_entries x LEFT JOIN x_eol a ON a.runtime = x.runtime AND a.cycle = x.version LEFT JOIN x_eol b ON b.runtime = x.runtime AND b.cycle = split_part(x.version, '.', 1)")
def support(t: Tables) -> DataFrame:
    return releases.end_of_support(t.x_entries, t.x_eol)


@query("j44_not_run", "SELECT path AS key FROM g_files WHERE custkey % 10 = 0 AND custkey % 20 <> 0")
def not_run(t: Tables) -> DataFrame:
    ran = t.g_files.filter("custkey % 10 <> 0").select(F.col("path").alias("key")).unionByName(t.g_files.filter("custkey % 20 = 0").select(F.regexp_replace("path", r"\.py$", "").alias("key")))
    return releases.not_run(t.g_files.select(F.col("path").alias("key")), ran)


@query("w13_newest_report", "SELECT user_id AS suite, arg_max(event_id, (ts, event_id)) AS number FROM events GROUP BY user_id")
def newest(t: Tables) -> DataFrame:
    return releases.newest_report(t.events.select(F.col("user_id").alias("suite"), F.col("event_id").alias("number"), F.col("ts").alias("mtime")))
