"""Queries of the document-base operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_path, matches
from ..operators import documents
from .registry import Tables, query


HREF = "x AS MATERIALIZED (SELECT page_id AS page, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages)"


@query("f1_links", f"WITH {HREF} SELECT page, link, count(*) AS n FROM x GROUP BY ALL")
def links(t: Tables) -> DataFrame:
    return documents.links_of(t.pages, "page_id", "html").groupBy("page", "link").agg(F.count("*").alias("n"))


#: Pages stand at the root under the first word of their title; every third has the suffix .md.
TARGETS = "t AS MATERIALIZED (SELECT DISTINCT lower(regexp_extract(html, '<title>([A-Za-z]+)', 1)) || CASE WHEN page_id % 3 = 0 THEN '.md' ELSE '' END AS target FROM pages WHERE regexp_extract(html, '<title>([A-Za-z]+)', 1) <> '')"
RESOLVED = f"""{HREF}, {TARGETS}, l AS MATERIALIZED (SELECT page, link, split_part(link, '#', 1) AS bare FROM x),
c AS MATERIALIZED (SELECT *, array_to_string(list_filter(string_split(CASE WHEN starts_with(bare, '/') THEN lower(bare) ELSE 'site/' || lower(bare) END, '/'), lambda p: p <> '' AND p <> '.'), '/') AS clean FROM l),
r AS MATERIALIZED (SELECT page, link, coalesce(a.target, b.target) AS tgt, CASE WHEN regexp_matches(link, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN 'external' WHEN bare = '' THEN 'anchor' WHEN coalesce(a.target, b.target) IS NULL THEN 'unknown_target' END AS reason FROM c LEFT JOIN t a ON a.target = clean LEFT JOIN t b ON b.target = clean || '.md')"""


def resolved(t: Tables) -> DataFrame:
    word = F.lower(F.regexp_extract("html", "<title>([A-Za-z]+)", 1))
    targets = t.pages.filter(word != "").select(F.concat(word, F.when(F.col("page_id") % 3 == 0, ".md").otherwise("")).alias("target"))
    rows = documents.links_of(t.pages, "page_id", "html").select("page", F.lower("link").alias("link"), F.lit("site").alias("dir"))
    return documents.resolve_links(rows, targets)


@query("j39_link_targets", f"WITH {RESOLVED} SELECT page, lower(link) AS link, CASE WHEN reason IS NULL THEN tgt END AS target, reason FROM r")
def link_targets(t: Tables) -> DataFrame:
    return resolved(t)


@query("a9_link_stats", f"WITH {RESOLVED} SELECT 'total' AS what, count(*) AS n FROM r HAVING count(*) > 0 UNION ALL SELECT coalesce('dropped:' || reason, 'resolved'), count(*) FROM r GROUP BY 1")
def link_stats(t: Tables) -> DataFrame:
    return documents.link_stats(resolved(t))


@query("a31_broken_share", f"WITH {RESOLVED} SELECT page, count(*) AS total, count(CASE WHEN reason IS NULL THEN tgt END) AS resolved FROM r GROUP BY page HAVING count(CASE WHEN reason IS NULL THEN tgt END) * 2 < count(*)")
def broken(t: Tables) -> DataFrame:
    return documents.broken_share(resolved(t))


@query("c3_dead_links", "SELECT source, target FROM t_links WHERE target NOT IN (SELECT doc_id FROM documents)")
def dead(t: Tables) -> DataFrame:
    return t.t_links.join(t.documents.select(F.col("doc_id").alias("target")), "target", "left_anti").select("source", "target")


@query("a10_census", "SELECT source AS type, lang AS scope, count(*) AS n, source IN ('src1', 'src2', 'src3') AS known FROM documents GROUP BY ALL")
def census(t: Tables) -> DataFrame:
    known = t.spark.createDataFrame([("src1",), ("src2",), ("src3",)], "type string")
    return documents.census(t.documents.select(F.col("source").alias("type"), F.col("lang").alias("scope")), known)


@query("j21_dependents", "SELECT DISTINCT source AS page FROM t_links WHERE target IN (SELECT a.doc_id FROM snap_a a JOIN snap_b b USING (doc_id) WHERE a.content_hash <> b.content_hash)")
def dependents(t: Tables) -> DataFrame:
    changed = t.snap_a.select("doc_id", F.col("content_hash").alias("h")).join(t.snap_b.select("doc_id", "content_hash"), "doc_id").filter("h <> content_hash").select("doc_id")
    return documents.dependents(t.t_links.select(F.col("source").alias("page"), F.col("target").alias("doc_id")), changed)


@query(
    "j22_case_landing",
    """WITH d AS (SELECT source AS target, list_sort(list(target)) AS s FROM t_links GROUP BY source), o AS (SELECT source AS target, list_sort(list(CASE WHEN source % 4 = 1 THEN target + 1 ELSE target END)) AS s FROM t_links WHERE source % 5 <> 0 GROUP BY source)
SELECT target, CASE WHEN o.s IS NULL THEN 'new' WHEN o.s = d.s THEN 'keep' ELSE 'supersede' END AS decision FROM d LEFT JOIN o USING (target)""",
)
def cases(t: Tables) -> DataFrame:
    per = lambda rows, c: rows.groupBy(F.col("source").alias("target")).agg(F.collect_list(c).alias("sources"))
    old = t.t_links.filter("source % 5 <> 0").withColumn("x", F.when(F.col("source") % 4 == 1, F.col("target") + 1).otherwise(F.col("target")))
    return documents.land_cases(per(t.t_links.withColumn("x", F.col("target")), "x"), per(old, "x"))


@query(
    "j25_evidence",
    "SELECT item_id AS claim, CASE WHEN d.text IS NULL THEN 'no such segment' WHEN trim(b.text) = '' THEN 'empty quote' WHEN NOT contains(d.text, b.text) THEN 'quote not found' END AS complaint FROM benchmark b LEFT JOIN q_hits USING (item_id) LEFT JOIN documents d ON d.doc_id = coalesce(expected, item_id * 61)",
)
def evidence(t: Tables) -> DataFrame:
    hits = documents.containing(t.benchmark.select("item_id", F.col("text").alias("quote")), t.documents.select("doc_id", "text")).groupBy("item_id").agg(F.min("doc_id").alias("expected"))
    claims = t.benchmark.join(hits, "item_id", "left").select(F.col("item_id").alias("claim"), F.coalesce("expected", F.col("item_id") * 61).alias("segment"), F.col("text").alias("quote"))
    return documents.check_evidence(claims, t.documents.select(F.col("doc_id").alias("segment"), "text"))


#: The day on which the pages are checked, and the types that they may have.
TODAY, TYPES = "2024-02-01", ["guide", "reference", "decision", "log"]
#: Pages for the rules, made of documents.
PAGE = """pg AS MATERIALIZED (SELECT path, doc_id, CASE WHEN doc_id % 13 = 0 THEN '' ELSE 't' END AS title, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'd' END AS description,
CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 11 = 1 THEN 'note' ELSE 'guide' END AS type, doc_id % 6 AS nsrc, CASE WHEN doc_id % 4 = 0 THEN 'x' END AS generated_by, CASE WHEN doc_id % 9 = 0 THEN 'y' END AS verified,
doc_id % 60 AS age, CASE WHEN doc_id % 5 = 0 THEN 'implemented' ELSE 'planned' END AS state, CASE WHEN doc_id % 3 = 0 THEN 'c' END AS commit, doc_id % 2 AS conflicts, (length(text) - length(replace(text, '|', ''))) % 2 AS conflicts_found FROM t_docs)"""

SWEEP = f"""WITH {PAGE}, f AS MATERIALIZED (
SELECT path, 'type-missing' AS rule, 'error' AS severity, '' AS message FROM pg WHERE type IS NULL UNION ALL SELECT path, 'unknown-type', 'error', '' FROM pg WHERE type = 'note'
UNION ALL SELECT path, 'title-missing', 'warning', '' FROM pg WHERE title = '' UNION ALL SELECT path, 'description-missing', 'warning', '' FROM pg WHERE description IS NULL
UNION ALL SELECT path, 'no-sources', 'error', '' FROM pg WHERE nsrc = 0
UNION ALL SELECT path, 'source-incomplete', 'warning', CAST(i AS VARCHAR) || ': ' || CASE WHEN i % 2 = 0 THEN 'doc_id' ELSE 'content_hash' END FROM (SELECT path, nsrc, doc_id, unnest(range(0, nsrc)) AS i FROM pg) WHERE (doc_id + i) % 4 = 0
UNION ALL SELECT path, 'no-trust-family', 'note', '' FROM pg WHERE generated_by IS NULL AND verified IS NULL
UNION ALL SELECT path, 'stale', 'warning', '' FROM pg WHERE age > 31 UNION ALL SELECT path, 'untouched', 'note', '' FROM pg WHERE age > 20
UNION ALL SELECT path, 'implemented-without-commit', 'error', '' FROM pg WHERE state = 'implemented' AND commit IS NULL UNION ALL SELECT path, 'conflict-count', 'error', '' FROM pg WHERE conflicts <> conflicts_found
UNION ALL SELECT path, 'dead-link', 'error', '' FROM t_links JOIN t_docs ON doc_id = t_links.source WHERE target NOT IN (SELECT doc_id FROM documents) AND target % 3 <> 0
UNION ALL SELECT path, 'outside-area', 'warning', '' FROM t_links JOIN t_docs ON doc_id = t_links.source WHERE target % 3 = 0)"""


def page_rows(t: Tables) -> tuple[DataFrame, DataFrame]:
    d = F.col("doc_id")
    source = lambda i: F.struct(F.when(~(((d + i) % 4 == 0) & (i % 2 == 0)), d).alias("doc_id"), F.when(~(((d + i) % 4 == 0) & (i % 2 == 1)), F.lit("h")).alias("content_hash"))
    pages = t.t_docs.select(
        "path",
        F.when(d % 13 == 0, "").otherwise("t").alias("title"),
        F.when(d % 7 != 0, "d").alias("description"),
        F.when(d % 11 == 1, "note").when(d % 11 > 1, "guide").alias("type"),
        F.when(d % 6 == 0, F.array().cast("array<struct<doc_id:bigint,content_hash:string>>")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), d % 6 - 1), source)).alias("sources"),
        F.when(d % 4 == 0, "x").alias("generated_by"),
        F.when(d % 9 == 0, "y").alias("verified"),
        F.date_sub(F.lit("2024-03-03").cast("date"), (d % 60).cast("int")).alias("stale_after"),
        F.date_sub(F.lit("2024-02-01").cast("date"), (d % 60).cast("int")).alias("updated"),
        F.when(d % 5 == 0, "implemented").otherwise("planned").alias("state"),
        F.when(d % 3 == 0, "c").alias("commit"),
        (d % 2).alias("conflicts"),
        (F.length("text") - F.length(F.replace("text", F.lit("|"), F.lit("")))).alias("bars"),
    ).withColumn("conflicts_found", F.col("bars") % 2)
    links = t.t_links.join(t.t_docs.select(F.col("doc_id").alias("source"), "path"), "source").join(t.documents.select(F.col("doc_id").alias("target"), F.lit(True).alias("hit")), "target", "left")
    return pages, links.select("path", F.coalesce("hit", F.lit(False)).alias("target_found"), (F.col("target") % 3 == 0).alias("leaves_area"))


@query("c10_sweep", f"{SWEEP} SELECT path, rule, severity, message FROM f")
def sweep(t: Tables) -> DataFrame:
    return documents.sweep(*page_rows(t), TODAY, TYPES)


@query("a30_exit_status", f"{SWEEP} SELECT max(CASE WHEN severity = 'error' THEN 1 ELSE 0 END) AS status, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'note') AS notes FROM f")
def status(t: Tables) -> DataFrame:
    return documents.exit_status(documents.sweep(*page_rows(t), TODAY, TYPES))


@query("w18_finding_order", f"{SWEEP} SELECT DISTINCT path, rule, severity, message FROM f WHERE severity <> 'note'")
def ordered(t: Tables) -> DataFrame:
    return documents.sweep(*page_rows(t), TODAY, TYPES).filter("severity <> 'note'").dropDuplicates().orderBy("path", "rule", "severity", "message")


@query("p2_globs", "SELECT doc_id, path FROM t_docs WHERE regexp_full_match(path, 'src[0-9]/(en|de)/[^/]*[.]md') AND NOT regexp_full_match(path, '(.*/)?[^/]*7[.]md')")
def globs(t: Tables) -> DataFrame:
    return t.t_docs.filter(matches(F.col("path"), ["src?/en/*.md", "src?/de/*.md"], ["*7.md"])).select("doc_id", "path")


@query("f3_paths", "SELECT doc_id, lang || '/' || CAST(doc_id AS VARCHAR) || '.md' AS clean FROM t_docs")
def paths(t: Tables) -> DataFrame:
    return t.t_docs.select("doc_id", clean_path(F.concat(F.lit("./"), "source", F.lit("//../"), F.regexp_replace("path", "^[^/]*/", ""))).alias("clean"))


@query("g12_catalog_gap", "SELECT path FROM t_docs WHERE doc_id NOT IN (SELECT target FROM t_links)")
def gap(t: Tables) -> DataFrame:
    listed = t.t_links.select(F.col("target").alias("doc_id")).distinct()
    return t.t_docs.join(listed, "doc_id", "left_anti").select("path")
