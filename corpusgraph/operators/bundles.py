"""Whole bundles of pages: lint over all areas in one job, signposts, reconcile passes; and layers of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoint import cut
from ..functions.text import link_target, rooted
from . import headers, line_state
from .documents import SCAFFOLD, Findings

#: Severities in their order.
SEVERITIES = ["error", "warning", "note"]


def lint(files: DataFrame, version_key: str, text: str = "text") -> Findings:
    """(area, path, rule, severity, message) of files(area, path, text), all areas at once, in a total order.

    Headers, catalogs, dead links, conflict boxes without a declared number, and orphans. Catalogs and logs are judged by
    the rules for them alone, but the links of catalogs count. Areas don't see each other's pages.
    """
    whole = files.withColumn("path", F.concat_ws("\x1f", "area", "path"))
    local = F.substring_index("path", "\x1f", -1)
    pages = cut(headers.read_pages(whole.select("path", F.col(text).alias("text"))), "pages")
    # Within an area a page's place is its path; rules about the root look at that.
    own = _header(pages, version_key)
    scaffold = F.substring_index(local, "/", -1).isin(*SCAFFOLD)
    links = _links(pages.withColumns({"key": F.col("path"), "path": local}))
    known = pages.select(F.col("path").alias("target")).distinct()
    judged = links.filter(~F.substring_index("source", "\x1f", -1).rlike(r"(^|/)(index|log)\.md$"))
    dead = judged.join(known, "target", "left_anti").select(F.col("source").alias("path"), F.lit("dead-link").alias("rule"), F.lit("error").alias("severity"), F.col("link").alias("message"))
    lent = links.filter(~F.substring_index("source", "\x1f", -1).rlike(r"(^|/)log\.md$")).filter("source <> target").select(F.col("target").alias("path")).distinct()
    orphan = pages.filter(~scaffold).select("path").join(lent, "path", "left_anti").select("path", F.lit("orphan").alias("rule"), F.lit("note").alias("severity"), F.lit("").alias("message"))
    lines = pages.filter(~scaffold).select("path", F.posexplode(F.split("body", "\n")).alias("pos", "line")).select("path", (F.col("pos") + 1).cast("long").alias("line_no"), "line")
    declared = pages.filter(~scaffold).select("path", F.lit(None).cast("long").alias("conflicts"))
    boxes = line_state.conflict_findings(lines, declared).select("path", F.lit("conflict-count").alias("rule"), F.lit("error").alias("severity"), F.col("found").cast("string").alias("message"))
    found = own.unionByName(dead).unionByName(orphan).unionByName(boxes)
    rank = F.coalesce(*[F.when(F.col("severity") == s, F.lit(i)) for i, s in enumerate(SEVERITIES)], F.lit(len(SEVERITIES)))
    rows = found.select(F.substring_index("path", "\x1f", 1).alias("area"), local.alias("path"), "rule", "severity", "message").distinct()
    return rows.orderBy("area", "path", rank, "rule", "message")


def _header(pages: DataFrame, version_key: str) -> Findings:
    """Header findings where a root catalog is an area's."""
    key = F.substring_index("path", "\x1f", 1)
    rows = pages.withColumns({"area": key, "path": F.substring_index("path", "\x1f", -1)})
    found = headers.header_findings(rows, version_key, "area")
    return found.select(F.concat_ws("\x1f", "area", "path").alias("path"), "rule", "severity", "message")


def _links(pages: DataFrame) -> DataFrame:
    """(source, target, link) with keys of area and path on both sides; a target outside the area has none and is null."""
    rows = pages.select("key", "path", F.explode("links").alias("link")).filter(~F.col("link").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"))
    bare = link_target(F.col("link"))
    target = F.when(bare.startswith("/"), rooted(F.substr(bare, F.lit(2)))).otherwise(rooted(F.concat(F.regexp_replace("path", "[^/]*$", ""), bare)))
    rows = rows.withColumn("bare", bare).filter("bare <> ''").withColumn("target", target)
    return rows.select(F.col("key").alias("source"), F.concat(F.substring_index("key", "\x1f", 1), F.lit("\x1f"), F.coalesce("target", "bare")).alias("target"), "link")


def unlisted_areas(catalog_links: DataFrame, areas: DataFrame, hub: str) -> DataFrame:
    """(signpost, area) of areas(scope, wiki, signpost) that the catalog of a signpost doesn't link to.

    catalog_links(scope, target): targets as paths from the common root, in any case. Expected is the area's wiki, its
    index.md, or its page in the hub folder. The signpost itself and areas without a wiki are not expected.
    """
    posts = areas.filter("signpost AND wiki IS NOT NULL").select(F.col("scope").alias("post"))
    wiki = F.lower("wiki")
    name = F.lower(F.substring_index("scope", "/", -1))
    ways = F.array(wiki, F.concat(wiki, F.lit("/index.md")), F.concat(F.lit(hub.lower() + "/"), name, F.lit(".md")))
    others = areas.filter("wiki IS NOT NULL").select("scope", F.explode(ways).alias("target"))
    linked = catalog_links.select(F.col("scope").alias("post"), F.lower(F.regexp_replace("target", "/$", "")).alias("target")).distinct()
    # Signposts are few by nature, but each pairs with every area: the pairs are what is asked, one row an area a signpost.
    named = linked.join(posts, "post", "left_semi").join(others, "target").select("post", "scope").distinct()
    expected = posts.join(areas.filter("wiki IS NOT NULL").select("scope"), F.col("post") != F.col("scope"))
    return expected.join(named, ["post", "scope"], "left_anti").select(F.col("post").alias("signpost"), F.col("scope").alias("area"))


def layers(starts: DataFrame, links: DataFrame, kind: str | None = None) -> DataFrame:
    """(start, file, layer) of all files that links(source, target, kind) reach from starts(start), each in its first layer; of one kind of link, if given."""
    steps = links.filter(F.col("kind") == kind) if kind else links
    steps = cut(steps.select(F.col("source").alias("file"), F.col("target").alias("next")).distinct(), "links")
    frontier = cut(starts.select("start", F.col("start").alias("file"), F.lit(0).alias("layer")).distinct(), "layer")
    seen, depth = frontier, 0
    while not frontier.isEmpty():
        depth += 1
        found = frontier.join(steps, "file").select("start", F.col("next").alias("file")).distinct().join(seen.select("start", "file"), ["start", "file"], "left_anti")
        frontier = cut(found.withColumn("layer", F.lit(depth)), "layer")
        seen = seen.unionByName(frontier)
    return seen


def stale_passes(passes: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """(area, at) of areas whose last reconcile pass, passes(area, at) with ISO times with a zone, is that long ago; times that can't be read say nothing."""
    zoned = F.col("at").rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})\s*$")
    last = passes.withColumn("time", F.when(zoned, F.try_to_timestamp(F.trim("at")))).filter("time IS NOT NULL").groupBy("area").agg(F.max("time").alias("time"))
    return last.filter(F.col("time") <= now - F.make_interval(hours=F.lit(hours))).select("area", F.col("time").alias("at"))


def due(roots: DataFrame, runs: DataFrame, now: Column, every_s: int) -> DataFrame:
    """(root) that are due for a resync: never run, or last run(root, at) `every_s` ago or longer."""
    last = runs.groupBy("root").agg(F.max("at").alias("at"))
    return roots.select("root").distinct().join(last, "root", "left").filter(F.col("at").isNull() | (F.col("at") <= now - F.make_interval(secs=F.lit(every_s)))).select("root")


def union_edges(parts: dict[str, DataFrame], raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with the language that resolved them, raw rows that none did): parts are edges(raw_id, ...) by language, raw rows(raw_id, ...)."""
    out = None
    for name, part in parts.items():
        one = part.withColumn("language", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    out = cut(out, "edges")  # read for the edges and for what is left
    return out, raw.join(out.select("raw_id").distinct(), "raw_id", "left_anti")
