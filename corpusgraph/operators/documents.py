"""Document-base operators: links and their targets, page checks, dependents, cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoint import BLOCK, cut, in_blocks, join_hot
from ..functions.text import clean_path, hrefs

Findings = DataFrame  # path, rule, severity, message


def links_of(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """(page, link) of every href, in any order, repeated ones included."""
    return pages.select(F.col(id_col).alias("page"), F.explode(hrefs(F.col(html))).alias("link"))


def resolve_links(links: DataFrame, targets: DataFrame) -> DataFrame:
    """links(page, dir, link) with target and reason: external, anchor, outside_area, unknown_target or null.

    A link is root-relative with a leading slash, else relative to dir; `name` stands for `name.md` as well.
    """
    bare = F.substring_index("link", "#", 1)
    external = F.col("link").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:")
    joined = F.when(bare.startswith("/"), bare).otherwise(F.concat_ws("/", "dir", bare))
    # Steps up beyond the root leave the area.
    ups = F.aggregate(F.split(joined, "/"), F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda s, p: F.struct((s["at"] + F.when(p == "..", -1).when((p == ".") | (p == ""), 0).otherwise(1)).alias("at"), F.least(s["low"], s["at"] + F.when(p == "..", -1).otherwise(0)).alias("low")))["low"]
    rows = links.withColumns({"external": external, "bare": bare, "clean": clean_path(joined), "low": ups})
    exact = targets.select(F.col("target").alias("clean"), F.col("target").alias("t1")).distinct()
    suffixed = targets.filter(F.col("target").endswith(".md")).select(F.regexp_replace("target", r"\.md$", "").alias("clean"), F.col("target").alias("t2")).distinct()
    found = rows.join(exact, "clean", "left").join(suffixed, "clean", "left")
    reason = F.when(F.col("external"), "external").when(F.col("bare") == "", "anchor").when(F.col("low") < 0, "outside_area").when(F.coalesce("t1", "t2").isNull(), "unknown_target")
    return found.select("page", "link", F.when(reason.isNull(), F.coalesce("t1", "t2")).alias("target"), reason.alias("reason"))


def link_stats(resolved: DataFrame) -> DataFrame:
    """(what, n): total, resolved, and dropped by reason."""
    per = resolved.groupBy("reason").agg(F.count("*").alias("n"))
    return per.select(F.explode(F.array(F.lit("total"), F.coalesce(F.concat(F.lit("dropped:"), "reason"), F.lit("resolved")))).alias("what"), "n").groupBy("what").agg(F.sum("n").alias("n"))


def broken_share(resolved: DataFrame) -> DataFrame:
    """Pages of whose links less than half are resolved."""
    return resolved.groupBy("page").agg(F.count("*").alias("total"), F.count("target").alias("resolved")).filter("resolved * 2 < total")


def census(pages: DataFrame, known: DataFrame) -> DataFrame:
    """(type, scope, n, known) of pages(type, scope) against known(type)."""
    return pages.groupBy("type", "scope").agg(F.count("*").alias("n")).join(F.broadcast(known.withColumn("known", F.lit(True))), "type", "left").select("type", "scope", "n", F.coalesce("known", F.lit(False)).alias("known"))


def dependents(sources: DataFrame, changed: DataFrame) -> DataFrame:
    """(page) of sources(page, doc_id) that cite a changed document."""
    return sources.join(changed, "doc_id", "left_semi").select("page").distinct()


def land_cases(derived: DataFrame, standing: DataFrame) -> DataFrame:
    """(target, decision) of cases(target, sources): keep equal ones, supersede others, new where none stands."""
    both = derived.join(standing.withColumnRenamed("sources", "old"), "target", "left")
    return both.select("target", F.when(F.col("old").isNull(), "new").when(F.array_sort("sources") == F.array_sort("old"), "keep").otherwise("supersede").alias("decision"))


def check_evidence(claims: DataFrame, segments: DataFrame) -> DataFrame:
    """(claim, complaint) for claims(claim, segment, quote): no such segment, empty quote, quote not found, or null."""
    rows = claims.join(segments, "segment", "left")
    return rows.select("claim", F.when(F.col("text").isNull(), "no such segment").when(F.trim("quote") == "", "empty quote").when(~F.contains("text", F.col("quote")), "quote not found").alias("complaint"))


def finding(rows: DataFrame, rule: str, severity: str, message: str = "") -> Findings:
    return rows.select("path", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(message).alias("message"))


def page_rules(today: str, types: list[str], untouched_days: int = 20) -> dict[str, tuple[str, str]]:
    """Severity and condition of each rule on one page(path, title, description, type, sources, generated_by, verified, stale_after, updated, state, commit, conflicts, conflicts_found)."""
    known = ", ".join("'" + t.replace("'", "\\'") + "'" for t in types)
    day = f"DATE'{today}'"
    return {
        "type-missing": ("error", "type IS NULL OR trim(type) = ''"),
        "unknown-type": ("error", f"trim(type) <> '' AND type NOT IN ({known})" if types else "trim(type) <> ''"),
        "title-missing": ("warning", "title IS NULL OR title = ''"),
        "description-missing": ("warning", "description IS NULL OR description = ''"),
        "no-sources": ("error", "sources IS NULL OR size(sources) = 0"),
        "no-trust-family": ("note", "generated_by IS NULL AND verified IS NULL"),
        "stale": ("warning", f"stale_after < {day}"),
        "untouched": ("note", f"datediff({day}, updated) > {untouched_days}"),
        "implemented-without-commit": ("error", "state = 'implemented' AND commit IS NULL"),
        "conflict-count": ("error", "conflicts <> conflicts_found"),
    }


#: Rules over links(path, target_found, leaves_area).
LINK_RULES = {"dead-link": ("error", "NOT leaves_area AND NOT target_found"), "outside-area": ("warning", "leaves_area")}


def _found(rows: DataFrame, rules: dict[str, tuple[str, str]], further: list[Column] = ()) -> Findings:
    """All findings of a table in one scan: an array of what each row breaks, exploded."""
    one = lambda rule, severity: F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit("").alias("message"))
    broken = F.array_compact(F.array(*[F.when(F.expr(condition), one(rule, severity)) for rule, (severity, condition) in rules.items()]))
    return rows.select("path", F.explode(F.concat(broken, *further)).alias("f")).select("path", "f.rule", "f.severity", "f.message")


def sweep(pages: DataFrame, links: DataFrame, today: str, types: list[str]) -> Findings:
    """All findings of all rules over all pages; pages and links are read once each."""

    def incomplete(source: Column, i: Column) -> Column:
        missing = F.concat_ws(",", F.when(source["doc_id"].isNull(), "doc_id"), F.when(source["content_hash"].isNull(), "content_hash"))
        message = F.concat(i.cast("string"), F.lit(": "), missing)
        return F.when(missing != "", F.struct(F.lit("source-incomplete").alias("rule"), F.lit("warning").alias("severity"), message.alias("message")))

    of_sources = F.coalesce(F.array_compact(F.transform("sources", incomplete)), F.array().cast("array<struct<rule:string,severity:string,message:string>>"))
    return _found(pages, page_rules(today, types), [of_sources]).unionByName(_found(links, LINK_RULES))


def exit_status(findings: Findings) -> DataFrame:
    """One row: status 1 if any error, with counts per severity."""
    return findings.agg(F.coalesce(F.max((F.col("severity") == "error").cast("int")), F.lit(0)).alias("status"), *[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning", "note")])


SCAFFOLD = ("index.md", "log.md")


def _base() -> Column:
    return F.substring_index("path", "/", -1)


def _dir() -> Column:
    return F.regexp_replace("path", "/?[^/]*$", "")


def reserved_names(pages: DataFrame) -> Findings:
    """Pages(path, type) named like a catalog or a log that have a type."""
    return finding(pages.filter(_base().isin(*SCAFFOLD) & F.col("type").isNotNull()), "reserved-name-as-concept", "error")


def log_dates(lines: DataFrame) -> Findings:
    """Headings of the second level in log.md, of lines(path, line), that are no ISO days."""
    return finding(lines.filter((_base() == "log.md") & F.col("line").startswith("## ") & ~F.col("line").rlike("^## [0-9]{4}-[0-9]{2}-[0-9]{2}\\s*$")), "log-date-form", "error", "no ISO day")


def without_catalog(pages: DataFrame) -> DataFrame:
    """(dir) of directories with pages and no index.md."""
    per = pages.groupBy(_dir().alias("dir")).agg(F.bool_or(_base() == "index.md").alias("listed"), F.bool_or(~_base().isin(*SCAFFOLD)).alias("pages"))
    return per.filter("pages AND NOT listed").select("dir")


def without_log(pages: DataFrame) -> DataFrame:
    """(scope) of bundles with pages(scope, path) and no log.md at their root."""
    return pages.groupBy("scope").agg(F.bool_or(F.col("path") == F.concat_ws("/", "scope", F.lit("log.md"))).alias("has")).filter("NOT has").select("scope")


def orphans(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(path) of pages to which no link(path, target) leads; logs lend no links, catalogs do."""
    lent = links.filter(_base() != "log.md").select(F.col("target").alias("path")).distinct()
    return pages.filter(~_base().isin(*SCAFFOLD)).select("path").join(lent, "path", "left_anti")


#: Whole words of a quote by which it is looked up.
ANCHOR = 3


def containing(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id) where documents(doc_id, text) hold quotes(item_id, quote) word for word.

    A text that holds a quote has the words inside the quote (its first and last may be parts of words there) between
    blanks, so quotes and texts meet by ANCHOR such words, the quote's first ones; what meets is then held against the
    whole quote. Quotes with fewer words inside are held against all texts, in blocks.
    """
    words = lambda c: F.split(c, "[ \\t\\n\\r\\f\\x0b]+")
    rows = quotes.filter("quote IS NOT NULL").withColumn("w", words(F.col("quote")))
    short = F.size("w") < ANCHOR + 2
    long = cut(rows.filter(~short).select("item_id", "quote", F.array_join(F.slice("w", F.lit(2), F.lit(ANCHOR)), " ").alias("anchor")), "quotes")
    split = docs.select("doc_id", words(F.col("text")).alias("w"))
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - ANCHOR + 1), lambda i: F.array_join(F.slice("w", i, F.lit(ANCHOR)), " "))
    places = split.filter(F.size("w") >= ANCHOR).select("doc_id", F.explode(F.array_distinct(runs)).alias("anchor"))
    asked = long.select("anchor").distinct()
    small = asked.count() <= BLOCK
    met = places.join(F.broadcast(asked) if small else asked, "anchor", "left_semi")
    pairs = join_hot(met, long.groupBy("anchor").agg(F.collect_list(F.struct("item_id", "quote")).alias("q")), "anchor").select("doc_id", F.explode("q").alias("q")).select("doc_id", "q.item_id", "q.quote")
    found = pairs.join(docs.select("doc_id", "text"), "doc_id").filter(F.contains("text", F.col("quote"))).select("item_id", "doc_id").distinct()
    rest = cut(rows.filter(short).select("item_id", "quote"), "quotes")
    if rest.isEmpty():
        return found
    held = in_blocks(rest, "item_id", lambda block: docs.join(F.broadcast(block), F.contains(F.col("text"), F.col("quote"))).select("item_id", "doc_id"))
    return found.unionByName(held)
