"""Pages with a header block: their fields, tags, sources and links, and the checks that read them.

A header is a block between two `---` lines at the very start, of lines `key: value`; below a key, deeper lines are a
list (`- item`), a list of maps or a map of one level. That is the form the page writer makes; anything else in the
block makes the page's header `broken`, with the first line that doesn't fit, and then it has no fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_path
from .documents import SCAFFOLD, Findings

BLOCK = r"^---[ \t]*\r?\n(?s:(.*?))(?:\r?\n)?---[ \t]*(?:\r?\n|$)"
#: Lines of a header: blank, comment, `key: value`, an item, or a deeper `key: value`.
FITS = r"^(?:\s*|\s*#.*|[A-Za-z_][\w-]*:(?: .*)?|\s+-(?: .*)?|-(?: .*)?|\s+[A-Za-z_][\w-]*:(?: .*)?)$"
LINK = r"(!)?\[[^\]]*\]\(([^)\s]+)\)"
WIKI = r"(!)?\[\[([^\]|#]+)"
#: A catalog's entry on its line: target, anchor, and what stands behind it.
ENTRY = r"\[[^\]]*\]\(([^)#\s]+)(?:#[^)]*)?\)([^\n]*)"


def unquoted(value: Column) -> Column:
    bare = F.trim(value)
    return F.when(bare.rlike(r"""^(?:"[^"]*"|'[^']*')$"""), F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)


def below(block: Column, key: str) -> Column:
    """The deeper lines, or lines of items, under a key."""
    return F.regexp_extract(block, rf"(?m)^{key}:[ \t]*\r?\n((?:(?:[ \t]+|-).*(?:\r?\n|\z))*)", 1)


def fields(block: Column, pattern: str) -> Column:
    """A map of `key: value` lines that a pattern finds; of a repeated key the last counts."""
    keys, values = F.regexp_extract_all(block, F.lit(pattern), F.lit(1)), F.regexp_extract_all(block, F.lit(pattern), F.lit(2))
    pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), unquoted(v).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def items(block: Column, key: str) -> Column:
    """A key's list, written in brackets or as lines."""
    inline = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*\[(.*)\][ \t]*$", 1)
    lines = F.regexp_extract_all(below(block, key), F.lit(r"(?m)^\s*- ?(.*)$"), F.lit(1))
    found = F.when(inline != "", F.split(inline, ",")).otherwise(lines)
    return F.filter(F.transform(found, unquoted), lambda x: x != "")


def records(block: Column, key: str) -> Column:
    """A key's list of maps."""
    parts = F.filter(F.split(F.regexp_replace(below(block, key), r"(?m)^(\s*)- ", "\x00$1  "), "\x00"), lambda p: F.trim(p) != "")
    return F.transform(parts, lambda p: fields(p, r"(?m)^\s*([A-Za-z_][\w-]*):[ \t]*(.*?)\r?$"))


def read_pages(files: DataFrame, text: str = "text") -> DataFrame:
    """files(path, ...) as pages: path, title, description, type, tags, sources, generated, keys, has_header, broken, body, links.

    Without a title the base name without its extension stands for it. sources is an array of maps, generated a map or null.
    Links are the distinct targets of links and wiki links, without images, in order of their text.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    opened = whole.rlike(r"^---[ \t]*\r?\n")
    block = F.regexp_extract(whole, BLOCK, 1)
    closed = whole.rlike(BLOCK)
    odd = F.filter(F.split(block, "\r?\n"), lambda x: ~x.rlike(FITS))
    broken = F.when(opened & ~closed, "no end").when(closed & (F.size(odd) > 0), F.get(odd, F.lit(0)))
    rows = files.select("path", whole.alias("whole"), (opened & closed).alias("has_header"), broken.alias("broken"), F.when(closed & broken.isNull(), block).otherwise("").alias("block"))
    flat = fields(F.col("block"), r"(?m)^([A-Za-z_][\w-]*):[ \t]*(.*?)\r?$")
    rows = rows.withColumns({"flat": flat, "body": F.when(F.col("has_header"), F.regexp_replace("whole", BLOCK, "")).otherwise(F.col("whole"))})
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"(?<=.)\.[^.]*$", "")
    text_of = lambda k: F.when(F.col("flat")[k] != "", F.col("flat")[k])
    pictures = lambda p: F.regexp_extract_all("whole", F.lit(p), F.lit(1))
    targets = lambda p: F.filter(F.zip_with(pictures(p), F.regexp_extract_all("whole", F.lit(p), F.lit(2)), lambda mark, t: F.when(mark == "", F.trim(t))), lambda t: t.isNotNull() & (t != ""))
    generated = below(F.col("block"), "generated")
    return rows.select(
        "path", F.coalesce(text_of("title"), stem).alias("title"), F.coalesce(text_of("description"), F.lit("")).alias("description"), F.coalesce(text_of("type"), F.lit("")).alias("type"), items(F.col("block"), "tags").alias("tags"),
        records(F.col("block"), "sources").alias("sources"), F.when(F.array_contains(F.map_keys("flat"), "generated"), fields(generated, r"(?m)^\s*([A-Za-z_][\w-]*):[ \t]*(.*?)\r?$")).alias("generated"), F.coalesce(text_of("runtime"), F.lit("")).alias("runtime"),
        F.array_sort(F.map_keys("flat")).alias("keys"), "has_header", "broken", "body", F.array_sort(F.array_distinct(F.concat(targets(LINK), targets(WIKI)))).alias("links"),
    )


def _rule(rule: str, severity: str, message: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), message.alias("message"))


def header_findings(pages: DataFrame, version_key: str, *further: str) -> Findings:
    """(further, path, rule, severity, message) of what headers break, in one scan; version_key: the one key that a root catalog may carry."""
    base = F.substring_index("path", "/", -1)
    none = F.array().cast("array<struct<rule:string,severity:string,message:string>>")
    nested = F.when(F.col("path") != "index.md", F.array(_rule("index-frontmatter-misplaced", "error", F.lit("only the root catalog may have a header"))))
    keys = F.transform(F.filter("keys", lambda k: k != version_key), lambda k: _rule("index-frontmatter-misplaced", "error", F.concat(F.lit("not allowed: "), k)))
    ids = F.filter(F.transform("sources", lambda s, i: F.when(F.trim(F.coalesce(s["id"], F.lit(""))) == "", _rule("source-id-missing", "warning", F.concat(F.lit("sources["), i.cast("string"), F.lit("]"))))), lambda x: x.isNotNull())
    found = F.concat(
        F.when(F.col("broken").isNotNull(), F.array(_rule("frontmatter-unparsable", "error", F.col("broken")))).otherwise(none),
        F.when(F.col("generated").isNotNull() & (F.trim(F.coalesce(F.col("generated")["by"], F.lit(""))) == ""), F.array(_rule("generated-by-missing", "error", F.lit("")))).otherwise(none),
        F.when((F.lower(F.trim("type")) == "attested computation") & (F.trim("runtime") == ""), F.array(_rule("computation-runtime-missing", "error", F.lit("")))).otherwise(none),
        F.when((base == "index.md") & F.col("has_header"), F.coalesce(nested, keys)).otherwise(none),
        F.coalesce(ids, none),
    )
    return pages.select(*further, "path", F.explode(found).alias("f")).select(*further, "path", "f.rule", "f.severity", "f.message")


def entries(pages: DataFrame) -> DataFrame:
    """(path, target, description) of each entry of each catalog: the text behind a link on its line, further links included, without the dash before it."""
    catalogs = pages.filter(F.substring_index("path", "/", -1) == "index.md")
    found = F.arrays_zip(F.regexp_extract_all("body", F.lit(ENTRY), F.lit(1)).alias("target"), F.regexp_extract_all("body", F.lit(ENTRY), F.lit(2)).alias("rest"))
    # A line's first link takes the rest of the line; the links in that rest are entries, too.
    first = catalogs.select("path", F.explode(found).alias("e")).select("path", "e.target", "e.rest")
    again = F.arrays_zip(F.regexp_extract_all("rest", F.lit(r"\[[^\]]*\]\(([^)#\s]+)(?:#[^)]*)?\)"), F.lit(1)).alias("target"), F.transform(F.sequence(F.lit(1), F.regexp_count("rest", F.lit(r"\[[^\]]*\]\([^)#\s]+(?:#[^)]*)?\)"))), lambda i: i).alias("nth"))
    more = first.filter(F.col("rest").rlike(r"\[[^\]]*\]\([^)#\s]+(?:#[^)]*)?\)")).select("path", "rest", F.explode(again).alias("e")).select("path", F.col("e.target").alias("target"), F.regexp_replace(F.col("rest"), F.concat(F.lit(r"^(?:.*?\[[^\]]*\]\([^)#\s]+(?:#[^)]*)?\)){"), F.col("e.nth").cast("string"), F.lit("}")), F.lit("")).alias("rest"))
    both = first.unionByName(more)
    return both.select("path", "target", F.trim(F.regexp_replace(F.trim("rest"), "^[-–—]+", "")).alias("description"))


def undescribed(pages: DataFrame) -> Findings:
    """Catalog entries without a description; directories and scaffold files have none to give."""
    rows = entries(pages).filter("description = ''").filter(~F.col("target").endswith("/") & ~F.substring_index("target", "/", -1).isin(*SCAFFOLD))
    return rows.select("path", F.lit("index-entry-without-description").alias("rule"), F.lit("warning").alias("severity"), F.col("target").alias("message"))


def unlisted(pages: DataFrame) -> Findings:
    """Pages whose directory has a catalog that doesn't list them: a finding of the catalog.

    A target loses its query and percent escapes; with a leading slash it is taken from the root, and never leaves it.
    """
    base, folder = F.substring_index("path", "/", -1), F.regexp_replace("path", "/?[^/]*$", "")
    bare = F.coalesce(F.try_url_decode(F.replace(F.substring_index("target", "?", 1), F.lit("+"), F.lit("%2B"))), F.substring_index("target", "?", 1))
    listed = entries(pages).select("path", F.when(bare.startswith("/"), clean_path(bare)).otherwise(clean_path(F.concat(F.regexp_replace("path", "[^/]*$", ""), bare))).alias("listed"))
    listed = listed.select(F.col("path").alias("catalog"), F.col("listed").alias("path")).distinct()
    catalogs = pages.filter(base == "index.md").select(F.col("path").alias("catalog"), folder.alias("folder")).distinct()
    due = pages.filter(~base.isin(*SCAFFOLD)).select("path", folder.alias("folder")).join(catalogs, "folder").select("path", "catalog")
    left = due.join(listed, ["catalog", "path"], "left_anti")
    return left.select(F.col("catalog").alias("path"), F.lit("catalog-malformed").alias("rule"), F.lit("error").alias("severity"), F.substring_index("path", "/", -1).alias("message"))
