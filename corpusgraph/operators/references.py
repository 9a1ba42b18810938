"""References of documents to code: spans and links outside fenced blocks, and the files they name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import rooted
from .line_state import strip_fences

#: A back-ticked span, or a Markdown link's target.
TOKEN = r"`([^`\n]+)`|\[[^\]]*\]\(([^)\s]+)\)"
SPAN = r"^([A-Za-z0-9_.\-/]+)(?::([0-9]{1,9})(?:-([0-9]{1,9}))?)?$"
#: Directories without content of the project.
NO_CONTENT = (".git",)


def document_refs(lines: DataFrame, no_content: tuple[str, ...] = NO_CONTENT) -> DataFrame:
    """(page, path, line_from, line_to) of the paths that pages (path, line_no, line) name, in no order and repeated ones included.

    A span is a path from the root with at least one slash and, after a colon, a line or a range; a link is relative to
    the page's directory and may have an anchor. Links with a scheme or a leading slash, and paths that leave the root,
    are none. Fenced blocks show code and name none.
    """
    text = strip_fences(lines.select("path", "line_no", "line")).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    spans = text.select("path", F.explode(F.filter(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(1)), lambda t: t != "")).alias("t"))
    at = lambda i: F.regexp_extract("t", SPAN, i)
    found = spans.filter(F.col("t").rlike(SPAN) & F.contains(at(1), F.lit("/"))).select(F.col("path").alias("page"), rooted(F.regexp_replace(at(1), "/$", "")).alias("path"), at(2).try_cast("int").alias("line_from"), at(3).try_cast("int").alias("line_to"), at(1).startswith("/").alias("absolute"))
    links = text.select("path", F.explode(F.filter(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(2)), lambda t: t != "")).alias("t")).withColumn("t", F.substring_index("t", "#", 1))
    folder = F.regexp_replace("path", "[^/]*$", "")
    linked = links.filter((F.col("t") != "") & ~F.col("t").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") & ~F.col("t").startswith("/")).select(F.col("path").alias("page"), rooted(F.concat(folder, "t")).alias("path"), F.lit(None).cast("int").alias("line_from"), F.lit(None).cast("int").alias("line_to"), F.lit(False).alias("absolute"))
    return found.unionByName(linked).filter(F.col("path").isNotNull() & ~F.col("absolute") & ~F.substring_index("path", "/", 1).isin(*no_content)).drop("absolute")


def code_links(refs: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(page, path, line_from, symbol, missing): each distinct reference with the innermost symbol(id, path, span_from, span_to) at its line; missing if no file or directory is so named.

    files: (path). A reference without a line, or to a line outside all symbols, has no symbol.
    """
    wanted = refs.select("page", "path", "line_from").distinct()
    parts = F.split("path", "/")
    there = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("path")).distinct().withColumn("there", F.lit(True))
    spans = symbols.select("path", F.col("id").alias("symbol"), "span_from", "span_to")
    asked = wanted.filter("line_from IS NOT NULL").select("path", "line_from").distinct()
    # A file's symbols meet only the lines asked of that file.
    inner = asked.join(spans, "path").filter("line_from BETWEEN span_from AND span_to").groupBy("path", "line_from").agg(F.min_by("symbol", F.struct(F.col("span_to") - F.col("span_from"), "symbol")).alias("symbol"))
    return wanted.join(there, "path", "left").join(inner, ["path", "line_from"], "left").select("page", "path", "line_from", "symbol", F.col("there").isNull().alias("missing"))
