"""Scalar functions over text, paths, versions and links, all as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The 32 words that the tokeniser leaves out.
STOP_WORDS = "the a an of to in is are how does do what where which that this it for on and or with i we get set use used using when why can".split()
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: Column) -> Column:
    """Words for search: camel case split, lower case, split at all but [a-z0-9], longer than one letter, no stop words."""
    spaced = F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 1, line) with a trailing carriage return removed."""
    rows = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "raw"))
    return rows.select(key, (F.col("pos") + 1).alias("line_no"), F.regexp_replace("raw", "\r$", "").alias("line"))


def grams(text: Column) -> Column:
    """Distinct trigrams of ASCII characters, A-Z folded; windows with other characters are skipped."""
    # One pass of the regular expression over the text; it looks ahead at every character and takes three.
    return F.array_distinct(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(r"(?=([\x00-\x7F]{3}))"), F.lit(1)))


def clean_path(path: Column) -> Column:
    """`.` and `..` folded away; a path that climbs above its root keeps the rest."""
    parts = F.split(path, "/")
    fold = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda out, p: F.when((p == ".") | (p == ""), out).when(p == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p))),
    )
    return F.array_join(fold, "/")


def rooted(path: Column) -> Column:
    """clean_path, or null for a path that is the root itself or climbs above it on its way."""
    steps = F.split(path, "/")
    rise = lambda p: F.when(p == "..", -1).when((p == ".") | (p == ""), 0).otherwise(1)
    low = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda s, p: F.struct((s["at"] + rise(p)).alias("at"), F.least(s["low"], s["at"] + rise(p)).alias("low")))["low"]
    clean = clean_path(path)
    return F.when((low >= 0) & (clean != ""), clean)


def ancestors(path: Column) -> Column:
    """All directories above a path, the root ('') included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def under(path: Column, prefix: str) -> Column:
    """Inside a subtree; with an empty prefix, everywhere."""
    prefix = prefix.strip("/")
    return F.lit(True) if not prefix else (path == prefix) | path.startswith(prefix + "/")


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def collapse(text: Column, cap: int) -> Column:
    return F.left(F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\f]+", " ")), F.lit(cap))


def content_hash(text: Column) -> Column:
    """Newlines normalised before hashing."""
    return F.concat(F.lit("sha256:"), F.sha2(F.regexp_replace(text, "\r\n", "\n"), 256))


def fold_umlauts(text: Column) -> Column:
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def version(text: Column) -> Column:
    """Numbers of a version, without a leading v and pre-release part, padded to three: arrays compare as versions do."""
    bare = F.regexp_extract(text, r"^v?([0-9]+(?:\.[0-9]+)*)", 1)
    numbers = F.transform(F.split(bare, r"\."), lambda p: p.try_cast("int"))
    return F.when(bare != "", F.slice(F.concat(numbers, F.array(F.lit(0), F.lit(0))), 1, 3))


def plain_name(name: Column) -> Column:
    """A minted name without its ordinals (`~2`)."""
    return F.regexp_replace(name, "~[0-9]+", "")


def case_id(area: Column, target: Column, day: Column) -> Column:
    """The area's last segment, the day and four hexadecimal digits of a digest of area and target."""
    return F.concat_ws("-", F.substring_index(area, "/", -1), F.date_format(day, "yyyy-MM-dd"), F.left(F.sha2(F.concat(area, F.lit("\n"), target), 256), F.lit(4)))


def span(text: Column) -> tuple[Column, Column]:
    """`L12-L40` as two numbers, or two nulls."""
    pattern = r"^L([0-9]+)-L([0-9]+)$"
    return F.regexp_extract(text, pattern, 1).try_cast("int"), F.regexp_extract(text, pattern, 2).try_cast("int")


# Languages by extension; another extension stands for itself.
LANGUAGES = {
    "go": "go", "ts tsx mts cts": "typescript", "js jsx mjs cjs": "javascript", "py": "python", "gd godot tres tscn": "gdscript", "rs": "rust", "cs": "csharp",
    "cpp cc cxx c++ hpp hh hxx h++ h inl ipp tpp": "cpp", "html htm": "html",
}


def language(path: Column) -> Column:
    """The language of a path by its last extension; without one, `unknown`."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    known = F.coalesce(*[F.when(ext.isin(*endings.split()), F.lit(name)) for endings, name in LANGUAGES.items()])
    return F.coalesce(known, F.when(ext != "", ext), F.lit("unknown"))


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression: `**` spans directories, `*` and `?` do not; without a slash it matches any base name."""
    import re

    anchored = "/" in glob.strip("/")
    out, i, g = "", 0, glob.strip("/")
    while i < len(g):
        if g[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif g[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif g[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif g[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(g[i]), i + 1
    return f"^{'' if anchored else '(?:.*/)?'}{out}$"


def matches(path: Column, include: list[str], exclude: list[str] = ()) -> Column:
    """Any of include, none of exclude."""
    any_of = lambda globs: F.lit(False) if not globs else path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))
    return any_of(list(include)) & ~any_of(list(exclude))


def link_target(link: Column) -> Column:
    """A link without anchor and query, its percent escapes undone; a malformed escape stays as it is."""
    bare = F.substring_index(F.substring_index(link, "#", 1), "?", 1)
    return F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)


def sortable_id(seconds: Column, *parts: Column) -> Column:
    """An id that sorts by time and is the same for the same parts: nine digits of the time in base 32, then ten of a digest."""
    letters = "0123456789abcdefghjkmnpqrstvwxyz"
    digit = lambda value, i: F.substring(F.lit(letters), (F.shiftrightunsigned(value, 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
    hashed = F.conv(F.left(F.sha2(F.concat_ws("\x1f", *parts), 256), F.lit(13)), 16, 10).cast("long")
    time = seconds.cast("long")
    return F.concat(*[digit(time, i) for i in range(8, -1, -1)], *[digit(hashed, i) for i in range(9, -1, -1)])


def stale(at: Column, now: Column, hours: int = 24) -> Column:
    """Whether a time, as ISO text with or without a zone, is further back than this; null if it can't be read."""
    return F.try_to_timestamp(at) < now - F.make_interval(hours=F.lit(hours))


def collection_name(scope: Column) -> Column:
    """A scope as a collection's name: lower case, everything but letters and digits as single dashes, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(scope), "[^a-z0-9]+", "-"), "^-|-$", "")


def ranked_type(kind: Column, ranks: dict[str, int], aliases: dict[str, str]) -> tuple[Column, Column]:
    """(name, rank) of a type in any case after its alias; unknown ones keep their name and come last."""
    low = F.lower(F.trim(kind))
    name = F.coalesce(*[F.when(low == a.lower(), F.lit(n)) for a, n in aliases.items()], *[F.when(low == n.lower(), F.lit(n)) for n in ranks], kind)
    return name, F.coalesce(*[F.when(name == n, F.lit(r)) for n, r in ranks.items()], F.lit(len(ranks)))


def rendered_counts(counts: Column) -> Column:
    """A map of numbers as `a: 1, b: 2`, in the order of its keys."""
    entries = F.array_sort(F.map_entries(counts))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"].cast("string"), F.lit(": "), e["value"].cast("string"))), ", ")
