"""Which rows a reader may see or a job should read: corpus scans, source sets, areas and scopes, sections, symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ancestors, clean_path, glob_regex, plain_name, under


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def case_folded(path: Column, globs: list[str]) -> Column:
    """Any glob matches, upper and lower case alike; paths are taken to be in NFC."""
    return F.lower(path).rlike("|".join(f"(?:{glob_regex(g.lower())})" for g in globs)) if globs else F.lit(False)


def readable(path: Column, never: list[str]) -> Column:
    return ~case_folded(path, never)


def within_size(size: Column, most: int) -> Column:
    """At most so large; 0 or less means no limit."""
    return size <= most if most > 0 else F.lit(True)


def is_web_resource(text: Column) -> Column:
    return F.lower(F.trim(text)).rlike("^https?://")


def scan(files: DataFrame, most: int) -> DataFrame:
    """files(path, size, ignored, link) with the reason why a file is left out, null for those kept."""
    reason = F.when(F.col("ignored"), "ignored").when(F.col("link"), "link").when(F.col("path").rlike(r"(^|/)\."), "dotfile").when(~within_size(F.col("size"), most), "oversize")
    return files.withColumn("reason", reason)


def source_set(files: DataFrame, extensions: list[str], pruned: list[str]) -> DataFrame:
    """Files of the given extensions (in either case), neither minified nor below a pruned directory."""
    path = F.lower("path")
    dirs = F.split(path, "/")
    inside = F.arrays_overlap(F.slice(dirs, F.lit(1), F.size(dirs) - 1), F.array(*[F.lit(p) for p in pruned]))
    return files.filter(F.regexp_extract(path, r"\.([^./]+)$", 1).isin(extensions) & ~base_name(path).contains(".min.") & ~inside)


def hidden_areas(areas: DataFrame, channel: str) -> DataFrame:
    """(scope) of areas(scope, local_only) that the channel doesn't show."""
    return areas.filter(F.col("local_only") & (F.lit(channel) == "cloud")).select("scope").distinct()


def conceal(rows: DataFrame, hidden: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path is neither a hidden area nor inside one; an equi-join on the directories above."""
    above = rows.select(path).distinct().select(path, F.explode(F.concat(ancestors(F.col(path)), F.array(path))).alias("scope"))
    return rows.join(above.join(hidden, "scope", "left_semi").select(path).distinct(), path, "left_anti")


def withhold(lines: DataFrame, hidden: DataFrame) -> DataFrame:
    """lines(page, line_no, line) without those that link into a hidden area."""
    links = lines.select("page", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"\]\(([^)]*)\)"), F.lit(1))).alias("link"))
    above = links.select("page", "line_no", clean_path(F.col("link")).alias("to")).select("page", "line_no", F.explode(F.concat(ancestors(F.col("to")), F.array("to"))).alias("scope"))
    return lines.join(above.join(hidden, "scope", "left_semi").select("page", "line_no").distinct(), ["page", "line_no"], "left_anti")


def single_scope(asks: DataFrame, areas: DataFrame) -> DataFrame:
    """asks(ask, ...) with scope: the area of that name, else the only one whose last segment it is; else a problem: unknown or ambiguous."""
    full = areas.select(F.col("scope").alias("ask"), F.col("scope").alias("full")).distinct()
    short = areas.select("scope").distinct().groupBy(F.substring_index("scope", "/", -1).alias("ask")).agg(F.count("*").alias("n"), F.min("scope").alias("short"))
    found = asks.join(full, "ask", "left").join(short, "ask", "left").withColumn("scope", F.coalesce("full", F.when(F.col("n") == 1, F.col("short"))))
    problem = F.when(F.col("scope").isNull(), F.when(F.col("n") > 1, "ambiguous").otherwise("unknown"))
    return found.withColumn("problem", problem).drop("full", "short", "n")


def wrong_direction(cites: DataFrame, areas: DataFrame) -> DataFrame:
    """Of cites(page, cited), paths both, those that lead from a shared area into one that isn't; areas(scope, shared)."""

    def of(side: str) -> DataFrame:
        above = cites.select(side).distinct().select(side, F.explode(ancestors(F.col(side))).alias("scope")).join(areas, "scope")
        return above.groupBy(side).agg(F.max_by("shared", F.length("scope")).alias(f"{side}_shared"))

    return cites.join(of("page"), "page").join(of("cited"), "cited").filter("page_shared AND NOT cited_shared").select("page", "cited")


def detect_stacks(listing: DataFrame, signals: DataFrame) -> DataFrame:
    """(area, stack) of listing(area, path) by signals(stack, sign, companion): a base name or `.extension` is there, and its companion, if one is named."""
    name = F.lower(base_name(F.col("path")))
    signs = listing.select("area", F.explode(F.array(name, F.concat(F.lit("."), F.regexp_extract(name, r"\.([^.]+)$", 1)))).alias("sign")).distinct()
    found = F.broadcast(signals) if signals.count() <= 10_000 else signals
    alone = signs.join(found, "sign")
    partner = signs.withColumnRenamed("sign", "companion")
    return alone.filter("companion IS NULL").select("area", "stack").unionByName(alone.filter("companion IS NOT NULL").join(partner, ["area", "companion"], "left_semi").select("area", "stack")).distinct()


def section(lines: DataFrame, heading: str) -> DataFrame:
    """Of lines(page, line_no, line), those from a page's first such heading to the next of the same or a higher level. A page is one window."""
    marks = F.regexp_extract("line", "^#+", 0)
    rows = lines.withColumns({"level": F.length(marks), "title": F.trim(F.regexp_replace("line", "^#+", ""))})
    page = Window.partitionBy("page")
    rows = rows.withColumn("start", F.min(F.when((F.col("level") > 0) & (F.col("title") == heading), F.struct("line_no", "level"))).over(page))
    rows = rows.withColumn("stop", F.min(F.when((F.col("level") > 0) & (F.col("line_no") > F.col("start.line_no")) & (F.col("level") <= F.col("start.level")), F.col("line_no"))).over(page))
    return rows.filter((F.col("line_no") >= F.col("start.line_no")) & (F.col("stop").isNull() | (F.col("line_no") < F.col("stop")))).select("page", "line_no", "line")


def code_refs(rows: DataFrame, text: str) -> DataFrame:
    """rows with path, line_from, line_to of each `path:line` or `path:line-end` in backticks; paths with spaces are none."""
    pattern = r"`([^`\s:]+):([0-9]+)(?:-([0-9]+))?`"
    refs = rows.withColumn("ref", F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    at = lambda i: F.regexp_extract("ref", pattern, i)
    return refs.select(*rows.columns, at(1).alias("path"), at(2).cast("int").alias("line_from"), F.coalesce(at(3).try_cast("int"), at(2).cast("int")).alias("line_to"))


# Extensions by which a question asks for a file.
FILE_EXTENSIONS = "cs gd godot tres tscn go ts tsx mts cts js jsx mjs cjs py rs c cc cpp cxx c++ h hpp hh hxx h++ inl ipp tpp java php css scss html htm json toml yaml yml md".split()


def _endings(text: Column, marks: str) -> Column:
    """What follows each of these characters."""
    parts = F.split(text, f"[{marks}]")
    inner = F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: i < F.size(parts))
    return F.transform(inner, lambda i: F.substr(text, F.length(F.array_join(F.slice(parts, F.lit(1), i), "x")) + 2))


def resolve_symbols(asks: DataFrame, nodes: DataFrame, subtree: str | None = None) -> DataFrame:
    """(ask, id, stage, score): the nodes of the first stage that answers; within it callers take the least score, then the nodes' own order.

    Stages, all in any case and without ordinals: 0 a symbol's name or id, or what stands behind a `#` or `.` in its id;
    1 `directory.name`, the directory by its last segments; 2, for questions with a slash or a file's extension only,
    files; 3 the name behind the last dot; 4 files by name, path, end of the path or id. A leading `#` or `.` of the
    question goes. Score: 2 for another case than asked, 1 for tests. subtree: only nodes below it; one that holds no
    node is an error.

    Every node states the keys by which it can be asked for, and every question those it asks, so all is one equi-join.
    """
    if subtree:
        nodes = nodes.filter(under(F.col("path"), subtree))
        if nodes.isEmpty():
            raise ValueError(f"nothing below {subtree}")
    low = lambda c: F.lower(plain_name(c))
    key = lambda kind, k: F.struct(F.lit(kind).alias("kind"), k.alias("k"))
    keys_of = lambda kind, many: F.transform(many, lambda k: key(kind, k))
    name, id_ = low(F.col("name")), low(F.col("id"))
    folder = F.lower(F.regexp_replace("path", "/?[^/]*$", ""))
    folders = F.concat(F.array(F.when(folder == "", ".").otherwise(folder)), _endings(folder, "/"))
    symbol = F.concat(F.array(key("symbol", name), key("symbol", id_)), keys_of("symbol", _endings(id_, "#.")), F.transform(folders, lambda d: key("package", F.concat(d, F.lit("\n"), name))))
    path = F.lower("path")
    file = F.concat(F.array(key("name", name), key("file", name), key("file", path), key("file", F.lower("id"))), keys_of("file", _endings(path, "/")))
    keys = nodes.select("id", plain_name(F.col("name")).alias("plain"), "is_test", F.explode(F.array_distinct(F.when(F.col("kind") == "file", file).otherwise(symbol))).alias("k")).select("id", "plain", "is_test", F.col("k.kind").alias("by"), "k.k")
    clean = F.regexp_replace(F.regexp_replace(F.replace(plain_name(F.col("ask")), F.lit("\\"), F.lit("/")), "^#", ""), r"^\.", "")
    rows = asks.select("ask").distinct().filter("ask <> ''").withColumn("clean", clean)
    dotted = F.contains("clean", F.lit("."))
    last = F.substring_index("clean", ".", -1)
    first = F.left("clean", F.length("clean") - F.length(last) - 1)
    file_like = F.contains("ask", F.lit("/")) | F.contains("ask", F.lit("\\")) | F.lower(F.regexp_extract("ask", r"\.([^./]*)$", 1)).isin(*FILE_EXTENSIONS)
    ask_key = lambda stage, by, k: F.struct(F.lit(stage).alias("stage"), F.lit(by).alias("by"), F.lower(k).alias("k"))
    wanted = F.array_compact(F.array(
        ask_key(0, "symbol", F.col("clean")), F.when(dotted, ask_key(1, "package", F.concat(first, F.lit("\n"), last))), F.when(file_like, ask_key(2, "file", F.col("clean"))),
        F.when(dotted & ~file_like, ask_key(3, "name", last)), F.when(dotted & ~file_like, ask_key(3, "symbol", last)), F.when(~file_like, ask_key(4, "file", F.col("clean"))),
    ))
    asked = rows.select("ask", last.alias("said"), F.explode(wanted).alias("w")).select("ask", "said", "w.stage", "w.by", "w.k")
    score = F.when(F.col("stage").isin(2, 4), 0).otherwise(F.when(F.col("plain") != F.col("said"), 2).otherwise(0) + F.col("is_test").cast("int"))
    # Stage 3 takes files by the key of their name, symbols by the one they share with stage 0, there by the name alone.
    hits = asked.join(keys, ["by", "k"]).filter("stage <> 3 OR by <> 'symbol' OR lower(plain) = k").select("ask", "id", "stage", score.alias("score"))
    # The first stage comes with the hits of a question, so neither questions nor nodes are matched twice.
    first = F.min("stage").over(Window.partitionBy("ask"))
    return hits.withColumn("first", first).filter("stage = first").select("ask", "id", "stage", "score").distinct()


def rank_candidates(nodes: DataFrame, name: str) -> DataFrame:
    """(id, score) of nodes so named in any case, best first: 2 for another case, 1 for tests."""
    plain = plain_name(F.col("name"))
    score = F.when(plain != name, 2).otherwise(0) + F.col("is_test").cast("int")
    return nodes.filter(F.lower(plain) == name.lower()).select("id", score.alias("score")).orderBy("score", "id")


def label_search(nodes: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """(id, path) of nodes whose label contains the text in any case; exact labels first, then by path and id."""
    label = F.lower("name")
    return nodes.filter(label.contains(text.lower())).orderBy((label != text.lower()), "path", "id").limit(limit).select("id", "path")


def changed_callers(before: DataFrame, after: DataFrame, edges: DataFrame) -> DataFrame:
    """(changed, caller): callers in other files of symbols(id, path, body_hash) whose body changed or went."""
    now = after.select("id", F.col("body_hash").alias("now"))
    changed = before.join(now, "id", "left").filter(~F.col("body_hash").eqNullSafe(F.col("now"))).select(F.col("id").alias("changed"), F.col("path").alias("changed_path"))
    calls = edges.filter("relation = 'calls'").select(F.col("target").alias("changed"), F.col("source").alias("caller")).distinct()
    where = before.select(F.col("id").alias("caller"), F.col("path").alias("caller_path"))
    return changed.join(calls, "changed").join(where, "caller").filter("caller_path <> changed_path").select("changed", "caller")


def first_use(uses: DataFrame) -> DataFrame:
    """Per (path_from, path_to) the symbol used on the smallest line; on one line calls come last."""
    order = F.struct("line", (F.col("relation") == "calls").alias("calls"), "symbol")
    return uses.groupBy("path_from", "path_to").agg(F.min(order).alias("m")).select("path_from", "path_to", F.col("m.symbol").alias("symbol"), F.col("m.line").alias("line"))


def bounded_directories(dirs: DataFrame, most: int = 16) -> DataFrame:
    """The largest of dirs(dir, files, symbols), with the number left out; in order of their names."""
    top = dirs.orderBy(F.desc("files"), F.desc("symbols"), "dir").limit(most)
    n = dirs.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("dropped"))
    return top.crossJoin(F.broadcast(n)).orderBy("dir")


def assemble_hits(hits: DataFrame, areas: DataFrame, register: DataFrame, most: int) -> DataFrame:
    """The best of hits(collection, path, score) in areas(collection, visible) that are shown, with a finding for those that register(path) lacks and the number of hits dropped."""
    known = hits.join(areas.filter("visible").select("collection").distinct(), "collection", "left_semi")
    dropped = hits.join(areas.filter("visible").select("collection").distinct(), "collection", "left_anti").agg(F.count("*").alias("dropped"))
    top = known.orderBy(F.desc("score"), "path").limit(most)
    there = register.select("path", F.lit(True).alias("there")).distinct()
    return top.join(there, "path", "left").crossJoin(F.broadcast(dropped)).select("collection", "path", "score", F.when(F.col("there").isNull(), "not registered").alias("finding"), "dropped").orderBy(F.desc("score"), "path")


def unfindable(register: DataFrame, index: DataFrame, sample: int = 3) -> DataFrame:
    """One row: how many paths of the register the index lacks, and the first few of them."""
    missing = register.select("path").join(index.select("path"), "path", "left_anti")
    few = missing.orderBy("path").limit(sample).agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("sample"))
    return missing.agg(F.count("*").alias("n")).crossJoin(F.broadcast(few))
