"""State that runs along the lines of a file: fences, headers, diffs, exemption markers.

Lines come as (path, line_no, line). A state that the last marker decides is a running `last` over a window of the
file; one in which a marker counts only against what is open is folded over the file's markers (not its lines) first.
A file is one window, so a file is what a task must hold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most changed lines kept of a hunk and of a file of a diff.
HUNK_LINES, FILE_LINES = 24, 200
#: What starts a comment, longer ones before their beginnings; those below are operators in code, too.
COMMENT = ["<!--", "//", "/**", "/*", "#", "--", ";", "'", "%", "*"]
OPERATORS = ["--", ";", "'", "%", "*"]


def running(key: str = "path") -> Window:
    """From the first line of a file to the present one."""
    return Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def carry(lines: DataFrame, header: Column, name: str, key: str = "path") -> DataFrame:
    """lines with the newest header at or above each line; header is null on lines that are none."""
    return lines.withColumn(name, F.last(header, ignorenulls=True).over(running(key)))


def fences(lines: DataFrame, kinds: tuple[str, ...] = ("```", "~~~"), matching: bool = True, key: str = "path") -> DataFrame:
    """lines with `fenced`: inside a fenced block, its fence lines included; one that isn't closed reaches to the end.

    A block is closed by a fence of its own kind or, if not matching, of any kind.
    """
    bare = F.regexp_replace("line", r"^\s+", "")
    kind = F.coalesce(*[F.when(bare.startswith(k), F.lit(k if matching else "fence")) for k in kinds])
    marks = lines.withColumn("kind", kind).filter("kind IS NOT NULL").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", "kind"))).alias("marks"))
    turn = lambda x, opens: F.struct(x["line_no"].alias("line_no"), F.lit(opens).alias("opens"))
    nothing = F.array().cast("array<struct<line_no: long, opens: boolean>>")
    state = lambda kind, turns: F.struct(kind.alias("open"), turns.cast("array<struct<line_no: long, opens: boolean>>").alias("turns"))
    folded = F.aggregate(
        "marks",
        state(F.lit(""), nothing),
        lambda s, x: F.when(s["open"] == "", state(x["kind"], F.concat(s["turns"], F.array(turn(x, True)).cast("array<struct<line_no: long, opens: boolean>>")))).when(s["open"] == x["kind"], state(F.lit(""), F.concat(s["turns"], F.array(turn(x, False)).cast("array<struct<line_no: long, opens: boolean>>")))).otherwise(s),
    )
    turns = marks.select(key, F.explode(folded["turns"]).alias("t")).select(key, F.col("t.line_no").alias("line_no"), F.col("t.opens").alias("opens"))
    rows = lines.join(turns, [key, "line_no"], "left")
    rows = rows.withColumn("inside", F.last("opens", ignorenulls=True).over(running(key)))
    return rows.select(*lines.columns, (F.coalesce("inside", F.lit(False)) | F.coalesce(~F.col("opens"), F.lit(False))).alias("fenced"))


def strip_fences(lines: DataFrame, key: str = "path") -> DataFrame:
    """The lines outside fenced blocks."""
    return fences(lines, key=key).filter("NOT fenced").drop("fenced")


def conflict_findings(lines: DataFrame, declared: DataFrame) -> DataFrame:
    """(path, found, declared, message) of pages whose conflict boxes outside fences differ from declared(path, conflicts), null if nothing is declared.

    Any fence closes a block here.
    """
    boxes = fences(lines, matching=False).filter(~F.col("fenced") & F.col("line").rlike(r"(?i)^[ \t]*>\s*\[!conflict\]")).groupBy("path").agg(F.count("*").alias("found"))
    rows = declared.join(boxes, "path", "left").select("path", F.coalesce("found", F.lit(0)).cast("long").alias("found"), F.col("conflicts").cast("long").alias("declared"))
    message = F.when(F.col("declared").isNull() & (F.col("found") > 0), F.lit("declaration is missing")).when(F.col("declared") != F.col("found"), F.lit("counts differ"))
    return rows.withColumn("message", message).filter("message IS NOT NULL")


def diff_lines(lines: DataFrame) -> DataFrame:
    """Of unified diffs (path: the diff; line_no, line) the lines with file, old_file, hunk and `body`, which a hunk's own counts decide.

    A removed line that reads like a header therefore stays a line.
    """
    line = F.when(F.contains("line", F.lit("\r")), F.regexp_replace("line", "\r$", "")).otherwise(F.col("line"))
    head = r"^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"
    at = lambda i: F.regexp_extract("line", head, i)
    many = lambda i: F.when(at(i) == "", 1).otherwise(at(i).try_cast("int"))
    rows = lines.withColumn("line", line).withColumn("is_head", F.col("line").startswith("@@ -") & F.col("line").rlike(head))
    rows = rows.withColumn("hunk", F.sum(F.col("is_head").cast("int")).over(running()))
    # What a hunk has used up is the file's running count less that at its head, so all windows share one order.
    mark, here = F.left("line", F.lit(1)), running()
    counts = lambda *marks: F.sum(F.when(~F.col("is_head") & mark.isin(*marks), 1).otherwise(0)).over(here)
    rows = rows.withColumns({"old_seen": counts("-", " "), "new_seen": counts("+", " ")})
    rows = rows.withColumn("h", F.when(F.col("is_head"), F.struct(at(3).cast("int").alias("start"), many(2).alias("old"), many(4).alias("new"), "old_seen", "new_seen")))
    rows = rows.withColumn("h", F.last("h", ignorenulls=True).over(here))
    before = lambda side, *marks: F.col(f"{side}_seen") - F.coalesce(mark.isin(*marks), F.lit(False)).cast("int") - F.col(f"h.{side}_seen")
    rows = rows.withColumn("body", ~F.col("is_head") & F.coalesce((before("old", "-", " ") < F.col("h.old")) | (before("new", "+", " ") < F.col("h.new")), F.lit(False)))
    rows = rows.withColumn("h", F.when(F.col("h").isNotNull(), F.struct("h.start", "h.old", "h.new")))
    name = lambda sign: F.when(~F.col("body") & F.col("line").startswith(sign), F.regexp_replace(F.regexp_replace(F.substr("line", F.lit(5)), "\t$", ""), "^[ab]/", ""))
    rows = carry(rows, name("--- "), "old_file")
    # The path of a file that is gone is its old one.
    new = F.when(name("+++ ") == "/dev/null", F.col("old_file")).otherwise(name("+++ "))
    rows = carry(rows, new, "file")
    return rows.select("path", "line_no", "line", "file", F.when(F.col("old_file") != "/dev/null", F.col("old_file")).alias("old_file"), "hunk", "h", "is_head", "body")


def hunks(lines: DataFrame) -> DataFrame:
    """(path, file, hunk, line_from, line_to, lines, omitted) of the diffs: the range in the new file and the changed lines, capped by hunk and by file.

    A hunk that only removes stands for the line before the gap, 1 at the top.
    """
    # A hunk's changed lines come before any other line of it, so they have its head's file, and one fold a hunk gives all.
    rows = diff_lines(lines).withColumn("changed", F.col("body") & F.left("line", F.lit(1)).isin("+", "-"))
    rows = rows.withColumn("seen", F.sum(F.col("changed").cast("int")).over(running()))
    rows = rows.withColumn("at_head", F.last(F.when(F.col("is_head"), F.col("seen")), ignorenulls=True).over(running()))
    head = F.first(F.when(F.col("is_head"), F.struct("file", "h.start", "h.new")), ignorenulls=True)
    few = F.collect_list(F.when(F.col("changed") & (F.col("seen") - F.col("at_head") <= HUNK_LINES), F.struct("line_no", "line")))
    per = rows.filter("is_head OR changed").groupBy("path", "hunk").agg(head.alias("head"), F.transform(F.array_sort(few), lambda x: x["line"]).alias("few"), F.count_if("changed").alias("n")).select("path", "hunk", "head.*", "few", "n")
    ahead = Window.partitionBy("path", "file").orderBy("hunk").rowsBetween(Window.unboundedPreceding, -1)
    room = F.greatest(F.lit(FILE_LINES) - F.coalesce(F.sum(F.size("few")).over(ahead), F.lit(0)), F.lit(0)).cast("int")
    per = per.withColumn("lines", F.slice("few", F.lit(1), room))
    first = F.when(F.col("new") == 0, F.greatest("start", F.lit(1))).otherwise(F.col("start"))
    last = F.when(F.col("new") == 0, F.greatest("start", F.lit(1))).otherwise(F.col("start") + F.col("new") - 1)
    return per.select("path", "file", "hunk", first.alias("line_from"), last.alias("line_to"), "lines", (F.col("n") - F.size("lines")).alias("omitted"))


def name_status(listings: DataFrame, text: str) -> DataFrame:
    """(path, status, file, old_file, problem) of NUL-separated change listings: a status, then one path, or two for renames and copies.

    A listing with an unknown status, a status without its path or an unmerged path gives one row with that problem.
    """
    fields = F.split(F.regexp_replace(text, "\x00$", ""), "\x00")
    entry = "array<struct<status: string, file: string, old_file: string>>"
    # What is pending is the status; two paths are wanted after R and C.
    shape = lambda status, old, found, problem: F.struct(status.cast("string").alias("status"), old.cast("string").alias("old"), found.cast(entry).alias("found"), problem.cast("string").alias("problem"))
    null = F.lit(None)

    def step(s: Column, x: Column) -> Column:
        kind = F.left(x, F.lit(1))
        fresh = F.when(~kind.isin("A", "M", "D", "T", "R", "C", "U") | (x == ""), shape(null, null, s["found"], F.lit("unknown status"))).otherwise(shape(kind, null, s["found"], null))
        done = lambda old: shape(null, null, F.concat(s["found"], F.array(F.struct(s["status"].alias("status"), x.alias("file"), old.cast("string").alias("old_file"))).cast(entry)), null)
        path = F.when(x == "", shape(null, null, s["found"], F.lit("status without a path"))).when(s["status"] == "U", shape(null, null, s["found"], F.lit("unmerged")))
        path = path.when(s["status"].isin("R", "C") & s["old"].isNull(), shape(s["status"], x, s["found"], null)).otherwise(done(s["old"]))
        return F.when(s["problem"].isNotNull(), s).when(s["status"].isNull(), fresh).otherwise(path)

    end = F.aggregate(fields, shape(null, null, F.array(), null), step)
    rows = listings.filter(F.coalesce(text, F.lit("")) != "").select("path", end.alias("s"))
    problem = F.coalesce("s.problem", F.when(F.col("s.status").isNotNull(), "status without a path"))
    good = rows.filter(problem.isNull()).select("path", F.explode("s.found").alias("e")).select("path", "e.status", "e.file", "e.old_file", F.lit(None).cast("string").alias("problem"))
    return good.unionByName(rows.filter(problem.isNotNull()).select("path", *[F.lit(None).cast("string").alias(c) for c in ("status", "file", "old_file")], problem.alias("problem")))


@dataclass(frozen=True)
class Marker:
    """A tool's own marker: for one line, or `file`, or the `start` or `stop` of a block. extensions with the dot."""

    label: str
    regex: str
    extensions: tuple[str, ...]
    block: str = ""
    no_reason: bool = False


def _tokens(tokens: list[str]) -> str:
    return "|".join("".join("\\" + c if c in "*/" else c for c in t) for t in tokens)


def clean_reason(text: Column) -> Column:
    """A reason without comment signs and separators around it."""
    out = F.trim(text)
    for end in ("*/", "-->"):
        out = F.trim(F.substring_index(out, end, 1))
    return F.trim(F.regexp_replace(F.regexp_replace(out, f"^(?:{_tokens(COMMENT)})", ""), "^[:\\-– \t]+", ""))


def comment_only(line: Column) -> Column:
    plain = [t for t in COMMENT if t not in OPERATORS]
    return F.regexp_replace(line, r"^\s+", "").rlike(f"^(?:{_tokens(plain)}|(?:{_tokens(OPERATORS)})(?:[ \t]|$))")


def opens_comment(before: Column, marker: Column) -> Column:
    """Whether a marker begins a comment, or only blanks stand between it and what opens one; operators open one only at the line's start."""
    plain = [t for t in COMMENT if t not in OPERATORS]
    return marker.rlike(f"^(?:{_tokens(COMMENT)})") | before.rlike(f"(?:{_tokens(plain)})[ \t]*$") | before.rlike(f"^\\s*(?:{_tokens(OPERATORS)})[ \t]*$")


OWN = r"^(.*?)coverage:exempt(-file)?([^\w-].*)?$"


def exemptions(lines: DataFrame, natives: list[Marker]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the files say about lines that coverage leaves out: (exempt lines, exempt files, findings).

    exempt lines: (path, line, own, reason); a marker alone in its comment means the line below. The engine's own
    marker rules over a tool's. files: (path, own, reason, native). findings: (path, line, message).
    """
    rows = lines.withColumn("line", F.regexp_replace("line", "\r+$", ""))
    part = lambda i: F.regexp_extract("line", OWN, i)
    own = rows.filter(F.col("line").rlike(OWN) & opens_comment(part(1), F.lit("coverage")))
    own = own.select("path", "line_no", (part(2) != "").alias("whole"), (clean_reason(part(3)) != "").alias("reason"), F.trim(part(1)).isin(*COMMENT).alias("alone"))
    own_lines = own.filter("NOT whole").groupBy("path", (F.col("line_no") + F.col("alone").cast("long")).alias("line")).agg(F.bool_or("reason").alias("reason")).withColumn("own", F.lit(True))
    own_files = own.filter("whole").groupBy("path").agg(F.lit(True).alias("own"), F.bool_or("reason").alias("reason"))
    findings = own.filter("whole AND NOT reason").select("path", F.lit(0).cast("long").alias("line"), F.lit("coverage:exempt-file without a reason").alias("message"))
    order = Window.partitionBy("path").orderBy("line_no")
    any_native = F.lit(False)
    for m in natives:
        any_native = any_native | (_ends_with(m) & F.col("line").rlike(m.regex))
    # Whether the line above is a comment that gives a reason.
    rows = rows.withColumn("explains", comment_only(F.col("line")) & ~F.col("line").rlike(OWN) & (clean_reason(F.col("line")) != "") & ~any_native)
    rows = rows.withColumns({"explained": F.coalesce(F.lag("explains").over(order), F.lit(False)), "last": F.max("line_no").over(Window.partitionBy("path"))})
    spans, whole, hits = None, None, None
    for n, m in enumerate(natives):
        whole_match = rf"^(.*?)({m.regex})(.*)$"
        groups = _groups(m.regex)
        before, match, rest = F.regexp_extract("line", whole_match, 1), F.regexp_extract("line", whole_match, 2), F.regexp_extract("line", whole_match, 3 + groups)
        code = match.endswith("]")
        reason = F.when(code & ~comment_only(rest), "").otherwise(clean_reason(rest))
        found = rows.filter(_ends_with(m) & F.col("line").rlike(m.regex)).filter(code | opens_comment(before, match))
        stands_alone = F.trim(before).isin(*COMMENT) | (code & (F.trim(before) == "") & ((F.trim(rest) == "") | comment_only(rest)))
        found = found.select("path", "line_no", "last", F.lit(n).alias("marker"), F.lit(m.label).alias("label"), F.lit(m.block).alias("block"), (F.lit(m.no_reason) | (reason != "") | F.col("explained")).alias("reasoned"), stands_alone.alias("alone"))
        hits = found if hits is None else hits.unionByName(found)
    exempt = own_lines.select("path", "line", "own", "reason")
    files = own_files
    if hits is not None:
        findings = findings.unionByName(hits.filter("NOT reasoned").select("path", F.col("line_no").alias("line"), F.concat("label", F.lit(" without a reason")).alias("message")))
        single = hits.filter("block = ''").select("path", F.explode(F.array(F.col("line_no"), F.col("line_no") + F.col("alone").cast("long"))).alias("line"))
        # Of a file's starts and stops, a start counts while nothing is open, a stop while something is.
        in_file = Window.partitionBy("path").orderBy("line_no", "marker")
        turns = hits.filter("block IN ('start', 'stop')").withColumn("before", F.coalesce(F.lag("block").over(in_file), F.lit("stop"))).filter("block <> before")
        turns = turns.withColumn("nth", F.count_if(F.col("block") == "start").over(in_file.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        blocks = turns.groupBy("path", "nth").agg(F.min("line_no").alias("at"), F.max(F.when(F.col("block") == "stop", F.col("line_no"))).alias("stop"), F.min_by("label", "line_no").alias("label"), F.max("last").alias("last"))
        findings = findings.unionByName(blocks.filter("stop IS NULL").select("path", F.col("at").alias("line"), F.concat("label", F.lit(" without a stop")).alias("message")))
        spans = blocks.select("path", F.explode(F.sequence("at", F.coalesce("stop", "last"))).alias("line"))
        whole = hits.filter("block = 'file'").select("path").distinct().withColumn("native", F.lit(True))
        native_lines = single.unionByName(spans).distinct().join(exempt.select("path", "line"), ["path", "line"], "left_anti")
        exempt = exempt.unionByName(native_lines.select("path", "line", F.lit(False).alias("own"), F.lit(False).alias("reason")))
        files = own_files.join(whole, "path", "full_outer")
    else:
        files = own_files.withColumn("native", F.lit(False))
    return exempt, files.select("path", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("own", "reason", "native")]), findings


def _ends_with(marker: Marker) -> Column:
    return F.regexp_extract("path", r"(\.[^./]*)$", 1).isin(*marker.extensions)


def _groups(regex: str) -> int:
    import re

    return re.compile(regex).groups
