"""Readers and writers of the engine's file formats, each a DataFrame over Spark's own sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.canonical import key_problem
from ..operators.line_state import hunks

REGISTER = "doc_id string, path string, content_hash string, revision int"
JOURNAL = "run string, node string, seq long, input_hash string, outcome string, seconds double"


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """Four tab-separated fields; anything else fails loudly."""
    return spark.read.csv(path, sep="\t", schema=REGISTER, mode="FAILFAST", quote="", enforceSchema=True)


def write_register(register: DataFrame, path: str) -> None:
    """Sorted by doc_id, over as many files as the sort has ranges."""
    register.select("doc_id", "path", "content_hash", "revision").orderBy("doc_id").write.mode("overwrite").csv(path, sep="\t", quote="")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Rows with just the journal's keys; a line with other keys, or none, fails loudly."""
    keys = [c.split()[0] for c in JOURNAL.split(", ")]
    problem = key_problem(F.col("value"), keys)
    line = F.when(problem.isNotNull(), F.raise_error(F.concat(F.lit("journal: "), problem, F.lit(" in "), "value"))).otherwise(F.col("value"))
    return spark.read.text(path).select(F.from_json(line, JOURNAL, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def append_journal(rows: DataFrame, path: str) -> None:
    rows.select("run", "node", "seq", "input_hash", "outcome", "seconds").write.mode("append").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(repo, first, last, branch, at) of tab-separated rows; malformed rows are skipped."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).filter(F.size(parts) == 5).select(*[parts[i].alias(n) for i, n in enumerate(("repo", "first", "last", "branch", "raw"))])
    return rows.withColumn("at", F.try_to_timestamp("raw")).filter("at IS NOT NULL").drop("raw")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages that are separated by NUL characters."""
    return spark.read.text(path, lineSep="\x00").filter(F.trim("value") != "").select(F.col("value").alias("message"))


def read_lcov(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, hits): one input record per source file of the report, so that a report splits over tasks."""
    rows = spark.read.text(path, lineSep="end_of_record").filter(F.contains("value", F.lit("SF:")))
    hits = F.regexp_extract_all("value", F.lit(r"(?m)^DA:([0-9]+,[0-9]+)"), F.lit(1))
    rows = rows.select(F.trim(F.regexp_extract("value", r"(?m)^SF:(.*)$", 1)).alias("path"), F.explode(hits).alias("da"))
    return rows.select("path", F.split("da", ",")[0].cast("int").alias("line"), F.split("da", ",")[1].cast("decimal(20,0)").alias("hits"))


def read_block_profile(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, hits) of `file:from.col,to.col statements count` rows: blocks cover all their lines, of several counts the largest."""
    pattern = r"^(.*):([0-9]+)\.[0-9]+,([0-9]+)\.[0-9]+ [0-9]+ ([0-9]+)$"
    # One match a row; no field behind the path holds a colon, and equal blocks fold before they are written out as lines.
    tail = F.substring_index("value", ":", -1)
    found = spark.read.text(path).filter(F.col("value").rlike(pattern)).select(F.left("value", F.length("value") - F.length(tail) - 1).alias("path"), F.split(tail, "[., ]").alias("p"))
    blocks = found.select("path", F.col("p")[0].cast("int").alias("from"), F.col("p")[2].cast("int").alias("to"), F.col("p")[5].cast("decimal(20,0)").alias("hits")).groupBy("path", "from", "to").agg(F.max("hits").alias("hits"))
    return blocks.select("path", F.explode(F.sequence("from", "to")).alias("line"), "hits").groupBy("path", "line").agg(F.max("hits").alias("hits"))


def read_cobertura(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, hits) of class and line elements."""
    schema = "_filename string, lines struct<line: array<struct<_number: int, _hits: bigint>>>"
    rows = spark.read.format("xml").option("rowTag", "class").schema(schema).load(path)
    rows = rows.select(F.col("_filename").alias("path"), F.explode("lines.line").alias("l"))
    return rows.groupBy("path", F.col("l._number").alias("line")).agg(F.max("l._hits").alias("hits"))


def read_jacoco(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, hits) of package, sourcefile and line elements; a line with covered instructions counts once."""
    schema = "_name string, sourcefile array<struct<_name: string, line: array<struct<_nr: int, _ci: bigint>>>>"
    rows = spark.read.format("xml").option("rowTag", "package").schema(schema).load(path)
    rows = rows.select("_name", F.explode("sourcefile").alias("s")).select(F.concat_ws("/", "_name", "s._name").alias("path"), F.explode("s.line").alias("l"))
    return rows.select("path", F.col("l._nr").alias("line"), F.least("l._ci", F.lit(1)).alias("hits"))


def read_test_results(spark: SparkSession, path: str) -> DataFrame:
    """(suite, case, failed) of JUnit reports."""
    schema = "_name string, testcase array<struct<_name: string, failure: array<string>, error: array<string>>>"
    rows = spark.read.format("xml").option("rowTag", "testsuite").schema(schema).load(path)
    return rows.select(F.col("_name").alias("suite"), F.explode("testcase").alias("c")).select("suite", F.col("c._name").alias("case"), (F.col("c.failure").isNotNull() | F.col("c.error").isNotNull()).alias("failed"))


def sniff(content: DataFrame) -> DataFrame:
    """(path, format) of files(path, head) by their first characters; null if unknown."""
    h = F.ltrim("head")
    return content.select("path", F.when(h.startswith("mode:"), "blocks").when(h.rlike("^(TN:|SF:)"), "lcov").when(h.contains("<coverage"), "cobertura").when(h.contains("<report"), "jacoco").alias("format"))


def read_diff(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_from, line_to, added) of unified diffs, a hunk per row; a file of the listing is one diff of a file."""
    rows = spark.read.text(path, wholetext=True)
    name = F.regexp_extract("value", r"(?m)^\+\+\+ (?:b/)?(.*)$", 1)
    heads = F.regexp_extract_all("value", F.lit(r"(?m)^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+(?:,[0-9]+)?) @@"), F.lit(1))
    parts = F.split("value", r"(?m)^@@ -[0-9]+(?:,[0-9]+)? \+[0-9]+(?:,[0-9]+)? @@.*$")
    rows = rows.select(name.alias("path"), F.explode(F.arrays_zip(heads.alias("h"), F.slice(parts, F.lit(2), F.size(heads)).alias("body"))).alias("x"))
    start, count = F.split("x.h", ",")[0].cast("int"), F.coalesce(F.get(F.split("x.h", ","), F.lit(1)).cast("int"), F.lit(1))
    return rows.select("path", start.alias("line_from"), F.greatest(start + count - 1, start).alias("line_to"), F.size(F.regexp_extract_all("x.body", F.lit(r"(?m)^\+(.*)$"), F.lit(1))).alias("added"))


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """(diff, path, hunk, line_from, line_to, lines, omitted) of unified diffs, each file of the listing being one of any number of files."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    found = hunks(rows.select("path", (F.col("pos") + 1).cast("long").alias("line_no"), "line"))
    return found.select(F.col("path").alias("diff"), F.col("file").alias("path"), "hunk", "line_from", "line_to", "lines", "omitted")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """(session, blocks, base, seen) of one JSON file a session; files that hold no object with a number of blocks are left out, the session is the file's name."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("seen"))
    state = F.from_json("value", "blocks int, base string")
    return rows.withColumn("s", state).filter("s.blocks IS NOT NULL").select(F.regexp_replace("file", r"\.json$", "").alias("session"), "s.blocks", "s.base", "seen")


REPORT = "suite string, at string, results array<struct<name: string, ms: double, runs: int>>"


def read_timings(spark: SparkSession, path: str) -> DataFrame:
    """(suite, at, name, ms, runs) of timing reports, a JSON document a file."""
    rows = spark.read.schema(REPORT).json(path, multiLine=True, mode="FAILFAST")
    return rows.select("suite", "at", F.explode("results").alias("r")).select("suite", "at", "r.name", "r.ms", "r.runs")


def write_timings(rows: DataFrame, path: str) -> None:
    """The same form, a line a report."""
    rows.groupBy("suite", "at").agg(F.array_sort(F.collect_list(F.struct("name", "ms", "runs"))).alias("results")).write.mode("overwrite").json(path)


def read_refs(spark: SparkSession, path: str) -> DataFrame:
    """(ref, sha) of a snapshot, one JSON object of names and digests."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, string>")).alias("ref", "sha"))


def catalog_rows(pages: DataFrame) -> DataFrame:
    """(dir, place, line) of the catalogs of pages(path, title, description): sorted entries a directory, and the directories below."""
    folder, base = F.regexp_replace("path", "/?[^/]*$", ""), F.substring_index("path", "/", -1)
    text = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" - "), "description")).otherwise("")
    entries = pages.filter(~base.isin("index.md", "log.md")).select(folder.alias("dir"), F.lit(0).alias("kind"), base.alias("name"), F.concat(F.lit("* ["), F.coalesce("title", base), F.lit("]("), F.replace(base, F.lit(" "), F.lit("%20")), F.lit(")"), text).alias("line"))
    above = entries.select("dir").distinct().filter("dir <> ''").withColumn("up", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("dir", "/"))), lambda i: F.array_join(F.slice(F.split("dir", "/"), F.lit(1), i), "/")))).select("up").distinct()
    child = F.substring_index("up", "/", -1)
    folders = above.select(F.regexp_replace("up", "/?[^/]*$", "").alias("dir"), F.lit(1).alias("kind"), child.alias("name"), F.concat(F.lit("* ["), child, F.lit("]("), F.replace(child, F.lit(" "), F.lit("%20")), F.lit("/)")).alias("line"))
    order = Window.partitionBy("dir").orderBy("kind", "name", "line")
    return entries.unionByName(folders).select("dir", F.row_number().over(order).alias("place"), "line")


def write_catalogs(pages: DataFrame, path: str) -> None:
    """One text file a directory, below dir=<directory>; a directory's entries are one sorted partition's rows."""
    rows = catalog_rows(pages)
    rows.repartition("dir").sortWithinPartitions("dir", "place").select("dir", F.col("line").alias("value")).write.mode("overwrite").partitionBy("dir").text(path)
