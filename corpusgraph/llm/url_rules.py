"""URL filtering as a sort-merge range join, in DataFrame operations only.

A host becomes its labels in reverse, each with a dot after it (www.example.com: com.example.www.), so that a
rule for a host and all its subdomains covers one interval of keys, from its own key to the key with `/` for
its last dot. Intervals of rules are nested or apart. Urls and the rules' starts and ends are sorted together
by range partitioning; a row's place among rules decides which are active there: each start and end carries
the stack of rules active after it, and the sweep hands the last stack on to the urls behind it. Of the
active rules, the longest (host and path) whose path starts the url's path decides.

One host, or one url, may hold a large part of all rows: the sort goes on by path and row id, so that ranges
split it. What a range inherits from the ranges before it is one stack per range.

A url without `://`, or null, has empty host and path and matches nothing. Rules of equal length can't both
fit unless they are equal; of equal rules with different verdicts, block wins. Rules with a null host or path
are left out. Columns other than id and url are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (in lower case) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    no_query = F.regexp_extract(rest, r"(?s)^[^?#]*", 0)
    host = F.regexp_extract(no_query, r"(?s)^[^/]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.substring(no_query, F.length(host) + 1, F.length(no_query))


def host_key(host: F.Column) -> F.Column:
    """The labels in reverse, each with a dot after it; empty for no host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def rule_events(rules: DataFrame) -> DataFrame:
    """(key, kind, stack): where a host with rules starts (0) and ends (2), and the rules active after that.

    The stack grows with the rules on one chain of hosts, not with their whole number.
    """
    r = rules.filter("host IS NOT NULL AND path IS NOT NULL").select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    r = r.select(host_key(F.col("host")).alias("key"), F.struct((F.length("host") + F.length("path")).alias("size"), F.concat("host", "path").alias("rule"), "path", "verdict").alias("r"))
    own = r.groupBy("key").agg(F.array_sort(F.collect_list("r")).alias("own"))
    # The hosts above a host are the prefixes of its key that end in a dot.
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.")
    above = own.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit(".")))).alias("up"))
    chain = above.join(own.select(F.col("key").alias("up"), F.col("own")), "up").groupBy("key").agg(F.flatten(F.collect_list("own")).alias("stack"), F.flatten(F.collect_list(F.when(F.col("up") != F.col("key"), F.col("own")))).alias("outer"))
    starts = chain.select("key", F.lit(0).alias("kind"), "stack")
    ends = chain.select(F.expr("concat(substring(key, 1, length(key) - 1), '/')").alias("key"), F.lit(2).alias("kind"), F.col("outer").alias("stack"))
    return starts.unionByName(ends)


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: the id, host, path, rule (null if none fits) and verdict."""
    spark = urls.sparkSession
    host, path = split_url(F.col(url_col).cast("string"))
    points = urls.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path"))
    points = points.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "id", "host", "path")
    events = rule_events(rules)
    both = points.unionByName(events, allowMissingColumns=True)
    # Within a key: starts, urls, ends. Ranges are fixed once written.
    order = ["key", "kind", "path", "id"]
    ranged = both.repartitionByRange(partitions(spark), *order).withColumn("range", F.spark_partition_id())
    ranged = materialise(ranged, "ranged")
    last = ranged.filter("kind <> 1").groupBy("range").agg(F.max_by("stack", F.struct("key", "kind")).alias("carried"))
    ids = ranged.select("range").distinct().join(last, "range", "left")  # a row per range
    before = F.last("carried", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    carried = ids.select("range", before.alias("carried"))
    here = F.last("stack", ignorenulls=True).over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    swept = ranged.withColumn("here", here).filter("kind = 1").join(F.broadcast(carried), "range")
    active = F.coalesce("here", "carried", F.array().cast(dict(events.dtypes)["stack"]))
    best = F.array_max(F.filter(active, lambda r: F.expr("path").startswith(r["path"]) & (F.col("host") != "")))
    found = swept.withColumn("best", best)
    return found.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
