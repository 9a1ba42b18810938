"""Snapshot comparison: drift, renames, register carry-forward, shared content, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoint import join_hot


def content_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, state): added, removed or changed; equal rows are left out."""
    both = old.select("path", F.col("content_hash").alias("was")).join(new.select("path", F.col("content_hash").alias("now")), "path", "full_outer")
    return both.filter("NOT was <=> now").select("path", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("state"))


def stat_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """The same, but hashes are compared only where size or mtime differs or is unknown, as mtime is in snapshots without it."""
    part = lambda f, i: f.select("path", F.struct("size", F.col("mtime") if "mtime" in f.columns else F.lit(None).cast("long").alias("mtime")).alias(f"s{i}"), F.col("content_hash").alias(f"h{i}"))
    both = part(old, 0).join(part(new, 1), "path", "full_outer")
    same = "coalesce(s0.size = s1.size AND s0.mtime = s1.mtime, false)"
    return both.filter(f"NOT {same}").filter("NOT h0 <=> h1").select("path", F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").otherwise("changed").alias("state"))


def renames(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_path, new_path): vanished and arrived with one hash, unique on both sides."""
    gone = old.join(new.select("path"), "path", "left_anti").groupBy("content_hash").agg(F.count("*").alias("n"), F.min("path").alias("old_path")).filter("n = 1")
    come = new.join(old.select("path"), "path", "left_anti").groupBy("content_hash").agg(F.count("*").alias("n"), F.min("path").alias("new_path")).filter("n = 1")
    return gone.join(come.drop("n"), "content_hash").select("old_path", "new_path")


def carry_forward(register: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, path, content_hash, revision) of the next register.

    register(doc_id, path, content_hash, revision), files(path, content_hash). Unchanged rows stay, changed
    ones count up, renamed ones keep id and revision, new ones get an id made of path and hash, revision 1.
    """
    moved = renames(register.select("path", "content_hash"), files.select("path", "content_hash"))
    was = register.select("doc_id", F.col("path").alias("old_path"), F.col("content_hash").alias("was"), "revision").join(moved, "old_path", "left").withColumn("path", F.coalesce("new_path", "old_path"))
    both = files.join(was.select("path", "doc_id", "was", "revision"), "path", "left")
    return both.select(
        F.coalesce("doc_id", F.substring(F.sha2(F.concat_ws("|", "path", "content_hash"), 256), 1, 16)).alias("doc_id"), "path", "content_hash", F.when(F.col("doc_id").isNull(), 1).when(F.col("was") == F.col("content_hash"), F.col("revision")).otherwise(F.col("revision") + 1).alias("revision")
    )


def pin_drift(pins: DataFrame, register: DataFrame, files: DataFrame) -> DataFrame:
    """(page, path, finding) for pins(page, path, doc_id, content_hash): the first of row-missing, source-missing, doc-id, pin-stale that applies."""
    rows = pins.join(register.select("path", F.col("doc_id").alias("reg_id"), F.col("content_hash").alias("reg_hash")), "path", "left").join(files.select("path", F.col("content_hash").alias("file_hash")), "path", "left")
    what = F.when(F.col("reg_id").isNull(), "row-missing").when(F.col("file_hash").isNull(), "source-missing").when(F.col("reg_id") != F.col("doc_id"), "doc-id").when(F.col("reg_hash") != F.col("content_hash"), "pin-stale")
    return rows.select("page", "path", what.alias("finding")).filter("finding IS NOT NULL")


def shared_content(files: DataFrame) -> DataFrame:
    """(content_hash, copies, first_path) of contents that several paths have; `copies_of` lists the paths, a row each."""
    return files.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("path").alias("first_path")).filter("copies > 1")


def copies_of(files: DataFrame) -> DataFrame:
    """(content_hash, first_path, path) of each path whose content others have, too."""
    return join_hot(files.select("content_hash", "path"), shared_content(files), "content_hash").select("content_hash", "first_path", "path")


def digest(files: DataFrame) -> DataFrame:
    """One row: files, digest. Rows are digested by the first four digits of their paths' digests, those by the first two, those together, so that no task sees all rows."""
    key = F.md5("path")
    row = F.concat_ws("\x1f", "path", "content_hash")
    together = lambda c: F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(c))), 256).alias("d")
    fine = files.groupBy(F.left(key, F.lit(4)).alias("k")).agg(F.count("*").alias("n"), together(row))
    coarse = fine.groupBy(F.left("k", F.lit(2)).alias("k")).agg(F.sum("n").alias("n"), together(F.concat("k", "d")))
    return coarse.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), together(F.concat("k", "d")).alias("digest"))


def tombstoned(events: DataFrame, dropped: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first event of each key that was not dropped."""
    return events.join(dropped, keys, "left_anti").groupBy(*keys).agg(F.min(order).alias(order))


def refs_drift(before: DataFrame, after: DataFrame, skip: DataFrame) -> DataFrame:
    """(ref, change) for refs(ref, sha): new, gone or moved, skipped refs left out."""
    both = before.withColumnRenamed("sha", "a").join(after.withColumnRenamed("sha", "b"), "ref", "full_outer").join(skip, "ref", "left_anti")
    return both.filter("NOT a <=> b").select("ref", F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").otherwise("moved").alias("change"))


def overlay(base: DataFrame, moved: DataFrame, delta: DataFrame, key: str, limit: int = 200) -> DataFrame:
    """Rows of an index with those of moved keys replaced; beyond the limit the index must be built anew."""
    if moved.count() > limit:
        raise ValueError("too many moved files for an overlay")
    return base.join(moved, key, "left_anti").unionByName(delta)
