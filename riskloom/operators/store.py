"""Incremental stores: what changed, upserts, snapshots and resumable work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def diff(new: DataFrame, stored: DataFrame, key: str, marks: list[str]) -> DataFrame:
    """(key, status): new, changed, unchanged or deleted, by one full outer join; `marks` are the columns that must agree."""
    a = new.select(key, F.struct(*marks).alias("a"))
    b = stored.select(key, F.struct(*marks).alias("b"))
    status = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "deleted").when(F.col("a") == F.col("b"), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """stored with incoming rows put in place of rows of the same key."""
    return stored.join(incoming.select(*key), key, "left_anti").unionByName(incoming)


def with_meta(stored: DataFrame, key: str, value: str) -> DataFrame:
    """stored(key, value) with one entry set, such as a schema's version."""
    return upsert(stored, stored.sparkSession.createDataFrame([(key, value)], "key string, value string"), ["key"])


def optional_json(c: Column, is_text: bool = False) -> Column:
    """A column for a text field of a store: text is trimmed, anything else becomes JSON; null if nothing is left."""
    return F.nullif(F.trim(c), F.lit("")) if is_text else F.to_json(c)


def insert_or_ignore(stored: DataFrame, incoming: DataFrame, key: list[str], order: str) -> DataFrame:
    """stored and, of each new key, the first incoming row."""
    fresh = incoming.withColumn("rn__", F.row_number().over(W.partitionBy(*key).orderBy(order))).where("rn__ = 1").drop("rn__")
    return stored.unionByName(fresh.join(stored.select(*key), key, "left_anti"))


def rechunk(files: DataFrame, stored_files: DataFrame, stored_chunks: DataFrame, chunk, path: str = "path") -> DataFrame:
    """Chunks after an incremental pass: those of unchanged files as stored, new ones from
    chunk(DataFrame) for new and changed files, none for deleted files."""
    status = diff(files, stored_files, path, ["hash", "chunk_format"])
    same = stored_chunks.join(status.where("status = 'unchanged'").select(path), path, "left_semi")
    todo = files.join(status.where("status IN ('new', 'changed')").select(path), path, "left_semi")
    return same.unionByName(chunk(todo), allowMissingColumns=True)


def snapshot(files: DataFrame, group: list[str], path: str, digest: str) -> DataFrame:
    """(group, hash, n_files): SHA-256 of the sorted `path:hash` lines. Lines are hashed in
    up to 4096 folders first and their sorted hashes again, so no row holds all paths:
    two snapshots are equal exactly if their sorted lines are."""
    line = F.concat_ws(":", path, digest)
    part = files.select(*group, F.pmod(F.xxhash64(line), F.lit(4096)).alias("part"), line.alias("line"))
    inner = part.groupBy(*group, "part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("h"), F.count("*").alias("n"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), "\n")
    return inner.groupBy(*group).agg(F.sha2(whole, 256).alias("hash"), F.sum("n").alias("n_files"))


def snapshot_text(files: DataFrame, group: list[str], path: str, digest: str) -> DataFrame:
    """(group, hash, n_files) over the plain sorted lines, for groups that fit one row (a repository's files)."""
    lines = F.array_sort(F.collect_list(F.concat_ws(":", path, digest)))
    return files.groupBy(*group).agg(F.sha2(F.concat(F.array_join(lines, "\n"), F.lit("\n")), 256).alias("hash"), F.count("*").alias("n_files"))


def task_key(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def read_log(lines: DataFrame, line: str = "value", order: str = "line_no") -> DataFrame:
    """(kind, key, payload): the last well-formed entry of each kind and key of a log of JSON lines."""
    kind, key = F.get_json_object(line, "$.kind"), F.coalesce(F.get_json_object(line, "$.chunkId"), F.get_json_object(line, "$.taskKey"))
    payload = F.coalesce(F.get_json_object(line, "$.understanding"), F.get_json_object(line, "$.findings"))
    sound = lines.where(F.try_parse_json(line).isNotNull() & kind.isin("map", "rule", "composite") & key.isNotNull())
    return sound.groupBy(kind.alias("kind"), key.alias("key")).agg(F.max_by(payload, order).alias("payload"))


def remaining(tasks: DataFrame, done: DataFrame, key: str = "task_key") -> DataFrame:
    """Tasks not recorded yet; a key counts once."""
    return tasks.join(done.select(key).distinct(), key, "left_anti")


def can_resume(saved: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """(key, resumes): whether scope, hash and count of a saved snapshot still hold."""
    a = saved.select(*key, F.struct("hash", "n_files").alias("a"))
    return current.join(a, key, "left").select(*key, F.coalesce(F.col("a") == F.struct("hash", "n_files"), F.lit(False)).alias("resumes"))


#: Stages in order.
STAGES = ["rule", "composite", "finalize"]


def next_stage(stage: Column, n_open: Column) -> Column:
    """The stage that follows once a stage has no open task; complete after the last."""
    out = F.lit("complete")
    for a, b in zip(STAGES, [*STAGES[1:], "complete"]):
        out = F.when(stage == a, F.when(n_open > 0, a).otherwise(b)).otherwise(out)
    return out
