"""Changes between two versions of a knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot(rows: DataFrame, until: str) -> DataFrame:
    """(key, mark): each key's last content by a time; rows are (key, ts, mark)."""
    return rows.where(F.col("ts") < F.lit(until).cast("timestamp")).groupBy("key").agg(F.max(F.struct("ts", "mark")).alias("m")).select("key", F.col("m.mark").alias("mark"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, change): added, removed or modified keys of two snapshots (key, mark)."""
    both = before.withColumnRenamed("mark", "old").join(after.withColumnRenamed("mark", "new"), "key", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return both.select("key", change.alias("change")).where("change is not null")


def multiset_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that went and rows that came, with multiplicity."""
    return before.exceptAll(after).withColumn("change", F.lit("removed")).unionByName(after.exceptAll(before).withColumn("change", F.lit("added")))


def touched_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose diagnostics differ."""
    return multiset_delta(before, after).select("path").distinct()


def blast_radius(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, added, removed): what a change would do to each file's diagnostics."""
    delta = multiset_delta(before, after)
    return delta.groupBy("path").agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"))


def expand_removed(directories: DataFrame, files: DataFrame) -> DataFrame:
    """Files below removed directories (dir): each file asks for its own prefixes."""
    steps = F.split("path", "/")
    prefix = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    return files.where(F.col("path").contains("/")).select("path", F.explode(prefix).alias("dir")).join(directories, "dir", "left_semi").select("path").distinct()


def reusable(parsed: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of files (path, hash): those whose stored parse still holds, and those to parse again."""
    keys = parsed.select("path", "hash")
    return now.join(keys, ["path", "hash"], "left_semi"), now.join(keys, ["path", "hash"], "left_anti")


def classify_dirty(dirty: DataFrame) -> DataFrame:
    """(path, how): type definitions and repo manifests ask for a full pass, everything else for an incremental one."""
    return dirty.select("path", F.when(F.col("path").rlike(r"(\.type\.ya?ml|(^|/)repo\.yaml)$"), "full").otherwise("incremental").alias("how"))
