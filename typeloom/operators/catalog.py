"""Reads over files, directories, members and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def files_page(files: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """(path, stem, kind): a page of the catalogue, ordered by path components."""
    page = files.orderBy(F.split("path", "/"), "k").offset(offset).limit(limit)
    return page.select("path", "stem", "kind")


def dir_entries(files: DataFrame, prefix: str) -> DataFrame:
    """(name, is_dir): direct children of a directory."""
    p = prefix.rstrip("/") + "/"
    rest = F.substring("path", len(p) + 1, 1 << 30)
    return files.where(F.col("path").startswith(p)).select(F.split(rest, "/")[0].alias("name"), rest.contains("/").alias("is_dir")).distinct()


def top_level_dirs(files: DataFrame) -> DataFrame:
    return files.groupBy("repo", F.split("path", "/")[1].alias("dir")).agg(F.count("*").alias("n"))


def resolve_member(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, repo): the deepest root (repo, root) that holds the path; null if none.

    Every path asks for each of its own prefixes, so this is an equi-join, not a prefix scan.
    """
    steps = F.split("path", "/")
    prefix = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    own = paths.select("path").distinct()
    hit = own.select("path", F.explode(prefix).alias("root")).join(roots, "root").groupBy("path").agg(F.max_by("repo", F.length("root")).alias("repo"))
    return own.join(hit, "path", "left")


def in_scope(rows: DataFrame, repos: DataFrame, scope: str = "own", repo: str | None = None) -> DataFrame:
    """Rows (with a column repo) of editable repos, or all; a named repo overrides."""
    if repo is not None:
        return rows.where(F.col("repo") == repo)
    return rows if scope == "all" else rows.join(repos.where("editable").select("repo"), "repo", "left_semi")


def overview(files: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo, role, editable, files, types)."""
    n = files.groupBy("repo").agg(F.count("*").alias("files"), F.countDistinct("kind").alias("kinds"))
    return repos.join(n, "repo", "left").select("repo", "role", "editable", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("kinds", F.lit(0)).alias("kinds"))


def name_collisions(files: DataFrame) -> DataFrame:
    """(repo, stem, n): stems that several files of a repo share."""
    return files.groupBy("repo", F.lower("stem").alias("stem")).agg(F.countDistinct("path").alias("n")).where("n > 1")


def conflicts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n): keys with several values, as for one name with two remotes."""
    return rows.groupBy(key).agg(F.countDistinct(value).alias("n")).where("n > 1")


def recent_commits(commits: DataFrame, limit: int) -> DataFrame:
    return commits.orderBy(F.desc("day"), "commit_id").limit(limit)


def commits_since(commits: DataFrame, day: str) -> DataFrame:
    """(commit_id, day, subject) after a day: an append-only read, so a stream of commits takes it as it is."""
    return commits.where(F.col("day") > day).select("commit_id", "day", "subject")


def file_history(commits: DataFrame, changed: DataFrame) -> DataFrame:
    """(path, commit_id, day, status, place): commits of each file, newest first."""
    order = Window.partitionBy("path").orderBy(F.desc("day"), "commit_id", "status")
    return changed.join(commits.select("commit_id", "day"), "commit_id").select("path", "commit_id", "day", "status", F.row_number().over(order).alias("place"))


def commit_meta(commits: DataFrame, asked: list[int]) -> DataFrame:
    """(pos, commit_id, subject, available): positional."""
    want = commits.sparkSession.createDataFrame(list(enumerate(asked)), "pos int, commit_id long")
    return want.join(commits.select("commit_id", "subject"), "commit_id", "left").select("pos", "commit_id", "subject", F.col("subject").isNotNull().alias("available"))


def trailers(commits: DataFrame) -> DataFrame:
    """(commit_id, key, value) of lines ``Key: value``."""
    key = F.regexp_extract("trailer", r"^([A-Za-z][A-Za-z-]*): +(.+)$", 1)
    return commits.select("commit_id", key.alias("key"), F.regexp_extract("trailer", r"^([A-Za-z][A-Za-z-]*): +(.+)$", 2).alias("value")).where("key <> ''")


def deleted_between(commits: DataFrame, changed: DataFrame, since: str, until: str) -> DataFrame:
    """Paths whose last change in the range deleted them."""
    own = changed.join(commits.where(F.col("day").between(since, until)).select("commit_id", "day"), "commit_id")
    last = own.groupBy("path").agg(F.max(F.struct("day", "commit_id", "status")).alias("last"))
    return last.where("last.status = 'D'").select("path")
