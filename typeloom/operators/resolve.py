"""Addresses beyond a file: blocks, anchors, other repos, moved files; and what depends on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from typeloom.operators.graph import file_keys
from typeloom.plans.shared import written


def resolve_blocks(links: DataFrame, blocks: DataFrame) -> DataFrame:
    """(src, dst, block, pos, outcome) for links (src, dst, block) into files: the first block (path, block_id, pos) with that id, else missing."""
    first = blocks.groupBy(F.col("path").alias("dst"), F.col("block_id").alias("block")).agg(F.min("pos").alias("pos"))
    return links.join(first, ["dst", "block"], "left").select("src", "dst", "block", "pos", F.when(F.col("pos").isNull(), "missing").otherwise("resolved").alias("outcome"))


def resolve_anchors(links: DataFrame, headings: DataFrame) -> DataFrame:
    """(src, dst, anchor, line, outcome): the first heading (path, line, text) with that text, in any case."""
    first = headings.groupBy(F.col("path").alias("dst"), F.lower("text").alias("key")).agg(F.min("line").alias("line"))
    keyed = links.withColumn("key", F.lower("anchor"))
    return keyed.join(first, ["dst", "key"], "left").select("src", "dst", "anchor", "line", F.when(F.col("line").isNull(), "missing").otherwise("resolved").alias("outcome"))


def block_spans(events: DataFrame) -> DataFrame:
    """(path, block_id, pos, start, end): byte spans of the addressable among a file's lines (path, pos, text, block_id)."""
    before = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)  # a file's lines
    sized = events.withColumn("n", F.octet_length("text")).withColumn("start", F.coalesce(F.sum(F.col("n") + 1).over(before), F.lit(0)))
    return sized.where("block_id <> ''").select("path", "block_id", "pos", "start", (F.col("start") + F.col("n")).alias("end"))


def route(links: DataFrame, repos: DataFrame, depends: DataFrame) -> DataFrame:
    """``links`` (with repo and scope) and where they are looked up: self, dependency, undeclared, or unknown.

    ``depends`` has (repo, scope); a repo that is declared but not in ``repos`` is unavailable.
    """
    known = repos.select(F.col("repo").alias("scope"), F.lit(True).alias("__known"))
    declared = depends.select("repo", "scope", F.lit(True).alias("__declared")).distinct()
    seen = links.join(F.broadcast(known), "scope", "left").join(declared, ["repo", "scope"], "left")  # repos: a few thousand rows
    where = (
        F.when(F.col("scope").isNull() | (F.col("scope") == F.col("repo")), "self")
        .when(F.col("__declared") & F.col("__known"), "dependency").when(F.col("__declared"), "unavailable").when(F.col("__known"), "undeclared").otherwise("unknown")
    )
    return seen.withColumn("route", where).drop("__known", "__declared")


def resolve_across(routed: DataFrame, files: DataFrame) -> DataFrame:
    """Routed links with dst and outcome: within the scope's repo, or why not."""
    keys = file_keys(files).join(files.select("path", F.col("repo").alias("scope")), "path").select("key", "rank", "scope", "path")
    asked = routed.where("route in ('self', 'dependency')").select(F.coalesce("scope", "repo").alias("scope"), "target").distinct().withColumn("key", F.lower("target"))
    hits = asked.join(keys.where("rank > 0"), ["scope", "key"]).groupBy("scope", "target", "rank").agg(F.countDistinct("path").alias("n"), F.min("path").alias("path"))
    best = hits.groupBy("scope", "target").agg(F.min(F.struct("rank", "n", "path")).alias("b"))
    out = routed.withColumn("__scope", F.coalesce("scope", "repo")).join(best.withColumnRenamed("scope", "__scope"), ["__scope", "target"], "left")
    found = F.when(~F.col("route").isin("self", "dependency"), F.col("route")).when(F.col("b").isNull(), "missing").when(F.col("b.n") == 1, "resolved").otherwise("ambiguous")
    return out.withColumn("outcome", found).withColumn("dst", F.when(F.col("outcome") == "resolved", F.col("b.path"))).drop("b", "__scope")


def resolve_any(names: DataFrame, files: DataFrame) -> DataFrame:
    """(target, dst): lookup of targets in all repos at once; a name that several files share gives null."""
    keys = file_keys(files).where("rank > 0").groupBy("key").agg(F.countDistinct("path").alias("n"), F.min("path").alias("path"))
    return names.select("target").distinct().withColumn("key", F.lower("target")).join(keys, "key", "left").select("target", F.when(F.col("n") == 1, F.col("path")).alias("dst"))


def update_keys(keys: DataFrame, removed: DataFrame, inserted: DataFrame) -> DataFrame:
    """The index (key, rank, path) after files (path) are removed and files (path, stem) inserted, without a rebuild."""
    gone = removed.select("path").unionByName(inserted.select("path")).distinct()
    return keys.join(gone, "path", "left_anti").unionByName(file_keys(inserted)).select("key", "rank", "path")


def trace_moves(moves: DataFrame, starts: DataFrame) -> DataFrame:
    """(path, now, steps): where files (path) are now, after moves (old, new, seq) in order of seq; each later move of the new path counts.

    Rounds go on until no file moves any more; seq rises along a trace, so it ends.
    """
    own = starts.select("path", F.col("path").alias("now"), F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("steps"))
    while True:
        later = own.alias("o").join(moves.alias("m"), (F.col("o.now") == F.col("m.old")) & (F.col("m.seq") > F.col("o.seq")), "left")
        step = later.groupBy("o.path", "o.now", F.col("o.seq").alias("since"), "o.steps").agg(F.min(F.struct("m.seq", "m.new")).alias("m"))
        moved = F.col("m.seq").isNotNull()
        own = written(step.select("path", F.when(moved, F.col("m.new")).otherwise(F.col("now")).alias("now"), F.coalesce("m.seq", "since").alias("seq"), (F.col("steps") + F.when(moved, 1).otherwise(0)).alias("steps"), moved.alias("moved")), "trace")
        if own.where("moved").isEmpty():
            return own.select("path", "now", "steps")
        own = own.drop("moved")


def identity_dependents(own: DataFrame, targets: DataFrame, refs: DataFrame) -> DataFrame:
    """Sources (src) whose verdict depends on what a target (path) claims: its inbound edges from typed slots."""
    typed = refs.select(F.col("field").alias("slot")).distinct()
    return own.join(targets.select(F.col("path").alias("dst")), "dst", "left_semi").join(F.broadcast(typed), "slot", "left_semi").select("src").distinct()


def type_referrers(files: DataFrame, parents: DataFrame, sealed: DataFrame, refs: DataFrame) -> DataFrame:
    """(type, referrer, how): who mentions a type by claim, parent, sealed member or slot."""
    claims = files.select(F.col("kind").alias("type"), F.col("path").alias("referrer"), F.lit("claim").alias("how"))
    rest = [(parents, "parent", "child", "extends"), (sealed, "member", "parent", "sealed"), (refs, "target", "type", "slot")]
    for df, named, by, how in rest:
        claims = claims.unionByName(df.select(F.col(named).alias("type"), F.col(by).alias("referrer"), F.lit(how).alias("how")))
    return claims.distinct()
