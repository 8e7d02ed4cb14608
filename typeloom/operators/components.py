"""Connected components of an undirected graph that is too large for any one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.plans import skew
from typeloom.plans.shared import drop_written, free_shuffles, written
from typeloom.plans.skew import hot_keys, spread_join


def node_id(node: Column | str, seed: int = 0) -> Column:
    """A 64-bit number for a node, for use with :func:`seed_without_collision`."""
    return F.xxhash64(F.lit(seed), node)


def seed_without_collision(nodes: DataFrame, seed: int = 0) -> int:
    """The first seed from ``seed`` on with which all ``nodes`` (node), distinct, get different numbers."""
    while not nodes.groupBy(node_id("node", seed)).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        seed += 1
    return seed


def named(nodes: DataFrame, roots: DataFrame, seed: int) -> DataFrame:
    """``nodes`` (node, ...), distinct, with component by ``roots`` (id, root): the least node of those with one root; a node without a root is one."""
    own = written(rooted(nodes, roots, seed), "rooted")
    least = own.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("n"))
    return spread_join(own, least.drop("n"), ["root"], hot_keys(least.select("root", "n"), ["root"], skew.LIGHT_FLOOR), ["node"]).drop("root")


def rooted(nodes: DataFrame, roots: DataFrame, seed: int) -> DataFrame:
    """``nodes`` (node, ...) with root, that of ``roots`` (id, root) or else their own number."""
    own = nodes.withColumn("id", node_id("node", seed)).join(roots, "id", "left")
    return own.withColumn("root", F.coalesce("root", "id")).drop("id")


def contracted(edges: DataFrame) -> DataFrame:
    """(id, root) for each node of ``edges`` (a, b), long; the nodes of a component, and they only, have one root.

    In a round every node points to its least neighbour if that is less than itself, pointers are followed
    to their ends, and each tree becomes one node. A tree's root that no neighbour has chosen points to a
    lesser one in the next round, so two rounds halve the trees that still have edges. The first round is
    over all edges, those after it over the few between trees.
    """
    now, roots = written(edges.where("a <> b"), "edges"), None
    while True:
        ends = now.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("to")), F.struct(F.col("b").alias("id"), F.col("a").alias("to")))).alias("e")).select("e.*")
        low = written(ends.groupBy("id").agg(F.least("id", F.min("to")).alias("to"), F.count("*").alias("n")), "low")
        hot = hot_keys(low.select("id", "n"), ["id"], skew.LIGHT_FLOOR)
        trees = _followed(low.select("id", "to"))
        drop_written(low)
        at = lambda name: trees.select(F.col("id").alias(name), F.col("to").alias(f"{name}_to"))
        half = spread_join(now, at("a"), ["a"], hot, ["b"]).select(F.col("a_to").alias("a"), "b")
        both = spread_join(half, at("b"), ["b"], hot, ["a"]).select("a", F.col("b_to").alias("b"))
        after = written(both.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        if roots is None:
            roots = trees.select("id", F.col("to").alias("root"))
            roots._typeloom_path = trees._typeloom_path
        else:
            # most nodes have the root of a large tree: it is dealt like any hot key
            sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
            moved = trees.select(F.col("id").alias("root"), F.col("to").alias("__to"))
            more = written(spread_join(roots, moved, ["root"], hot_keys(sizes, ["root"], skew.LIGHT_FLOOR), ["id"], "left").select("id", F.coalesce("__to", "root").alias("root")), "roots")
            drop_written(roots)
            drop_written(trees)
            roots = more
        drop_written(now)
        now = after
        if now.isEmpty():
            break
    drop_written(now)
    free_shuffles(roots.sparkSession)
    return roots


def _followed(pointers: DataFrame) -> DataFrame:
    """``pointers`` (id, to), a forest, with ``to`` the end of each way; each pass doubles the steps taken."""
    now, mark = pointers, None
    while True:
        # nodes that point to an end are through; only they are joined again whose end has a pointer of its own
        on = now.where("id <> to").select(F.col("id").alias("to"), F.col("to").alias("far"))
        sizes = now.where("id <> to").groupBy("to").agg(F.count("*").alias("n"))
        hot = hot_keys(sizes, ["to"], skew.LIGHT_FLOOR)
        after = written(spread_join(now, on, ["to"], hot, ["id"], "left").select("id", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("__moved")), "pointers")
        moved = after.agg(F.count_if("__moved")).first()[0]
        if now is not pointers:
            drop_written(now)
        if not moved:
            out = after.select("id", "to")
            out._typeloom_path = after._typeloom_path
            return out
        path = after._typeloom_path
        now = after.select("id", "to")
        now._typeloom_path = path


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``edges`` (a, b); a component is named by its least node.

    Alternating large-star and small-star steps: each is a minimum per node, combined before the
    shuffle, and a join on that node that deals nodes of very many edges over tasks. A round's edges are
    written to the shared folder, and the loop goes on until they stop changing.
    """
    now = written(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct(), "edges")
    mark, n = None, now.count()
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # every greater neighbour of u moves to u's least neighbour
        large = _starred(both, n).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # every lesser neighbour of u, and u itself, moves to the least of them
        small = _starred(large, n).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        after = written(small.where("u <> v").distinct(), "edges")
        found = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        drop_written(now)
        now, n = after, found[0]
        if found == mark:
            break
        mark = found
    free_shuffles(now.sparkSession)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _starred(pairs: DataFrame, n: int) -> DataFrame:
    """``pairs`` (u, v), 2 n at most, with m, the least v of u."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hot = hot_keys(low, ["u"], skew.LIGHT_FLOOR) if 2 * n > skew.LIGHT_FLOOR else []
    return spread_join(pairs, low.drop("n"), ["u"], hot, ["v"])
