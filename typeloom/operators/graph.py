"""Link resolution and reads over the reference graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typeloom.operators.components import contracted, named, node_id, rooted, seed_without_collision
from typeloom.plans.shared import drop_written, written


def file_keys(files: DataFrame) -> DataFrame:
    """(key, rank, path): names a file answers to; rank 1 its base name, rank 2 its stem, both lower-cased; rank 0 its path."""
    base = F.lower(F.element_at(F.split("path", "/"), -1))
    names = F.array(F.struct(F.col("path").alias("key"), F.lit(0).alias("rank")), F.struct(base.alias("key"), F.lit(1).alias("rank")), F.struct(F.lower("stem").alias("key"), F.lit(2).alias("rank")))
    return files.select("path", F.explode(names).alias("n")).select("n.key", "n.rank", "path")


def escapes(target: Column) -> Column:
    """An absolute target, or one that climbs above the root, can never resolve."""
    step = lambda acc, s: F.struct((acc["at"] + F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1)).alias("at"), F.least(acc["low"], acc["at"] + F.when(s == "..", -1).otherwise(0)).alias("low"))
    low = F.aggregate(F.split(target, "/"), F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), step, lambda acc: acc["low"])
    return target.startswith("/") | (target.contains("/") & (low < 0))


def resolve_targets(targets: DataFrame, files: DataFrame) -> DataFrame:
    """(target, dst, outcome) of distinct ``targets`` (target); the best rank with any hit decides, an ambiguity there doesn't fall through."""
    targets = targets.withColumn("out", escapes(F.col("target"))).withColumn("key", F.when(F.col("target").contains("/"), F.col("target")).otherwise(F.lower("target")))
    hits = targets.where("not out").join(file_keys(files), "key").where("rank > 0 or contains(target, '/')").groupBy("target", "rank").agg(F.countDistinct("path").alias("n"), F.min("path").alias("path"))
    best = hits.groupBy("target").agg(F.min(F.struct("rank", "n", "path")).alias("b"))
    return targets.join(best, "target", "left").select(
        "target",
        F.when(F.col("b.n") == 1, F.col("b.path")).alias("dst"),
        F.when(F.col("out"), "escaping").when(F.col("b").isNull(), "missing").when(F.col("b.n") == 1, "resolved").otherwise("ambiguous").alias("outcome"),
    )


def resolve_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """``links`` with ``dst`` and ``outcome``: resolved, ambiguous, missing, escaping or pinned.

    Distinct targets are resolved once, then joined back, so a target that a third of all links name is
    one row until then.
    """
    known = resolve_targets(links.where("pin is null").select("target").distinct(), files)
    joined = links.join(known, "target", "left")
    return joined.withColumn("outcome", F.when(F.col("pin").isNotNull(), "pinned").otherwise(F.col("outcome"))).withColumn("dst", F.when(F.col("pin").isNull(), F.col("dst")))


def edges(links: DataFrame, files: DataFrame) -> DataFrame:
    """Resolved links: (src, dst, slot, surface)."""
    return resolve_links(links, files).where("outcome = 'resolved'").select("src", "dst", "slot", "surface")


def edge_kind() -> Column:
    """field in the front matter, contributing in a body with a slot, else navigational."""
    return F.when(F.col("surface") == "frontmatter", "field").when((F.col("surface") == "body") & F.col("slot").isNotNull(), "contributing").otherwise("navigational")


def references_out(links: DataFrame, files: DataFrame) -> DataFrame:
    """Every outgoing link with kind: pin, broken, or its :func:`edge_kind`."""
    kind = F.when(F.col("outcome") == "pinned", "pin").when(F.col("outcome") != "resolved", "broken").otherwise(edge_kind())
    return resolve_links(links, files).select("src", "target", "dst", kind.alias("kind"))


def _inbound(links: DataFrame, files: DataFrame, **counts: Column) -> DataFrame:
    """(dst, counts) over the resolved links of each file; links are counted by target before that is resolved, so none of them is joined."""
    free = links.where("pin is null")
    per = free.groupBy("target").agg(*[c.alias(name) for name, c in counts.items()])
    known = resolve_targets(free.select("target").distinct(), files).where("outcome = 'resolved'").select("target", "dst")
    return per.join(known, "target").groupBy("dst").agg(*[F.sum(name).alias(name) for name in counts])


def references_in(links: DataFrame, files: DataFrame) -> DataFrame:
    """Inbound counts by kind for each file that has any."""
    return _inbound(links, files, **{k: F.count_if(edge_kind() == k) for k in ("field", "contributing", "navigational")})


def hubs(links: DataFrame, files: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Most-referenced files: structural then total inbound edges, falling; ``place`` is the rank, ties by path."""
    count = _inbound(links, files, structural=F.count_if(F.col("slot").isNotNull()), total=F.count("*")).withColumnRenamed("dst", "path")
    if limit is None:
        return count
    return count.orderBy(F.desc("structural"), F.desc("total"), "path").offset(offset).limit(limit)


def link_graph(links: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes with their in- and out-degrees; each edge gives both its ends in one pass."""
    ends = F.array(F.struct(F.col("src").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("path"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    half = edges(links, files).select(F.explode(ends).alias("e")).select("e.*")
    sums = half.groupBy("path").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return files.select("path", "kind").join(sums, "path", "left").select("path", "kind", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def _numbered(links: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Nodes (node, is_file), edges (a, b) of their numbers, and the seed of the numbers: no two nodes have the same one."""
    sources = links.where("src is not null").select(F.col("src").alias("node"), F.lit(False).alias("is_file"))
    ends = files.select(F.col("path").alias("node"), F.lit(True).alias("is_file")).unionByName(sources)
    nodes = written(ends.groupBy("node").agg(F.max("is_file").alias("is_file")), "nodes")
    seed = seed_without_collision(nodes)
    # the join on targets carries a number for each link, not its source's path
    own = resolve_links(links.where("pin is null and src is not null").select(node_id("src", seed).alias("a"), "target", "pin"), files)
    return nodes, written(own.where("outcome = 'resolved'").select("a", node_id("dst", seed).alias("b")), "edges"), seed


def weak_components(links: DataFrame, files: DataFrame) -> DataFrame:
    """(path, component) for every file; a component is named by its least path, a file without edges is one."""
    nodes, own, seed = _numbered(links, files)
    roots = contracted(own)
    drop_written(own)
    return named(nodes, roots, seed).where("is_file").select(F.col("node").alias("path"), "component")


def graph_shape(links: DataFrame, files: DataFrame) -> DataFrame:
    """One row: nodes, edges, isolated, no_inbound, components, largest."""
    nodes, own, seed = _numbered(links, files)
    ends = F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("b").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = own.select(F.explode(ends).alias("e")).select("e.*").groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    graph = files.select(node_id("path", seed).alias("id")).join(sums, "id", "left").select(F.coalesce("o", F.lit(0)).alias("out_degree"), F.coalesce("i", F.lit(0)).alias("in_degree"))
    sizes = rooted(nodes.where("is_file"), contracted(own), seed).groupBy("root").agg(F.count("*").alias("n"))
    left = graph.agg(F.count("*").alias("nodes"), F.sum("out_degree").alias("edges"), F.count_if((F.col("in_degree") == 0) & (F.col("out_degree") == 0)).alias("isolated"), F.count_if(F.col("in_degree") == 0).alias("no_inbound"))
    right = sizes.agg(F.count("*").alias("components"), F.max("n").alias("largest"))
    names = [*left.columns, *right.columns]
    return left.unionByName(right, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in names])


def degree_histogram(links: DataFrame, files: DataFrame) -> DataFrame:
    """(direction, degree, n)."""
    graph = link_graph(links, files)
    both = graph.select(F.explode(F.array(F.struct(F.lit("in").alias("direction"), F.col("in_degree").alias("degree")), F.struct(F.lit("out").alias("direction"), F.col("out_degree").alias("degree")))).alias("d"))
    return both.groupBy("d.direction", "d.degree").agg(F.count("*").alias("n")).select("direction", "degree", "n")


def neighborhood(own: DataFrame, seeds: DataFrame, depth: int, direction: str = "both", budget: int | None = None) -> DataFrame:
    """(path, depth): level-synchronous search from ``seeds`` (path) over edges (src, dst), by least depth.

    ``budget`` bounds the visited nodes: within the level that exceeds it, paths in order stay.
    """
    own = written(own.select("src", "dst"), "steps")  # every level reads it, both ways
    out = own.select(F.col("src").alias("near"), F.col("dst").alias("far"))
    back = own.select(F.col("dst").alias("near"), F.col("src").alias("far"))
    step = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    seen = written(seeds.select("path").distinct().withColumn("depth", F.lit(0)), "seen")
    for level in range(1, depth + 1):
        front = seen.where(F.col("depth") == level - 1).select(F.col("path").alias("near"))
        found = step.join(front, "near").select(F.col("far").alias("path")).distinct().join(seen, "path", "left_anti").withColumn("depth", F.lit(level))
        if budget is not None:
            found = found.orderBy("path").limit(max(budget - seen.count(), 0))
        after = written(seen.unionByName(found), "seen")
        drop_written(seen)
        seen = after
    drop_written(own)
    return seen


def referenced_names(links: DataFrame) -> DataFrame:
    """(key, src): which sources name a key."""
    return links.select(F.lower("target").alias("key"), "src").distinct()


def edge_flip_sources(links: DataFrame, changed: DataFrame) -> DataFrame:
    """Sources whose links may change outcome when the ``changed`` files (path, stem) appear or go."""
    keys = file_keys(changed).select("key").distinct()
    return referenced_names(links).join(keys, "key", "left_semi").select("src").distinct()


def pins(links: DataFrame) -> DataFrame:
    """Commit-pinned links by target: never resolved, never dangling."""
    return links.where("pin is not null").groupBy("target", "pin").agg(F.count("*").alias("n"))


def external_links(pages: DataFrame) -> DataFrame:
    """(page_id, href) of raw web pages, in order of appearance."""
    hrefs = F.regexp_extract_all("html", F.lit(r"""href="([^"]*)\""""), 1)
    return pages.select("page_id", F.posexplode(hrefs).alias("pos", "href"))


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
