"""Components of all files over all resolved links, against a plain union-find."""

import random

from pyspark.sql import functions as F

from typeloom.plans import registry

SF = "/root/testdata/sf0.001"


def brute(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return {n: find(n) for n in nodes}


def test_components_of_a_small_base(spark):
    rng = random.Random(7)
    kinds = ["customer", "part", "order", "region", "supplier"]
    stems = [f"n{k}" for k in range(60)]
    files = spark.createDataFrame([("r", f"r/{s}.md", s, kinds[k % 5], k) for k, s in enumerate(stems)], "repo string, path string, stem string, kind string, k long")
    pairs = [(rng.choice(stems[:50]), rng.choice(stems[:50])) for _ in range(35)]
    rows = [(f"r/{a}.md", "r", b.upper() if k % 2 else f"r/{b}.md", None, "body" if k % 3 else "frontmatter", k, None) for k, (a, b) in enumerate(pairs)]
    rows += [("r/n51.md", "r", "n52", None, "body", 0, "c0ffee"), ("r/n53.md", "r", "gone", None, "body", 0, None), ("r/n54.md", "r", "../n55", None, "body", 0, None)]  # none resolves
    links = spark.createDataFrame(rows, "src string, repo string, target string, slot string, surface string, pos long, pin string")
    want = brute([f"r/{s}.md" for s in stems], [(f"r/{a}.md", f"r/{b}.md") for a, b in pairs])
    assert {r.path: r.component for r in registry.weak_components(links, files).collect()} == want
    assert len(set(want.values())) > 10


def test_registered_components_cover_every_file(spark):
    from typeloom.operators import graph as G
    from typeloom.sources.derive import knowledge_base

    kb = knowledge_base(spark, SF, "kb_links", "kb_files")
    paths = [r.path for r in kb["kb_files"].select("path").distinct().collect()]
    pairs = [(r.src, r.dst) for r in G.edges(kb["kb_links"], kb["kb_files"]).select("src", "dst").distinct().collect()]
    out = registry.queries()["weak_components"](spark, SF)
    assert {r.path: r.component for r in out.collect()} == brute(paths, pairs)
    assert out.where(F.col("path").contains("/part/")).count() > 0
