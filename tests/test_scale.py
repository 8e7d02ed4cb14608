"""Work is dealt over tasks whatever the layout of the input, and task memory and shuffles stay in bounds."""

from pyspark.sql import functions as F

from typeloom.operators import components, graph, validate
from typeloom.plans import registry, ship, skew
from typeloom.sources import folder

SF = "/root/testdata/sf0.001"


def test_parse_of_one_file_of_many_rows_is_dealt(spark, tmp_path):
    spark.range(3000).select(F.format_string("c/n%d.md", "id").alias("path"), F.format_string("---\ntype: note\nkey: %d\n---\nSee [[x%d]]", "id", "id").alias("text")).coalesce(1).write.parquet(str(tmp_path / "t"))
    parsed = folder.parse_texts(spark.read.parquet(str(tmp_path / "t")))
    tasks = parsed.select(F.spark_partition_id().alias("t"), "path").groupBy("t").agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in tasks) == 3000 and len(tasks) > 1 and max(r.n for r in tasks) < 2000


def _base(spark):
    files = spark.createDataFrame([("r", f"r/n{k}.md", f"n{k}", "part", k) for k in range(12)], "repo string, path string, stem string, kind string, k long")
    pairs = [(0, 1), (1, 2), (5, 4), (4, 3), (7, 8), (2, 9), (10, 10)]
    links = spark.createDataFrame([(f"r/n{a}.md", "r", f"n{b}", None, "body", a, None) for a, b in pairs] + [("x/note.md", "x", "n8", None, "body", 0, None), ("x/note.md", "x", "n11", None, "body", 1, None), (None, "r", "n6", None, "body", 0, None), (None, "r", "n0", None, "body", 0, None)], "src string, repo string, target string, slot string, surface string, pos long, pin string")
    want = {0: 0, 1: 0, 2: 0, 9: 0, 3: 3, 4: 3, 5: 3, 6: 6, 7: 11, 8: 11, 10: 10, 11: 11}
    return files, links, {f"r/n{k}.md": f"r/n{v}.md" for k, v in want.items()}


def test_components_join_numbers_not_paths(spark, monkeypatch):
    seen, files_links_want = [], _base(spark)
    for module in (components, graph):
        monkeypatch.setattr(module, "written", lambda df, name, f=module.written: seen.append((name, df.dtypes)) or f(df, name))
    files, links, want = files_links_want
    assert {r.path: r.component for r in graph.weak_components(links, files).collect()} == want
    edges = [types for name, types in seen if name == "edges"]
    assert edges and all(kind == "bigint" for types in edges for _, kind in types)


def test_numbers_that_collide_are_drawn_again(spark, monkeypatch):
    weak = lambda node, seed=0: F.pmod(F.xxhash64(F.lit(seed), node), F.lit(4 if seed < 2 else 1 << 62))
    for module in (components, graph):
        monkeypatch.setattr(module, "node_id", weak)
    files, links, want = _base(spark)
    assert components.seed_without_collision(files.select(F.col("path").alias("node"))) == 2
    assert {r.path: r.component for r in graph.weak_components(links, files).collect()} == want


def test_contraction_deals_hubs_and_follows_chains(spark, monkeypatch):
    monkeypatch.setattr(skew, "LIGHT_FLOOR", 10)
    hub = spark.range(1, 200).select(F.lit(500).cast("long").alias("a"), F.col("id").alias("b"))
    chain = spark.range(1000, 1300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    out = components.contracted(hub.unionByName(chain)).groupBy("root").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).collect()
    assert sorted((r.n, r.a, r.b) for r in out) == [(200, 1, 500), (301, 1000, 1300)]


def test_graph_shape_resolves_links_once(spark, monkeypatch):
    calls, (files, links, _) = [], _base(spark)
    monkeypatch.setattr(graph, "resolve_links", lambda *a, f=graph.resolve_links: calls.append(a) or f(*a))
    links = links.where("src like 'r/%'")
    got = graph.graph_shape(links, files).first().asDict()
    assert got == {"nodes": 12, "edges": 7, "isolated": 2, "no_inbound": 5, "components": 6, "largest": 4}
    assert len(calls) == 1


def test_inbound_counts_join_no_link(spark, monkeypatch):
    files, links, _ = _base(spark)
    links = links.unionByName(links.where("target = 'n8'").withColumn("pin", F.lit("c0ffee"))).unionByName(links.where("target = 'n8'").withColumn("slot", F.lit("s")))
    want = sorted(graph.edges(links, files).groupBy("dst").agg(F.count_if(F.col("slot").isNotNull()).alias("s"), F.count("*").alias("t")).collect())
    monkeypatch.setattr(graph, "resolve_links", None)
    assert sorted(graph.hubs(links, files).collect()) == want
    assert {r.dst: (r.field, r.contributing, r.navigational) for r in graph.references_in(links, files).collect()}["r/n8.md"] == (0, 2, 2)


def test_neighborhood_reads_its_edges_once(spark):
    rows = spark.sparkContext.accumulator(0)

    def count(x):
        rows.add(1)
        return x

    own = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(9)], "src string, dst string").coalesce(1).withColumn("dst", F.udf(count)("dst"))
    found = graph.neighborhood(own, spark.createDataFrame([("n4",)], "path string"), 3)
    assert {r.path: r.depth for r in found.collect()} == {f"n{k}": abs(k - 4) for k in range(1, 8)}
    assert rows.value == 9


def test_links_without_a_diagnostic_are_not_kept(spark):
    rows = [("a", None, "b", "resolved"), ("a", "s", "b", "resolved"), ("a", None, None, "missing"), ("a", "s", None, "escaping"), ("a", None, None, "ambiguous"), ("a", None, None, "pinned")]
    kept = validate.faulty(spark.createDataFrame(rows, "src string, slot string, dst string, outcome string"))
    assert sorted((r.slot or "", r.outcome) for r in kept.collect()) == [("", "ambiguous"), ("", "missing"), ("s", "escaping"), ("s", "resolved")]


def test_diagnostics_of_a_folder_resolve_its_links_only(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(graph, "resolve_links", lambda links, files, f=graph.resolve_links: seen.append(links) or f(links, files))
    every = registry.queries()["diagnostics"](spark, SF).where("path like 'ASIA/order/%'")
    some = registry.queries()["diagnostics_under"](spark, SF)
    assert sorted(map(tuple, every.fillna("").collect())) == sorted(map(tuple, some.fillna("").collect()))
    assert 0 < seen[1].count() == seen[1].where("src like 'ASIA/order/%'").count() < seen[0].count()


def test_splits_are_bounded_unless_the_application_sets_them(spark):
    for key, size in ship.SPLITS.items():
        was = spark.conf.get(key)
        spark.conf.unset(key)
        ship.ship(spark)
        assert int(spark.conf.get(key)) == size
        spark.conf.set(key, "33m")
        ship.ship(spark)
        assert spark.conf.get(key) == "33m"
        spark.conf.set(key, was)


def test_candidates_deal_records_before_they_are_made_distinct(spark):
    plan = registry.queries()["candidates"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [event_id" in plan
    records = spark.range(1000).select(F.col("id").alias("event_id"))
    assert skew.dealt_by(records, "event_id", 100).rdd.getNumPartitions() > 50
