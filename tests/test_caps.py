"""No bound on rounds: long chains, and nodes of very many edges."""

import pytest
from pyspark.sql import functions as F

from typeloom.operators import typegraph as T
from typeloom.operators.components import connected_components
from typeloom.plans import shared, skew


def test_long_chain_is_one_component(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in connected_components(chain).collect()} == {0}


def test_hub_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(skew, "LIGHT_FLOOR", 10)
    hub = spark.range(1, 200).select(F.lit(500).cast("long").alias("a"), F.col("id").alias("b")).unionByName(spark.createDataFrame([(900, 901)], "a long, b long"))
    out = {r.node: r.component for r in connected_components(hub).collect()}
    assert out == {k: 1 for k in [*range(1, 200), 500]} | {900: 900, 901: 900}


def test_closure_of_a_chain_has_no_depth(spark):
    n = 70
    types = spark.range(n).select(F.format_string("t%d", "id").alias("name"))
    parents = spark.range(n - 1).select(F.format_string("t%d", "id").alias("child"), F.format_string("t%d", F.col("id") + 1).alias("parent"))
    assert T.closure(types, parents).count() == n * (n + 1) // 2


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join(spark, monkeypatch, how):
    monkeypatch.setattr(skew, "FLOOR", 5)
    big = spark.range(60).select((F.col("id") % 7 * (F.col("id") % 2)).alias("k"), "id")
    small = spark.createDataFrame([(0, "x"), (3, "y"), (9, "z")], "k long, w string")
    hot = skew.hot_keys(big.groupBy("k").agg(F.count("*").alias("n")), ["k"])
    assert (0,) in hot
    order = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    assert order(skew.spread_join(big, small, ["k"], hot, ["id"], how)) == order(big.join(small, "k", how))


def test_shared_folder_must_be_set_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session())
