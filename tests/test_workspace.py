"""Members, body templates and placement on small tables of their own."""

from pyspark.sql import functions as F

from typeloom.operators import bodies as B
from typeloom.operators import members as M


def test_roles_and_places(spark):
    claims = spark.createDataFrame([("a", "entry"), ("a", "dep"), ("b", "discover"), ("b", "dep"), ("c", "edit"), ("d", "edit")], "repo string, role string")
    places = spark.createDataFrame([("a", "cache", "/1"), ("a", "sibling", "/2"), ("b", "cache", "/3"), ("c", "registry", "/5"), ("c", "registry", "/4")], "repo string, place string, root string")
    off = spark.createDataFrame([("d",)], "repo string")
    located = M.locate(places)
    got = {tuple(r) for r in M.assemble(claims, located, off).collect()}
    assert got == {("a", "entry", True, "/2"), ("b", "dep", False, "/3"), ("c", "edit", True, "/4")}
    codes = {(r.repo, r.code) for r in M.consistency(claims, places, claims.limit(0).select("repo", F.col("role").alias("dep")), off).collect()}
    assert codes == {("b", "discover-member-is-a-dependency"), ("c", "duplicate-repo-name")}
    assert M.assemble(claims.limit(0), located, off).count() == 0


def test_locks_pass_through_local_repos(spark):
    deps = spark.createDataFrame([("a", "b"), ("b", "p"), ("p", "q"), ("q", "p"), ("x", "q")], "repo string, dep string")
    places = spark.createDataFrame([("a", "sibling", "/a"), ("b", "sibling", "/b"), ("p", "cache", "/p"), ("q", "cache", "/q")], "repo string, place string, root string")
    pins = spark.createDataFrame([("p",), ("q",)], "repo string")
    assert sorted(map(tuple, M.locks(deps, M.locate(places), pins).collect())) == [("a", "p"), ("a", "q"), ("b", "p"), ("b", "q")]


def test_globs(spark):
    rows = [("*/order", "x/order/", True), ("*/order", "order/", False), ("*/order", "x/y/order/", False), ("**/audit", "audit/", True), ("**/audit", "x/y/audit/", True), ("a.b/**", "a.b/", True), ("a.b/**", "acb/", False), ("**", "", True), ("**", "x/y/", True)]
    df = spark.createDataFrame(rows, "glob string, folder string, want boolean")
    assert df.where(F.rlike("folder", B.glob_pattern(F.col("glob"))) != F.col("want")).count() == 0


def test_splice_leaves_out_what_stands_in_itself(spark):
    items = spark.createDataFrame([("a", 1, "x", None), ("a", 2, None, "b"), ("b", 1, None, "a"), ("b", 2, "y", None), ("c", 1, None, "gone")], "type string, pos int, section string, use string")
    got = {}
    for r in sorted(B.splice(items).collect()):
        got.setdefault(r.type, []).append(r.section)
    assert got == {"a": ["x", "y"], "b": ["x", "y"]}
    assert B.splice(items.limit(0)).count() == 0
