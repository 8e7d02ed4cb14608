import json

import pytest
from pyspark.sql import functions as F

from typeloom.operators import mutate as M
from typeloom.operators import typegraph as T
from typeloom.sources import folder, markdown
from typeloom.streaming import events as S

NOTE = "---\ntype: card\ntitle: 'x'\nn: 3\nn: 4\nbox:\n  type: inner\n  ^: b9\n---\n# Top ^t1\nsee [[other#Top]] and `[[no]]`\n```yaml [:box]\n[[masked]]\n```\n^f1\n## Sub\n```\nopen"


@pytest.mark.skipif(markdown.yaml is None, reason="no YAML library")
def test_folder(spark, tmp_path):
    (tmp_path / "type").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "z.md").write_text("no")
    (tmp_path / "a.md").write_text(NOTE)
    (tmp_path / "plain.md").write_text("just [[a]]")
    (tmp_path / "skip.md").write_text("ignored")
    (tmp_path / "pic.png").write_bytes(b"\0")
    (tmp_path / "type" / "card.type.yaml").write_text("extends: [base, other]\nfields:\n  title: String\n  n?: Number\n")
    parsed = folder.parse(folder.read_files(spark, str(tmp_path), ["skip.md"])).cache()
    kinds = {r.path: r.kind for r in parsed.collect()}
    assert kinds == {"a.md": "instance", "plain.md": "note", "pic.png": "asset", "type/card.type.yaml": "type-def"}
    t = folder.tables(parsed)
    a = t["events"].where("path = 'a.md'").orderBy("pos").collect()
    assert [(e.kind, e.block_id) for e in a] == [("heading", "t1"), ("link", ""), ("code", ""), ("fence", "f1"), ("heading", ""), ("unterminated_fence", "")]
    assert a[4].section == ["Top", "Sub"] and markdown.field_marker(a[3].info) == "box"
    assert {r.code for r in t["diagnostics"].where("path = 'a.md'").collect()} == {"duplicate-key:n", "unterminated-fence"}
    assert [(r.pointer, r.claim, r.block_id) for r in t["records"].collect()] == [("/box", "inner", "b9")]
    assert json.loads(t["instances"].where("path = 'a.md'").first().fields)["n"] == 3
    v = folder.type_vocabulary(t["type_defs"])
    assert {tuple(r) for r in v["parents"].collect()} == {("card", "base"), ("card", "other")}
    assert {tuple(r) for r in v["fields"].collect()} == {("card", "title", "String", False), ("card", "n", "Number", True)}


def test_frontmatter_edges():
    assert markdown.split_frontmatter("---\na: 1\n")[2] == "unterminated-frontmatter"
    assert markdown.split_frontmatter("a\n---\n") == (None, "a\n---\n", None)
    assert markdown.type_name("x/y/card.type.yaml") == "card"


def test_closure_ids_and_meta():
    ids = T.closure_ids({"a": "1", "b": "2", "c": "3", "d": "3"}, {"a": ["b"], "b": ["a", "c"], "d": ["gone"]})
    assert ids["a"] == ids["b"] != ids["c"] and ids["c"] != ids["d"]
    assert T.closure_ids({"a": "1", "b": "2"}, {"a": ["b"]})["a"] != T.closure_ids({"a": "1", "b": "9"}, {"a": ["b"]})["a"]
    blocks = {"p": {"m": 1}, "q": {"m": 2}, "r": None}
    assert T.lookup_meta("x", {"x": ["r", "q"], "r": ["p"]}, blocks, "m") == ("q", 2)


def test_mutations(spark):
    files = spark.createDataFrame([("a.md", "one [[b]] two [[B#x]] [[b@c0ffee]] [[b::r@c0ffee]] [[bb]]"), ("b.md", "x x")], "path string, text string")
    text = lambda df, p: df.where(F.col("path") == p).first().text
    assert text(M.edit_file(files, "a.md", "two", "2"), "a.md").startswith("one [[b]] 2")
    with pytest.raises(M.EditRefused):
        M.edit_file(files, "b.md", "x", "y")
    assert text(M.edit_file(files, "b.md", "x", "y", replace_all=True), "b.md") == "y y"
    with pytest.raises(M.EditRefused):
        M.write_file(files, "b.md", "new", expected="0")
    assert M.delete_file(files, "b.md").count() == 1
    moves = spark.createDataFrame([("b.md", "c.md", "b", "c")], "old_path string, new_path string, old_stem string, new_stem string")
    moved = M.rename(files, moves)
    assert text(moved, "a.md") == "one [[c]] two [[c#x]] [[b@c0ffee]] [[b::r@c0ffee]] [[bb]]" and text(moved, "c.md") == "x x"
    assert M.assign_block_id("a\nb", 1, "z") == "a\nb ^z" and M.assign_block_id("a ^q", 0, "z") == "a ^q"
    assert M.ensure_mixin(["vip"], "party", {"vip": {"vip", "party"}}) == ["vip"] and M.ensure_mixin(["x"], "m", {}) == ["x", "m"]
    if markdown.yaml:
        value = {"a": [1, {"b": "yes"}, []], "c": {"d": None, "e": "x: y"}, "t": True}
        assert markdown.load_yaml(M.render_yaml(value))[0]["c"] == value["c"]


def test_streams(spark, tmp_path):
    src = tmp_path / "src"
    rows = [("a", 1, "x"), ("b", 1, "y"), ("a", 2, "z")]
    spark.createDataFrame(rows, "key string, ts int, mark string").coalesce(1).write.parquet(str(src))
    table = S.VersionedTable(spark, str(tmp_path / "state"))
    stream = spark.readStream.schema("key string, ts int, mark string").parquet(str(src))
    S.run_available(stream, table.apply, str(tmp_path / "cp"))
    assert {tuple(r) for r in table.read().collect()} == {("a", "z"), ("b", "y")}
    first = table.version
    spark.createDataFrame([("b", 3, None), ("c", 3, "w")], "key string, ts int, mark string").coalesce(1).write.mode("append").parquet(str(src))
    S.run_available(stream, table.apply, str(tmp_path / "cp"))
    assert {tuple(r) for r in table.delta(first, table.version).collect()} == {("b", "removed"), ("c", "added")}
    again = table.version
    assert S.VersionedTable(spark, str(tmp_path / "state")).version == again > first  # another process goes on from here
    (tmp_path / "state" / f"v{again + 5}").mkdir()  # written in part, never committed
    table = S.VersionedTable(spark, str(tmp_path / "state"))
    table.apply(spark.createDataFrame([("d", 4, "v")], "key string, ts int, mark string"), again)  # the batch again
    assert table.version == again and {tuple(r) for r in table.read().collect()} == {("a", "z"), ("c", "w")}
    table.apply(spark.createDataFrame([("c", 4, "w")], "key string, ts int, mark string"), again + 1)
    assert table.version == again  # nothing changed


def test_windows(spark):
    e = spark.createDataFrame([(1, "2024-01-01 00:10:00", "v", 1.0), (1, "2024-01-01 00:50:00", "v", 2.0), (1, "2024-01-02 00:50:00", "v", 2.0)], "user_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.n for r in S.windowed_counts(e).collect()) == [1, 2]
    assert sorted(r.n for r in S.session_counts(e).collect()) == [1, 2]
