import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from typeloom.functions import grammar as G
from typeloom.functions import text as X


def test_fnv1a_vectors():
    texts = [b"", b"a", b"foobar"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.cumsum([0, *map(len, texts)])
    assert [f"{int(h):016x}" for h in X.fnv1a(data, offs)] == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8"]


def test_fnv1a_against_a_loop():
    rng = random.Random(1)
    texts = [bytes(rng.randrange(256) for _ in range(rng.randrange(40))) for _ in range(50)]
    h = X.fnv1a(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    for text, got in zip(texts, h):
        want = 0xCBF29CE484222325
        for b in text:
            want = ((want ^ b) * 0x100000001B3) % 2**64
        assert int(got) == want


def test_content_hash_of_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a")], "doc_id long, text string")
    assert dict(X.content_hashes(df).collect()) == {1: "cbf29ce484222325", 2: "cbf29ce484222325", 3: "af63dc4c8601ec8c"}
    assert X.content_hashes(df.limit(0)).count() == 0


def test_links(spark):
    df = spark.createDataFrame([("[[a b::repo@c0ffee#Top^^b1:f]]",), ("[[x]]",), ("no",), ("[[]]",)], "t string")
    out = [r[0] for r in df.select(X.parse_link(F.col("t"))).collect()]
    assert out[0].asDict() == {"target": "a b", "repo": "repo", "pin": "c0ffee", "anchor": "Top", "mode": "^^", "block": "b1", "field": "f"}
    assert df.select(X.parse_link(F.lit("[[a@b#c: d]]"))).first()[0].asDict() == {"target": "a@b", "repo": "", "pin": "", "anchor": "c: d", "mode": "", "block": "", "field": ""}
    assert out[1].target == "x" and out[2] is None and out[3] is None


def test_sections_and_columns(spark):
    df = spark.createDataFrame([("p", "# A\n## B\ntext é\n### C\n## D\n# E")], "path string, body string")
    out = {r.text: r.section for r in X.headings(df).collect()}
    assert out == {"A": "A", "B": "A / B", "C": "A / B / C", "D": "A / D", "E": "E"}
    at = df.select(X.line_column(F.col("body"), F.lit(len("# A\n## B\ntext é".encode())))).first()[0]
    assert (at.line, at.column) == (3, 8)


@pytest.mark.parametrize(
    "text, kind",
    [("String", "scalar"), ("Number{>=0 & integer}", "scalar"), ("[a, b]", "enum"), ("X[2..4]", "list"), ("X[+]", "list"), ("(Number, String)", "tuple"), ("T*", "reference"), ("T&", "inline_or_reference"), ("T*@", "reference"), ("<A | B>*", "reference"), ("<A & B>", "intersection"), ("type<T>*", "def_reference"), ("any", "any"), ("opaque", "opaque")],
)
def test_shapes(text, kind):
    assert G.parse_shape(text).kind == kind
    assert G.canonical(G.parse_shape(text)) == G.canonical(G.parse_shape(f"  {text} "))


@pytest.mark.parametrize("text", ["", "[", "X[", "<A | B & C>", "Number{>=}", "T@", "String{/(/}", "A B"])
def test_bad_shapes(text):
    with pytest.raises(G.ShapeError):
        G.parse_shape(text)


def test_conformance():
    ok = lambda v, s: G.conforms(v, G.parse_shape(s))
    assert ok(3, "Number{>=0 & integer}") and not ok(-1, "Number{>=0}") and not ok(float("nan"), "Number") and not ok(True, "Number")
    assert ok(["a"], "[a, b][1..2]") and not ok(["c"], "[a, b][]") and not ok([], "String[+]")
    assert ok("[[x]]", "T*") and not ok({}, "T*") and ok({}, "T&") and ok("(1, 2)", "(Number, Number)") and not ok("(1)", "(Number, Number)")
    assert ok("2024-02-29", "Date") and not ok("2024-13-01", "Date") and ok("https://a.b/c", "Url") and not ok("a.b", "Url")
    assert ok("[[x@c0ffee]]", "T*@") and not ok("[[x]]", "T*@") and ok(1, "<Number | String>") and not ok(1, "<Number & String>")
    assert G.unsatisfiable(G.parse_shape("Number{5..2}")) and not G.unsatisfiable(G.parse_shape("Number{1..2}"))
    assert G.type_names(G.parse_shape("<A | B[]>*")) == {"A", "B"}
    assert G.recognize_constructor("meter(5, (a, b))") == ("meter", ["5", "(a, b)"])
