"""Every link of a note, with position and all parts."""

from typeloom.plans import registry


def test_all_links(spark):
    notes = spark.createDataFrame([("p", "See [[a b::repo@c0ffee#Top^^b1:f]] and\n[[x]], not [[]], [[y^b2]]"), ("q", "none"), ("r", None)], "path string, body string")
    out = sorted(tuple(r) for r in registry.wikilinks(notes).collect())
    assert out == [("p", 0, "a b", "repo", "c0ffee", "Top", "^^", "b1", "f"), ("p", 1, "x", "", "", "", "", "", ""), ("p", 2, "y", "", "", "", "^", "b2", "")]
    assert "wikilinks" in registry.queries()
