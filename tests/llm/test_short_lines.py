"""Templates of a leaf, short lines and rows without an id in the line dedup."""

from tests.llm import brute
from typeloom.llm import line_dedup

NAMES = ["Alice", "Bob", "Carl", "Dora", "Emil", "Fay", "Gus"]
DAYS = ["Monday", "Tuesday", "Friday"]


def kept(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(df).collect()}


def test_short_lines(spark):
    rows = [(k, f"click here now\nown{chr(97 + k)}\npage {k}\n\nAll  rights." + "\nOften\nOften" * (k == 3)) for k in range(6)]
    got = kept(spark, rows)
    assert got == brute.line_dedup(rows)
    assert sum("click here now" in t for t in got.values()) == sum("All  rights." in t for t in got.values()) == 1
    assert all(f"page {k}" in got[k].split("\n") for k in got) and got[3].count("Often") == 2


def test_variable_words_in_a_leaf(spark):
    rows = [(1, "Posted by Alice on Monday"), (2, "Posted by Bob on Tuesday"), (3, "x y z"), (4, "Posted by the sea we sat")]
    got = kept(spark, rows)
    assert got == brute.line_dedup(rows) == {1: rows[0][1], 2: "", 3: "x y z", 4: rows[3][1]}


def test_values_that_recur_stay_variable(spark):
    """Names and days come back in other pairs; a second template shares the leaf."""
    rows = [(k, f"Posted by {NAMES[k % 7]} on {DAYS[k % 3]} at noon\nPosted by {NAMES[k % 7]} with {'xyzuvw'[k % 6]} in {k}\nown line number {'abcdefghijklmnopqrstuvwxyz'[k]} of its kind") for k in range(21)]
    got = kept(spark, rows)
    assert got == brute.line_dedup(rows)
    assert sum("Posted by" in t and " on " in t for t in got.values()) == 1


def test_hot_leaf(spark, monkeypatch):
    """A leaf with most of the lines is dealt over tasks and gives the same result."""
    from typeloom.plans import skew

    monkeypatch.setattr(skew, "FLOOR", 3)
    rows = [(k, f"session opened for user {NAMES[k % 7]}{'abc'[k % 3]} from {'pqrstuv'[k % 7]} today\nsame line in all of them") for k in range(40)] + [(50, "other words"), (51, "other words")]
    assert kept(spark, rows) == brute.line_dedup(rows)


def test_rows_without_id(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (None, "x\na b c d e"), (7, "a b c d e\ny")]
    out = sorted(r.text for r in line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    whole = [t for t in out if "a b c d e" in t]
    assert len(out) == 4 and "y" in out and (whole == ["a b c d e"] * 2 and "x" in out or whole == ["x\na b c d e"] and out.count("") == 2)


def test_very_long_texts(spark):
    line = "word " * 30_000
    rows = [(1, line + "\n" + "z" * 100_000), (2, line + "\n" + "z" * 100_000), (3, "\n" * 50_000)]
    assert kept(spark, rows) == brute.line_dedup(rows)
