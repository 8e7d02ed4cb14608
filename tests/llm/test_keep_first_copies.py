"""One row of each class stays, however many rows share the first's doc_id and text."""

import collections

from typeloom.llm import near_dedup


def test_copies_of_the_first(spark):
    rows = [(None, "a b c", "x")] * 20 + [(None, "g h i", "y"), (3, "d e f", "z"), (None, "d e f", "w"), (None, None, "n"), (None, None, "n"), (5, None, "m")]
    rows += [(1, "j k l", "q")] * 30 + [(1, "m n o", "q")] + [(2, "", "e"), (2, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = near_dedup.keep_first(df)
    assert out.columns == df.columns
    got = collections.Counter(tuple(r) for r in out.collect())
    want = [(None, "a b c", "x"), (None, "g h i", "y"), (3, "d e f", "z"), (1, "j k l", "q"), (1, "m n o", "q"), (None, None, "n"), (None, None, "n"), (5, None, "m"), (2, "", "e")]
    assert got == collections.Counter(want)
