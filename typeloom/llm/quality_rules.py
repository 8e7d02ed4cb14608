"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Base counts come first (one projection). Then come the rules of ``RULES``, each a rejecting condition
on the base counts or on the text. On a sample of about ``SAMPLE`` documents each rule's share of
rejections is taken and its cost measured: every sampled row is judged once, and then so often in one job
that the rule itself takes ``LEAST_SECONDS`` or more, or ``MOST`` times; the difference by rows and repetitions is the
cost, rounded to a power of two, so that noise seldom alters the order. The cascade asks the rules in
falling order of rejections per cost, and
a document that one rule rejects is not asked further (nested CASE). The order never alters
``kept``: a document is kept if no rule rejects it.
``rejected_by`` names the rule that was asked
first of those that reject.

Null and empty texts have no words, all counts 0 and fail the base. Ties, repeated rows and null ids
don't matter: each row is judged alone. Very long texts are counted whole; a text's words, windows and lines
are arrays in one row while it is judged. Empty tables give no rows. :func:`judge` replaces columns
that have the names of the added ones.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.plans.shared import drop_written, written

SPACE, SAMPLE, LEAST_SECONDS, MOST = r"[\x20\x09-\x0D]", 1000, 0.2, 512
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts and ``base_failed``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("__w", F.array_remove(F.split(text, SPACE + "+"), ""))
    out = out.withColumn("n_words", F.size("__w").cast("long"))
    w, n = F.col("__w"), F.col("n_words").cast("int")
    windows = F.slice(F.arrays_zip(F.arrays_zip(w, F.slice(w, 2, n), F.slice(w, 3, n)), F.sequence(F.lit(0), n - 1)), F.lit(1), n - 2)
    out = out.withColumn("__s", F.when(n >= 3, F.sort_array(windows)))
    s = F.col("__s")
    # neighbours in the sorted windows that are equal; their places, rising, cover up to three new words each
    equal = F.filter(F.arrays_zip(s, F.slice(s, 2, n)), lambda p: p["__s"]["0"] == p["1"]["0"])
    out = out.withColumn("__p", F.sort_array(F.array_distinct(F.flatten(F.transform(equal, lambda p: F.array(p["__s"]["1"], p["1"]["1"]))))))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate("__p", start, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("__l", lines)
    out = out.withColumns(
        {
            "word_chars": F.length(F.array_join("__w", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    ).drop("__w", "__s", "__p", "__l")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


#: Rejecting conditions; every one holds for a text with 50 words or more.
RULES: dict[str, Callable[[], Column]] = {
    "symbols": lambda: 10 * F.col("n_symbols") > 3 * F.col("n_words"),
    "duplicate_lines": lambda: (F.col("n_dup_lines") >= 4) & (10 * F.col("n_dup_lines") > 3 * F.regexp_count(F.col("text"), F.lit("\n")) + 3),
    "word_length": lambda: ~((F.col("word_chars") >= 2 * F.col("n_words")) & (F.col("word_chars") <= 20 * F.col("n_words"))),
    "exclamations": lambda: 10 * F.regexp_count(F.col("text"), F.lit("!")) > 3 * F.col("n_words"),
    "capitals": lambda: 2 * F.regexp_count(F.col("text"), F.lit("[A-Z]")) > F.col("word_chars"),
    "digits": lambda: 5 * F.regexp_count(F.col("text"), F.lit("[0-9]")) > F.col("word_chars"),
    "sentences": lambda: 100 * F.regexp_count(F.col("text"), F.lit(r"[.!?]")) < F.col("n_words"),
}


def measure(part: DataFrame, rule: Column, rows: int) -> tuple[int, float]:
    """(rows that the rule rejects, seconds a row) over a small written table."""

    def run(times: int) -> tuple[int, float]:
        # the rule is asked anew for each repetition of a row, as it names the repetition
        asked = part.withColumn("__again", F.explode(F.sequence(F.lit(1), F.lit(times))))
        began = time.perf_counter()
        hit = asked.agg(F.count_if(rule & (F.col("__again") > 0)).alias("k")).first().k
        return hit // times, time.perf_counter() - began

    run(1)
    hit, once = run(1)
    times, cost = 4, 0.0
    while True:
        spent = run(times)[1] - once
        cost = max(spent, 1e-6) / (max(rows, 1) * (times - 1))
        if spent >= LEAST_SECONDS or times >= MOST:
            return hit, cost
        times = min(MOST, times * 8)


def cascade_order(docs: DataFrame, rules: dict[str, Callable[[], Column]] = RULES, sample: int = SAMPLE) -> list[tuple[str, float, float]]:
    """(rule, share it rejects, seconds a row in powers of two) by falling rejections per second on the sample.

    The sample of ``docs`` is drawn over the whole table and bounded by ``sample``; of it, the rows
    that pass the base count. Its base counts are written first: a filter on them would be pushed below
    their projections and compute them again for each mention.
    """
    total = docs.count()
    drawn = docs.sample(min(1.0, sample / max(total, 1)), 11) if total > sample else docs
    counts = written(base_counts(drawn.select("text")), "quality-sample")
    part = counts.where("not base_failed")
    n, out = part.count(), []
    for name, rule in rules.items():
        hit, cost = measure(part, rule(), n)
        out.append((name, hit / max(n, 1), 2.0 ** round(math.log2(cost))))
    drop_written(counts)
    return sorted(out, key=lambda x: (-x[1] / x[2], x[2], x[0]))


def judge(docs: DataFrame, rules: dict[str, Callable[[], Column]] = RULES) -> DataFrame:
    """``docs`` with base counts, base_failed, rejected_by and kept."""
    counted = base_counts(docs)
    first = F.when(F.col("base_failed"), F.lit("base"))
    for name, _, _ in cascade_order(docs, rules):
        first = first.when(rules[name](), F.lit(name))
    return counted.withColumn("rejected_by", first).withColumn("kept", F.col("rejected_by").isNull())


def op2_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", *COUNTS, "base_failed", "kept")


def oracle() -> str:
    """DuckDB SQL of op2's result."""
    return r"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents),
win as (select rid, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from (select rid, w, unnest(range(1, len(w) - 1)) as i from d)),
rep as (select rid, i from (select rid, i, count(*) over (partition by rid, a, b, c) as n from win) where n > 1),
cov as (select rid, count(distinct p) as n from (select rid, unnest(range(i, i + 3)) as p from rep) group by rid),
base as (
  select doc_id, text, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
    cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, coalesce(cov.n, 0) as n_repeat_words
  from d left join cov using (rid)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed
    or 10 * n_symbols > 3 * n_words
    or n_dup_lines >= 4 and 10 * n_dup_lines > 3 * len(regexp_extract_all(text, chr(10))) + 3
    or not (word_chars >= 2 * n_words and word_chars <= 20 * n_words)
    or 10 * len(regexp_extract_all(text, '!')) > 3 * n_words
    or 2 * len(regexp_extract_all(text, '[A-Z]')) > word_chars
    or 5 * len(regexp_extract_all(text, '[0-9]')) > word_chars
    or 100 * len(regexp_extract_all(text, '[.!?]')) < n_words) as kept
from b"""
