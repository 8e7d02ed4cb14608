"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than 1/SHARE of all rows, so there are fewer than SHARE hot keys; a key of fewer
#: than FLOOR rows (LIGHT_FLOOR where rows hold a few numbers) is no burden to a task.
SHARE, FLOOR, LIGHT_FLOOR, SALTS = 4096, 256, 100_000, 64

#: Bytes, as Spark guesses them from the files read, that a task of slow work for each row gets at least.
DEALT = 16 << 10


def guessed_bytes(df: DataFrame) -> int:
    """Spark's guess of the table's size: that of the files read, changed by the columns that come and go."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def dealt(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as a shuffle has, for slow work on each row: a small file of many rows is one task otherwise."""
    spark = df.sparkSession
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(max(1, min(most, guessed_bytes(df) // DEALT)))


def hot_keys(counts: DataFrame, keys: list[str], floor: int | None = None) -> list[tuple]:
    """The hot keys of a table of row counts (keys, n): fewer than ``SHARE`` of them, whatever the table's size."""
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    least = max(FLOOR if floor is None else floor, (total or 0) / SHARE)
    return [tuple(r) for r in counts.where(F.col("n") > least).select(*keys).collect()] if (most or 0) > least else []


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], hot: list[tuple], by: list[str], how: str = "inner") -> DataFrame:
    """``big.join(small, keys, how)`` with each hot key dealt over ``SALTS`` tasks.

    Rows of ``big`` with a hot key are dealt by a hash of their columns ``by``; the matching rows of
    ``small`` are repeated for each salt. ``how`` keeps rows of ``big`` only (inner, left, left_semi, left_anti).
    """
    if not hot:
        return big.join(small, keys, how)
    types = {f.name: f.dataType for f in small.schema}
    schema = ", ".join(f"{k} {types[k].simpleString()}" for k in keys)
    marks = F.broadcast(big.sparkSession.createDataFrame(hot, schema).withColumn("__hot", F.lit(True)))  # under SHARE rows
    salt: Column = F.when(F.col("__hot"), F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(0)
    left = big.join(marks, keys, "left").withColumn("__salt", salt).drop("__hot")
    each = F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    right = small.join(marks, keys, "left").withColumn("__salt", each).drop("__hot")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def dealt_by(df: DataFrame, key: str, share: int = 1 << 20) -> DataFrame:
    """``df`` by ``key`` over tasks of ``share`` guessed bytes: a number that Spark doesn't lessen when the shuffled rows compress well."""
    return df.repartition(1 + guessed_bytes(df) // share, key)
