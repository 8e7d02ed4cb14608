"""Consistent-hash ring with virtual nodes and bounded loads.

Keys are texts (equal texts lie together as far as capacity allows). The ring has ``2**RING_BITS``
cells; a text's digest gives its cell, and each shard owns ``NODES`` points of the ring. A cell goes to
the first shard clockwise that has room for it; a shard has room for ``1 + SLACK`` times the mean
bytes. So the law is ``bytes``: no shard exceeds the mean by more than the slack and one cell.

A cell with more than ``1/HOT`` of all bytes or of all rows (there are under 2 * HOT of those), such as a
group of copies, is split into ``2**SPLIT_BITS`` parts by document id; a part that is still that large, as
one of rows without ids, is split once more by the row's number in the written table of sizes. The driver places
cells, never rows: it holds at most 2**RING_BITS + 4 * HOT * 2**SPLIT_BITS sums. ``slot`` counts rows within
a shard: a cell's offset, from the sums, plus the row's number in its cell.

A null text is empty and of size 1. Null and repeated doc_ids are rows like any other; rows that are
equal in doc_id and text are interchangeable. Very long texts are one row of their size; a shard can then
exceed the law's bound by that text. Only ``doc_id`` and ``text`` are read. An empty table gives no rows.
``shards`` may exceed the rows; then some stay empty.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from typeloom.plans.shared import written

RING_BITS, SPLIT_BITS, HOT, NODES, SLACK = 16, 8, 512, 256, 0.001


def ring(shards: int, nodes: int = NODES) -> tuple[list[int], list[int]]:
    """Points of the ring, rising, and their shards; a shard's points don't depend on how many shards there are."""
    point = lambda s, k: int.from_bytes(hashlib.sha256(f"shard {s} node {k}".encode()).digest()[:8], "big")
    pairs = sorted((point(s, k), s) for s in range(shards) for k in range(nodes))
    return [p for p, _ in pairs], [s for _, s in pairs]


def place(cells: list[tuple[int, int, int]], shards: int, slack: float = SLACK) -> dict[int, int]:
    """Shard of each cell (cell, place on the ring in 64 bits, bytes); greatest cells first."""
    points, owners = ring(shards)
    room = np.full(shards, (1 + slack) * sum(b for *_, b in cells) / shards)
    out = {}
    for cell, at, size in sorted(cells, key=lambda c: (-c[2], c[0])):
        i = bisect.bisect_left(points, at) % len(points)
        asked: set[int] = set()
        while len(asked) < shards:
            s = owners[i]
            if s not in asked:
                if room[s] >= size:
                    break
                asked.add(s)
            i = (i + 1) % len(points)
        else:  # nowhere fits whole: the emptiest takes it
            s = int(np.argmax(room))
        out[cell] = s
        room[s] -= size
    return out


def _sums(rows: DataFrame) -> list:
    return rows.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()


def assign(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    top = F.shiftrightunsigned(F.xxhash64(text, F.lit("ring")), 64 - RING_BITS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), top.alias("cell"))
    rows = written(rows.withColumn("number", F.monotonically_increasing_id()), "sizes")
    sums = _sums(rows)
    total, count = sum(r.bytes for r in sums), sum(r.n for r in sums)
    parts = {r.cell: r for r in sums}
    for by in ("doc_id", "number"):  # a cell's number grows by SPLIT_BITS at each split
        hot = sorted(c for c, r in parts.items() if (r.bytes * HOT > total or r.n * HOT > count) and r.n > 1)
        part = F.shiftrightunsigned(F.xxhash64(by, F.lit("split")), 64 - SPLIT_BITS)
        is_hot = F.col("cell").isin(hot) if hot else F.lit(False)
        rows = rows.withColumn("cell", F.col("cell") * (1 << SPLIT_BITS) + F.when(is_hot, part).otherwise(F.lit(0)))
        split = _sums(rows.where(F.shiftright("cell", SPLIT_BITS).isin(hot))) if hot else []
        parts = {c << SPLIT_BITS: r for c, r in parts.items() if c not in set(hot)} | {r.cell: r for r in split}
        wide = set(hot) if by == "doc_id" else {*(c << SPLIT_BITS for c in wide), *hot}
    # a split cell's parts lie anywhere on the ring, or they would all meet the same shard
    split_cells = {c for c in parts if c >> SPLIT_BITS in wide or c >> 2 * SPLIT_BITS << SPLIT_BITS in wide}
    spread = lambda c: int.from_bytes(hashlib.sha256(str(c).encode()).digest()[:8], "big")
    homes = place([(c, spread(c) if c in split_cells else (c >> 2 * SPLIT_BITS) << (64 - RING_BITS), r.bytes) for c, r in parts.items()], shards)
    seen, table = [0] * shards, []
    for c, r in sorted(parts.items()):
        table.append((c, homes[c], seen[homes[c]]))
        seen[homes[c]] += r.n
    cells = spark.createDataFrame(table or [(0, 0, 0)], "cell long, shard int, before long")  # bounded as said above
    place_in = F.row_number().over(Window.partitionBy("cell").orderBy("text_crc32", "doc_id", "size", "number"))
    placed = rows.withColumn("place", place_in).join(F.broadcast(cells), "cell")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
