"""Best-fit decreasing packing of token pieces into sequences.

Piece lengths are integers up to the sequence length, so the bins that best-fit decreasing opens are
fixed by how many pieces have each length. Executors tokenise, cut and count; the driver packs the
counts (never documents) with a segment tree over remaining capacities and gives back ranges: "of the
pieces of length s, numbers i to j go to the bins from b on, q to a bin, at this offset". Each piece
then finds its place from its number among the pieces of its length. The result is that of packing
piece by piece, at any size of the corpus; what the driver holds depends on the sequence length only.

Null texts are empty (their only id is the end id). Rows with equal or null ``doc_id`` are packed each
for itself. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from typeloom.llm import _text, _tokens
from typeloom.plans.shared import written

PIECES = "part int, number long, doc_id long, piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """Segment tree over remaining capacities 0..size: which of them have an open bin."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = bytearray(2 * self.leaves)

    def put(self, at: int, some: bool) -> None:
        at += self.leaves
        self.any[at] = some
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, least: int) -> int:
        """The smallest capacity of at least ``least`` that has a bin, or -1; in logarithmic time."""
        at = least + self.leaves
        if self.any[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1


def plan(counts: dict[int, int], size: int) -> np.ndarray:
    """Best-fit decreasing over ``counts`` (pieces of each length).

    Rows: length, first piece number, first bin, pieces a bin, offset of the first piece in a bin.
    """
    tree, bins, rows, opened = CapacityTree(size), {}, [], 0

    def add(capacity: int, a: int, b: int) -> None:
        if b > a and capacity:
            bins.setdefault(capacity, deque()).append((a, b))
            tree.put(capacity, True)

    for s in sorted((k for k, n in counts.items() if n), reverse=True):
        done, n = 0, counts[s]
        while done < n:
            r = tree.tightest(s)
            if r < 0:
                r, a, b = size, opened, opened + -(-(n - done) // (size // s))
                opened = b
            else:
                a, b = bins[r].popleft()
                if not bins[r]:
                    del bins[r]
                    tree.put(r, False)
            q, left = r // s, n - done
            full = min(b - a, left // q)
            if full:
                rows.append((s, done, a, q, size - r))
                add(r - q * s, a, a + full)
                done, a, left = done + full * q, a + full, left - full * q
            if a < b and 0 < left < q:  # the last bin takes what is left
                rows.append((s, done, a, left, size - r))
                add(r - left * s, a, a + 1)
                done, a = n, a + 1
            if a < b:
                bins.setdefault(r, deque()).appendleft((a, b))
                tree.put(r, True)
    return np.array(rows, np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, size: int = 2048, end_id: int = 0, path: str | None = None) -> DataFrame:
    """A row for each piece, numbered within its task and length."""

    @_text.releasing
    def cut(batches):
        enc, part, seen = _tokens.pieces(path), TaskContext.get().partitionId(), {}
        tail, width = enc.pack([end_id]), enc.kind.itemsize
        for batch in batches:
            data, offs = _text.utf8(batch.column("text"))
            rows = []
            for key, a, b in zip(batch.column("doc_id").to_pylist(), offs[:-1].tolist(), offs[1:].tolist()):
                ids = enc.wide(enc.encode(data[a:b].tobytes()) + tail)
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[at : at + 4 * size]
                    n = len(own) // 4
                    rows.append((part, seen.get(n, 0), key, k, at // 4, n, zlib.crc32(own)))
                    seen[n] = seen.get(n, 0) + 1
            if rows:
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in PIECES.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, size: int = 2048, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``: as few sequences as best-fit decreasing makes."""
    cut = written(pieces(docs, size, end_id, path), "pieces")
    each = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    own = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = each.select("length", "part", F.coalesce(F.sum("n").over(own), F.lit(0)).alias("before"))
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = plan(counts, size)

    def place(batches):
        # rows are ordered by length, falling, and piece number: one sorted key finds a piece's range
        span = int(table[:, 1].max(initial=0)) + 2
        keys = (size - table[:, 0]) * span + table[:, 1]
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy() + batch.column("before").to_numpy()
            row = table[np.searchsorted(keys, (size - length) * span + np.minimum(number, span - 1), "right") - 1]
            rank = number - row[:, 1]
            where = [pa.array(row[:, 2] + rank // row[:, 3]), pa.array(row[:, 4] + rank % row[:, 3] * length)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), *where], [*names, "sequence_id", "offset"])

    joined = cut.join(base, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", "number", "before")
    return joined.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
