"""Benchmark decontamination: an FM-index for each shard of training documents.

A shard is a run of documents of about ``SHARD_BYTES`` in a task. Its sequence of words, as symbols
of the benchmark's vocabulary, goes into an FM-index; a word outside the vocabulary can't be part of
an occurrence, so it ends a run, and runs shorter than the shortest phrase are left out (exact). All
phrases are searched backwards at once, their occurrences located by sampled suffix positions and
the spans merged. Nothing is shuffled; each document is read once.

The benchmark is the stated query set. It is collected in blocks of ``BLOCK_CHARS`` (as many blocks
as it takes; item groups by hash), and a task holds one block at a time: with several, it holds the words
of about ``HELD_BYTES`` of text, and each block is read once for all their shards.

Null texts and texts without words: no words, no hits, ``n_items`` 0. An item with a null id or
without words has no phrases. Equal items count by their distinct ids. Empty tables give no rows or
no hits. Very long texts are indexed whole, as shards of their own. Null ids don't matter. Words are compared
by 64-bit hashes. Columns with the names of the added ones are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeloom.llm import _text
from typeloom.llm.fm_index import FMIndex

SHARD_BYTES, BLOCK_CHARS, HELD_BYTES = 2 << 20, 32 << 20, 64 << 20
ADDED = "n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:long,end:long>>"


class Phrases:
    """Distinct windows of ``width`` words over a block of items."""

    def __init__(self, rows: list[tuple[int, str]], width: int):
        data, offs = _text.utf8(pa.array([t for _, t in rows], pa.string()))
        starts, ends, woffs = _text.spans(data, offs, _text.ALNUM)
        h = _text.hashes(data, starts, ends)
        self.names = sorted({str(k) for k, _ in rows})
        name = np.array([np.searchsorted(self.names, str(k)) for k, _ in rows], np.int64)
        self.vocabulary, symbol = np.unique(h, return_inverse=True)
        n = np.diff(woffs)
        count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
        item = np.repeat(np.arange(len(rows)), count)
        at = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count) + woffs[:-1][item]
        size = np.minimum(n[item], width)
        table = np.zeros((len(item), width + 1), np.int64)
        for j in range(width):
            ok = size > j
            table[ok, j] = symbol[at[ok] + j] + 1
        table[:, width] = size
        found, which = np.unique(table, axis=0, return_inverse=True) if len(table) else (table, np.zeros(0, np.int64))
        self.patterns, self.lengths = found[:, :width], found[:, width]
        pair = np.unique(which.reshape(-1) * max(len(self.names), 1) + name[item])
        self.item = pair % max(len(self.names), 1)
        self.item_offs = np.searchsorted(pair // max(len(self.names), 1), np.arange(len(found) + 1))
        self.shortest = int(self.lengths.min(initial=width))


def find(h: np.ndarray, woffs: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Changes of the cover count at each word, and (document, item) pairs."""
    change, none = np.zeros(len(h) + 1, np.int64), np.zeros(0, np.int64)
    if not len(h) or not len(phrases.lengths):
        return change, none, none
    at = np.minimum(np.searchsorted(phrases.vocabulary, h), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[at] == h
    first, last = known.copy(), known.copy()
    first[1:] &= ~known[:-1]
    last[:-1] &= ~known[1:]
    edge = woffs[1:-1]
    edge = edge[(edge > 0) & (edge < len(h))]
    first[edge], last[edge - 1] = known[edge], known[edge - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = end - begin >= phrases.shortest
    begin, end = begin[long], end[long]
    if not len(begin):
        return change, none, none
    size = end - begin
    offs = np.concatenate([[0], np.cumsum(size)])
    word = np.arange(offs[-1]) - np.repeat(offs[:-1] - begin, size)
    index = FMIndex(at[word] + 1, offs, len(phrases.vocabulary))
    lo, hi = index.search(phrases.patterns, phrases.lengths)
    which = np.repeat(np.arange(len(lo)), hi - lo)
    rows = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[which]
    start = word[index.locate(rows)]
    np.add.at(change, start, 1)
    np.add.at(change, start + phrases.lengths[which], -1)
    doc = np.searchsorted(woffs, start, "right") - 1
    n = phrases.item_offs[which + 1] - phrases.item_offs[which]
    pair = np.repeat(doc, n) * len(phrases.names) + phrases.item[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(phrases.item_offs[which], n)]
    pair = np.unique(pair)
    return change, pair // len(phrases.names), pair % len(phrases.names)


def phrase_blocks(benchmark: DataFrame, width: int, block_chars: int = BLOCK_CHARS) -> list:
    """Broadcast phrase tables, each of about ``block_chars`` of item text."""
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // block_chars)
    out = []
    for b in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b) if n > 1 else items
        out.append(benchmark.sparkSession.sparkContext.broadcast(Phrases(sorted((r.item_id, r.text) for r in part.collect()), width)))
    return out


def mark(docs: DataFrame, benchmark: DataFrame, width: int = 8, block_chars: int = BLOCK_CHARS, cut: bool = False) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items (sorted ids) and spans (merged; UTF-8 byte offsets).

    With ``cut`` the spans are removed from ``text``.
    """
    blocks = phrase_blocks(benchmark, width, block_chars)
    added = T._parse_datatype_string(ADDED)
    kept = [f for f in docs.schema if f.name not in added.names]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *added])
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def words(batches):
        """Shards (rows, bytes, document offsets, word starts, ends, offsets and hashes) in lists of about HELD_BYTES."""
        held, size = [], 0
        for batch in batches:
            data, offs = _text.utf8(batch.column("text"))
            for i, j in _text.slices(offs, SHARD_BYTES):
                own, at = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                starts, ends, woffs = _text.spans(own, at, _text.ALNUM)
                held.append((batch.slice(i, j - i), at, starts, ends, woffs, _text.hashes(own, starts, ends)))
                size += len(own)
                if len(blocks) == 1 or size >= HELD_BYTES:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    @_text.releasing
    def task(batches):
        for held in words(batches):
            changes = [np.zeros(len(h) + 1, np.int64) for *_, h in held]
            found = [[set() for _ in range(rest.num_rows)] for rest, *_ in held]
            for block in blocks:
                phrases = block.value
                for k, (_, _, _, _, woffs, h) in enumerate(held):
                    more, doc, item = find(h, woffs, phrases)
                    changes[k] += more
                    for d, name in zip(doc.tolist(), item.tolist()):
                        found[k][d].add(phrases.names[name])
                if len(blocks) > 1:  # one block in memory at a time; it is read again from the worker's file
                    del phrases, block._value
            for (rest, at, starts, ends, woffs, h), change, own_found in zip(held, changes, found):
                hit = np.cumsum(change)[:-1] > 0
                total = np.concatenate([[0], np.cumsum(hit)])
                first, last = hit.copy(), hit.copy()
                first[1:] &= ~hit[:-1]
                last[:-1] &= ~hit[1:]
                edge = woffs[1:-1]
                edge = edge[(edge > 0) & (edge < len(h))]
                first[edge], last[edge - 1] = hit[edge], hit[edge - 1]
                a, b = np.flatnonzero(first), np.flatnonzero(last)
                base = at[np.searchsorted(woffs, a, "right") - 1]
                spans = pa.StructArray.from_arrays([pa.array(starts[a] - base), pa.array(ends[b] - base)], ["start", "end"])
                items = [sorted(x) for x in own_found]
                columns = [
                    pa.array(np.diff(woffs).astype(np.int64)),
                    pa.array((total[woffs[1:]] - total[woffs[:-1]]).astype(np.int64)),
                    pa.array([len(x) for x in items], pa.int64()),
                    pa.array(items, pa.list_(pa.string())),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(a, woffs).astype(np.int32)), spans).cast(pairs),
                ]
                own_columns = {n: rest.column(n) for n in names}
                if cut and len(a):
                    texts = zip(own_columns["text"].to_pylist(), columns[-1].to_pylist())
                    own_columns["text"] = pa.array([remove_spans(t, s) for t, s in texts], own_columns["text"].type)
                yield pa.RecordBatch.from_arrays([*own_columns.values(), *columns], [*names, *added.names])

    return docs.mapInArrow(task, schema)


def remove_spans(text: str | None, spans) -> str | None:
    """The text without the (merged, sorted) byte spans."""
    if not text or not len(spans):
        return text
    data, out, at = text.encode(), [], 0
    for s in spans:
        out.append(data[at : s["start"]])
        at = s["end"]
    return b"".join([*out, data[at:]]).decode()


def op8_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_items") >= 2).alias("contaminated"))


def oracle() -> str:
    """DuckDB SQL of op8's result."""
    return r"""
with dw as (
  select doc_id, row_number() over () as rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bw as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null and text is not null),
win as (
  select distinct item_id, least(len(w), 8) as n, array_to_string(w[i:i + 7], ' ') as phrase
  from (select item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) as i from bw where len(w) > 0)),
sizes as (select distinct n from win),
spots as (
  select rid, n, i, array_to_string(w[i:i + n - 1], ' ') as phrase
  from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, sizes where len(w) >= n)),
occ as (select distinct s.rid, s.i, s.n, w.item_id from spots s join win w on s.n = w.n and s.phrase = w.phrase),
hits as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from occ) group by rid),
its as (select rid, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as names from occ group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from dw left join hits using (rid) left join its using (rid)"""
