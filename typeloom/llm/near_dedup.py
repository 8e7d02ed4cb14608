"""Near-duplicate classes by BagMinHash signatures over multisets of five-word shingles.

1. Signatures, one task pass over the texts. A shingle of weight w takes part in dyadic weight blocks
   [0,1), [1,2), [2,4), ... up to w. A block is a Poisson process keyed by shingle and block, of rate
   block width times signature size; each point goes to a random signature place and a random level of
   its block (its path down the block's hierarchy) and counts if the level lies under w. A place keeps
   its least point, so two documents agree in a place with a probability of exactly their weighted
   Jaccard similarity. Points come in rising order and a process stops beyond the greatest kept point,
   so a document costs about shingles + size * ln(size) points. All documents of a batch run at once.
2. Equal texts are one node (128-bit digest), whatever their number.
3. ``BANDS`` bands of ``ROWS`` places give buckets. In each bucket members are verified against one
   leader, never against each other; components of the verified links follow. Only members in
   different components of their bucket are still open. The next leader is the open bucket's member of
   most links, and a member meets ``LEADERS`` of them a round. After ``STARS`` rounds what is open is
   searched whole, in blocks of about ``BLOCK_BYTES`` of text: outsiders of each bucket's greatest
   component against the bucket's members. A pair of blocks is a row of its own, so one bucket spreads
   over as many tasks as it has block pairs; it is verified within its task, which gives one link for
   each outsider and component, never all pairs. Leader pairs whose signatures agree in under ``LEAST``
   of the places (four standard deviations below the threshold) aren't verified. So no link that the
   bands find is lost. Joins on a bucket or a leader deal hot ones over many tasks.
4. Verification is exact: sum of minima over sum of maxima of the shingle counts, 0.8 or more.

With 16 bands of 5 a pair of similarity 0.8 meets in a bucket with probability 0.998.

Result: a row for each input row with ``class_id``, the least ``doc_id`` of its class. Under five words
a text is one shingle; texts without words are near-duplicates only of each other; a null text is a
class of its own with ``class_id`` = ``doc_id``. Rows with equal or null ``doc_id`` are compared like
any other; a class without any ``doc_id`` has a null ``class_id``. Empty tables give no rows. Words are
``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Columns named ``class_id`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from typeloom.llm import _text
from typeloom.operators.components import connected_components
from typeloom.plans.shared import drop_written, free_shuffles, written
from typeloom.plans.skew import hot_keys, spread_join

WORDS, SIMILARITY = 5, 0.8
#: Places of a signature; the first BANDS * ROWS make bands, all of them estimate similarity.
BANDS, ROWS, PLACES = 16, 5, 128
STARS, LEADERS, LEAST, BLOCK_BYTES = 3, 3, 0.66, 512 << 10
SLICE_BYTES = 1 << 20


def bag_min_hash(shingle: np.ndarray, weight: np.ndarray, doc: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n x m, float64) of n documents from their distinct shingles and weights."""
    U = np.uint64
    sig = np.full((n, m), np.inf)
    top = int(weight.max(initial=1)).bit_length()
    streams = []
    for k in range(top + 1):  # block k: levels [2^(k-1), 2^k); block 0: [0, 1)
        least = 0 if k == 0 else 1 << (k - 1)
        has = weight > least if k else np.ones(len(weight), bool)
        if has.any():
            streams.append((shingle[has], doc[has], weight[has], np.full(int(has.sum()), k)))
    if not streams:
        return sig
    key, own, limit, block = (np.concatenate(x) for x in zip(*streams))
    key = _text.mix(key ^ (block.astype(U) + U(1)) * U(0x9FB21C651E98DF25))
    width = np.where(block == 0, 1, 1 << np.maximum(block - 1, 0))
    low = np.where(block == 0, 0, width)
    x, step = np.zeros(len(key)), 0
    bound = np.full(n, np.inf)
    while len(key):
        step += 1
        r = _text.mix(key + U(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        x = x - np.log(((r >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / (m * width)
        live = x < bound[own]
        if not live.all():
            key, own, limit, width, low, x, r = key[live], own[live], limit[live], width[live], low[live], x[live], r[live]
            if not len(key):
                break
        r = _text.mix(r ^ U(0xD6E8FEB86659FD93))
        place = ((r & U(0xFFFFFFFF)) * U(m) >> U(32)).astype(np.int64)
        level = low + ((r >> U(32)) % width.astype(U)).astype(np.int64)
        fits = level < limit
        np.minimum.at(sig, (own[fits], place[fits]), x[fits])
        bound = sig.max(axis=1)
    return sig


def bags(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document with counts: (hash, count, document), and the words' offsets."""
    starts, ends, woffs = _text.spans(data, offs, _text.NOT_SPACE)
    s, doc = _text.shingles(_text.hashes(data, starts, ends), woffs, WORDS)
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return s[at], np.diff(np.concatenate([at, [len(s)]])), doc[at], woffs


@_text.releasing
def _signed(batches):
    """(digest, o, bands, sketch) of (digest, o, text)."""
    for batch in batches:
        data, offs = _text.utf8(batch.column("text"))
        for i, j in _text.slices(offs, SLICE_BYTES):
            own, at = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            s, count, doc, woffs = bags(own, at)
            sig = bag_min_hash(s, count, doc, j - i, PLACES)
            bits = _text.mix(sig.view(np.uint64))
            rows = bits[:, : BANDS * ROWS].reshape(j - i, BANDS, ROWS)
            band = np.zeros((j - i, BANDS), np.uint64)
            for r in range(ROWS):
                band = _text.mix(band ^ rows[:, :, r])
            band = _text.mix(band + np.arange(1, BANDS + 1, dtype=np.uint64))
            sketch = (bits & np.uint64(255)).astype(np.uint8)
            some = np.diff(woffs) > 0
            lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * BANDS), pa.array(band.view(np.int64).reshape(-1)))
            lists = pa.array([x if ok else None for x, ok in zip(lists.to_pylist(), some)], pa.list_(pa.int64())) if not some.all() else lists
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest").slice(i, j - i), batch.column("o").slice(i, j - i), lists, pa.array([x.tobytes() for x in sketch], pa.binary())],
                ["digest", "o", "bands", "sketch"],
            )


@_text.releasing
def _similar(batches):
    """(a, b, similarity) of (a, b, text_a, text_b): the exact weighted Jaccard similarity."""
    for batch in batches:
        sides = [_text.utf8(batch.column(c)) for c in ("text_a", "text_b")]
        for i, j in _text.slices(sides[0][1] + sides[1][1], SLICE_BYTES):
            step = j - i
            data = np.concatenate([d[o[i] : o[j]] for d, o in sides])
            size = np.concatenate([np.diff(o[i : j + 1]) for _, o in sides])
            s, count, doc, _ = bags(data, np.concatenate([[0], np.cumsum(size)]))
            pair, side = doc % step, doc // step
            order = np.lexsort((side, s, pair))
            s, count, pair = s[order], count[order], pair[order]
            same = np.zeros(len(s), bool)
            if len(s):
                same[1:] = (s[1:] == s[:-1]) & (pair[1:] == pair[:-1])
            at = np.flatnonzero(same)
            both = np.bincount(pair[at], np.minimum(count[at], count[at - 1]), step)
            total = np.bincount(pair, count, step)
            part = batch.slice(i, step)
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(both / np.maximum(total - both, 1))], ["a", "b", "similarity"])


@_text.releasing
def _agreeing(batches):
    """Pairs (a, b) whose sketches agree in ``LEAST`` of the places or more."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PLACES) for c in ("sketch_a", "sketch_b"))
        ok = pa.array((x == y).sum(axis=1) >= LEAST * PLACES)
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("a", "b")], ["a", "b"])


def _linked_blocks(similarity: float):
    """Links (a, b) between two blocks' members of different components: one for each outsider and component it links to."""

    def opened(batch, col):
        flat = batch.column(col).flatten()
        component = np.frombuffer(b"".join(flat.field(1).to_pylist()), "V16")
        return flat.field(0).to_pylist(), component, bags(*_text.utf8(flat.field(2)))[:3]

    @_text.releasing
    def task(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                xd, xc, (xs, xn, xdoc) = opened(one, "outside")
                yd, yc, (ys, yn, ydoc) = opened(one, "inside")
                order = np.argsort(ys, kind="stable")
                ys, yn, ydoc = ys[order], yn[order], ydoc[order]
                size = np.bincount(ydoc, yn, len(yd))
                xo = np.searchsorted(xdoc, np.arange(len(xd) + 1))
                a, b = [], []
                for i in range(len(xd)):
                    s, n = xs[xo[i] : xo[i + 1]], xn[xo[i] : xo[i + 1]]
                    lo, hi = np.searchsorted(ys, s), np.searchsorted(ys, s, "right")
                    found = hi - lo
                    at = np.arange(found.sum()) - np.repeat(np.cumsum(found) - found - lo, found)
                    both = np.bincount(ydoc[at], np.minimum(yn[at], np.repeat(n, found)), len(yd))
                    near = np.flatnonzero((both / np.maximum(size + n.sum() - both, 1) >= similarity) & (yc != xc[i]))
                    for j in near[np.unique(yc[near].view("S16"), return_index=True)[1]]:
                        a.append(xd[i])
                        b.append(yd[j])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return task


NO_ID = (1 << 63) - 1


def _identity(docs: DataFrame) -> DataFrame:
    """(digest, o, text): o is doc_id, or the greatest long where that is null."""
    return docs.where(F.col("text").isNotNull()).select(F.unhex(F.md5("text")).alias("digest"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("o"), "text")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


class _Graph:
    """Nodes, buckets and what has been verified so far."""

    def __init__(self, docs: DataFrame, similarity: float):
        self.similarity = similarity
        texts = _identity(docs)
        self.signed = written(texts.mapInArrow(_signed, "digest binary, o long, bands array<long>, sketch binary"), "signatures")
        nodes = self.signed.groupBy("digest").agg(F.min("o").alias("o"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"), F.count("*").alias("n"))
        self.nodes = written(nodes, "nodes")
        bucket = self.nodes.where(F.col("bands").isNotNull()).select("digest", F.explode("bands").alias("key"))
        lead = written(bucket.groupBy("key").agg(F.min("digest").alias("lead"), F.count("*").alias("n")).where("n > 1"), "leads")
        self.hot = hot_keys(lead, ["key"])
        self.members = written(self.spread(bucket, lead.select("key", "lead")), "buckets")
        drop_written(lead)
        # equal texts are combined before the shuffle, so a group of copies is a row a task
        own = texts.groupBy("digest").agg(F.any_value("text").alias("text"))
        self.texts = written(own.join(self.members.select("digest").distinct(), "digest", "left_semi"), "texts")
        self.links = self.tried = None

    def spread(self, rows: DataFrame, by_key: DataFrame) -> DataFrame:
        """Rows of buckets joined with one row for each bucket."""
        return spread_join(rows, by_key, ["key"], self.hot, ["digest"])

    def verify(self, pairs: DataFrame) -> int:
        """Compare candidate pairs (a, b), a written table; how many new links there are."""
        each = pairs.select(F.explode(F.array("a", "b")).alias("digest")).groupBy("digest").agg(F.count("*").alias("n"))
        hot = hot_keys(each, ["digest"])
        sketches = self.nodes.select("digest", "sketch")
        for side, other in (("a", "b"), ("b", "a")):
            pairs = spread_join(pairs, sketches.withColumnsRenamed({"digest": side, "sketch": f"sketch_{side}"}), [side], hot, [other])
        close = pairs.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_agreeing, "a binary, b binary")
        for side, other in (("b", "a"), ("a", "b")):
            close = spread_join(close, self.texts.withColumnsRenamed({"digest": side, "text": f"text_{side}"}), [side], hot, [other])
        found = written(close.select("a", "b", "text_a", "text_b").mapInArrow(_similar, "a binary, b binary, similarity double"), "verified")
        links = found.where(F.col("similarity") >= self.similarity).select("a", "b")
        self.links = links if self.links is None else self.links.unionByName(links)
        return links.count()

    def labelled(self) -> DataFrame:
        """Members with their component and number of links, for buckets that several components share."""
        self.parts = connected_components(self.links)
        each = self.links.select(F.explode(F.array("a", "b")).alias("digest")).groupBy("digest").agg(F.count("*").alias("degree"))
        label = each.join(self.parts.withColumnRenamed("node", "digest"), "digest", "left")
        now = self.members.select("key", "digest").join(label, "digest", "left").select("key", "digest", F.coalesce("component", "digest").alias("component"), F.coalesce("degree", F.lit(0)).alias("degree"))
        now = written(now, "labelled")
        split = now.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
        left = written(self.spread(now, split), "open")
        drop_written(now)
        return left

    def fresh(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs that no round has tried; they count as tried from now on."""
        pairs = _ordered(pairs).distinct()
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        self.tried = pairs if self.tried is None else self.tried.unionByName(pairs)
        return pairs

    def run(self) -> DataFrame:
        """(node, component) of all nodes that have links."""
        first = self.members.where("digest <> lead").groupBy("digest").agg(F.min("lead").alias("a"))
        self.verify(self.fresh(first.select("a", F.col("digest").alias("b"))))
        for _ in range(STARS - 1):
            left = self.labelled()
            lead = left.groupBy("key").agg(F.max(F.struct("degree", "digest", "component")).alias("lead"))
            pairs = self.spread(left, lead).where("component <> lead.component")
            met = pairs.select("digest", "lead.degree", F.col("lead.digest").alias("b")).distinct()
            rank = F.row_number().over(Window.partitionBy("digest").orderBy(F.desc("degree"), "b"))
            pairs = met.withColumn("rank", rank).where(F.col("rank") <= LEADERS).select(F.col("digest").alias("a"), "b")
            found = self.verify(self.fresh(pairs))
            drop_written(left)
            free_shuffles(left.sparkSession)
            if not found:
                break
        found = self.search(self.labelled())
        if not found.isEmpty():
            self.links = self.links.unionByName(found)
            self.parts = connected_components(self.links)
        return self.parts

    def search(self, left: DataFrame) -> DataFrame:
        """Links (a, b) from outsiders of the open buckets' greatest components to the buckets' other members."""
        sizes = left.groupBy("key", "component").agg(F.count("*").alias("n"))
        great = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("great"))
        near = left.select("key", "digest", "component").join(self.texts, "digest")
        blocks = near.groupBy("key").agg(F.ceil(F.sum(F.octet_length("text") + 64) / BLOCK_BYTES).alias("blocks"))
        near = self.spread(near, great.join(blocks, "key")).withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")))
        member = F.struct("digest", "component", "text")
        inside = near.groupBy("key", "block").agg(F.collect_list(member).alias("inside"))
        outside = near.where("component <> great").groupBy("key", "block", "blocks").agg(F.collect_list(member).alias("outside"))
        pairs = outside.select("key", "outside", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).join(inside, ["key", "block"])
        found = pairs.select("outside", "inside").mapInArrow(_linked_blocks(self.similarity), "a binary, b binary")
        return written(_ordered(found).distinct(), "block-links")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(digest, o, class_o, class_digest) for each row with a text: its own identity and that of its class's first."""
    graph = _Graph(docs, similarity)
    parts = graph.run()
    named = parts.withColumnRenamed("node", "digest").join(graph.nodes.select("digest", "o"), "digest")
    first = named.groupBy("component").agg(F.min(F.struct("o", "digest")).alias("first"))
    linked = named.join(first, "component").select("digest", "first")
    alone = graph.nodes.select("digest", F.col("o").alias("no"))
    each = alone.join(linked, "digest", "left").select("digest", F.coalesce("first", F.struct(F.col("no").alias("o"), "digest")).alias("first"))
    copies = hot_keys(graph.nodes.select("digest", "n"), ["digest"])
    return spread_join(graph.signed.select("digest", "o"), each, ["digest"], copies, ["o"]).select("digest", "o", F.col("first.o").alias("class_o"), F.col("first.digest").alias("class_digest"))


def _doc_id(name: str):
    return F.when(F.col(name) < NO_ID, F.col(name))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) for each row of ``docs``."""
    own = classes(docs, similarity).select(_doc_id("o").alias("doc_id"), _doc_id("class_o").alias("class_id"))
    none = docs.where(F.col("text").isNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("doc_id").cast("long").alias("class_id"))
    return own.unionByName(none)


def keep_first(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each class, its first, and all rows without a text.

    Of rows that equal the first in text and in ``doc_id`` or its lack, the one with the least columns
    stays. They are combined before the shuffle, so a document with thousands of copies is a row a task.
    """
    first = classes(docs, similarity).select(F.col("class_o").alias("__o"), F.col("class_digest").alias("__digest")).distinct()
    o, digest = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.unhex(F.md5("text"))
    texts = docs.where(F.col("text").isNotNull()).select(o.alias("__o"), digest.alias("__digest"), F.struct(*docs.columns).alias("__row"))
    own = texts.groupBy("__o", "__digest").agg(F.min("__row").alias("__row"))
    kept = own.join(first, ["__o", "__digest"], "left_semi").select("__row.*")
    return kept.unionByName(docs.where(F.col("text").isNull()))


def op4_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
