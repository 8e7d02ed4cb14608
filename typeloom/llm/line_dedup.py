"""Lines that recur across documents, by a log-template tree of fixed depth.

Path of a line in the tree: its number of tokens, then its ``LEADING`` leading tokens; a token with a
digit is a variable field from the start. The leaf at the end of the path holds all distinct lines with
that path, and generalises them by how often a token stands at a place: in each leaf a token is a
constant of its place if lines of two documents or more have it there and it makes up a share of the
leaf's distinct lines; every other token is a variable field. ``SHARES`` has the shares asked for, so that
a leaf may hold up to 5 and up to 50 templates. A line's templates are

* its exact tokens,
* its tokens with digits made variable,
* for each share, its constants in the leaf,

the generalised ones only if ``CONSTANT`` of all tokens are constant, for the leaf's also at least one
behind the leading ones. The order of lines plays no part, and no leaf is ever collected: counts are
partial aggregates, a leaf's constants are bounded by its line length, and lines meet them by a join
that deals hot leaves over many tasks. Only lines of leaves with several lines and documents are cut into
tokens; a bit table of fixed size says beforehand which lines may be, the join says which are.

A template whose first and last document differ recurs. Its lines are dropped from every document but
the first, so that one document still has the line. Keys have 96 bits and decide alone.

Null and empty texts stay as they are, with no lines dropped. Rows with equal ``doc_id`` are one
document, and so are rows without ``doc_id`` that have equal texts: what only they share doesn't recur.
Very long texts and lines are read whole; a text of more than ``SLICE_BYTES`` is hashed by itself. An
empty table gives no rows. Columns named ``n_lines`` or ``n_dropped`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.llm import _text
from typeloom.plans.shared import drop_written, written
from typeloom.plans.skew import LIGHT_FLOOR, hot_keys, spread_join

LEADING, CONSTANT, SHARES = 2, 0.6, (0.2, 0.02)
SLICE_BYTES, MOST_BITS = 1 << 20, 1 << 24
_K = [int(x) for x in np.random.default_rng(20).integers(1 << 62, 1 << 63, 8)]
U = np.uint64


class Lines:
    """Lines with tokens of some documents: their leaves, tokens, and 96-bit keys of those asked for."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        starts, ends, woffs = _text.spans(data, offs, _text.NOT_SPACE)
        at_break = np.flatnonzero(data == 10)
        line = np.searchsorted(at_break, starts) + _text.owner(woffs)
        self.head = np.flatnonzero(np.concatenate([[len(starts) > 0], line[1:] != line[:-1]]))
        self.size = np.diff(np.concatenate([self.head, [len(starts)]]))
        self.doc = np.searchsorted(woffs, self.head, "right") - 1
        self.number = np.searchsorted(at_break, starts[self.head]) - np.searchsorted(at_break, offs[self.doc])
        self.hash = _text.hashes(data, starts, ends, lower=False)
        digits = np.flatnonzero((data >= 48) & (data <= 57))
        self.variable = np.searchsorted(digits, ends) > np.searchsorted(digits, starts)
        count = np.concatenate([[0], np.cumsum(self.variable)])
        n_variable = count[self.head + self.size] - count[self.head]
        enough = self.size - n_variable >= CONSTANT * self.size
        self.has_masked = (n_variable > 0) & enough
        self.has_leaf = (self.size > LEADING + 1) & enough
        self.leaf = _text.mix(self.size.astype(U) * U(_K[4]) + U(_K[5]))
        for k in range(LEADING):
            ok = self.size > k
            token = np.where(self.variable[self.head[ok] + k], U(_K[0]), self.hash[self.head[ok] + k])
            self.leaf[ok] = _text.mix(self.leaf[ok] ^ token)

    def words(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tokens of some lines among all tokens, and those lines' offsets."""
        size = self.size[which]
        offs = np.concatenate([[0], np.cumsum(size)])
        return np.arange(offs[-1]) - np.repeat(offs[:-1] - self.head[which], size), offs

    def keys(self, which: np.ndarray, masked: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each of some lines, by their exact tokens or with digits made variable."""
        at, offs = self.words(which)
        h = np.where(self.variable[at], U(_K[0]), self.hash[at]) if masked else self.hash[at]
        place = (at - np.repeat(self.head[which], np.diff(offs))).astype(U)
        h, total = _text.mix(h + place * U(_K[3])), np.zeros(len(at) + 1, U)
        out = []
        for salt in (_K[1], _K[2]):
            np.cumsum(h, dtype=U, out=total[1:])
            out.append(_text.mix(total[offs[1:]] - total[offs[:-1]] + self.size[which].astype(U) * U(salt)))
            h *= h | U(1)
        return out[0], out[1]

    def tokens(self, which: np.ndarray) -> pa.ListArray:
        """32-bit tokens of some lines; one with a digit is 0."""
        at, offs = self.words(which)
        short = np.where(self.variable[at], U(0), (self.hash[at] >> U(32)) | U(1))
        return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(short.astype(np.uint32).view(np.int32)))


def _pair(keys) -> tuple[pa.Array, pa.Array]:
    return pa.array(keys[0].view(np.int64)), pa.array((keys[1] >> U(32)).astype(np.uint32).view(np.int32))


def _each(batches):
    for batch in batches:
        data, offs = _text.utf8(batch.column("text"))
        o, rid = batch.column("o").to_numpy(), batch.column("rid").to_numpy()
        for i, j in _text.slices(offs, SLICE_BYTES):
            yield Lines(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]), o[i:j], rid[i:j]


@_text.releasing
def _keyed(batches):
    """Rows of (k1, k2, leaf, o, rid, line): each line's exact key with its leaf, and its key without digits."""
    for x, o, rid in _each(batches):
        for which, masked in ((np.arange(len(x.size)), False), (np.flatnonzero(x.has_masked), True)):
            doc = x.doc[which]
            leaves = pa.nulls(len(doc), pa.int64()) if masked else pa.array(x.leaf.view(np.int64), mask=~x.has_leaf)
            columns = [*_pair(x.keys(which, masked)), leaves, pa.array(o[doc]), pa.array(rid[doc]), pa.array(x.number[which].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "leaf", "o", "rid", "line"])


def _tokenised(bits: np.ndarray):
    """Rows of (k1, k2, leaf, o, tokens): lines whose leaf may be among those of the bit table."""

    @_text.releasing
    def task(batches):
        for x, o, _ in _each(batches):
            spot = x.leaf & U(64 * len(bits) - 1)
            which = np.flatnonzero(x.has_leaf & ((bits[(spot >> U(6)).astype(np.int64)] >> (spot & U(63))) & U(1) > 0))
            columns = [*_pair(x.keys(which)), pa.array(x.leaf[which].view(np.int64)), pa.array(o[x.doc[which]]), x.tokens(which)]
            yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "leaf", "o", "tokens"])

    return task


def _bit_table(leaves: DataFrame, n: int) -> np.ndarray:
    """One bit for each leaf, by the low bits of its hash: 16 bits a leaf, ``MOST_BITS`` (2 MB) at most; a long list only fills it."""
    size = min(MOST_BITS, max(64, 1 << (16 * n - 1).bit_length()))
    spot = F.col("leaf").bitwiseAND(size - 1)
    words = leaves.select(F.shiftright(spot, 6).alias("word"), F.expr("shiftleft(1L, cast(leaf & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(U)


@_text.releasing
def _generalised(batches):
    """Rows of (g1, g2, k1, k2, first, last): the templates of its leaf that a line (…, n, tokens, constants) belongs to."""
    names = ("k1", "k2", "first", "last")
    for batch in batches:
        lists, known = batch.column("tokens"), batch.column("constants")
        leaf, n = batch.column("leaf").to_numpy().view(U), batch.column("n").to_numpy()
        size, many_known = (np.diff(x.offsets.to_numpy()) for x in (lists, known))
        row, offs = np.repeat(np.arange(len(size)), size), np.concatenate([[0], np.cumsum(size)])
        place = np.arange(len(row)) - np.repeat(offs[:-1], size)
        token = lists.flatten().to_numpy().view(np.uint32).astype(U)
        spot = place.astype(U) << U(32) | token
        # a leaf's constants stand beside each of its lines; one hash of leaf and place finds them
        seed = _text.mix(leaf + U(_K[5]))
        flat = known.flatten()
        key = _text.mix(flat.field(0).to_numpy().view(U) ^ np.repeat(seed, many_known))
        key, first = np.unique(key, return_index=True)
        count = flat.field(1).to_numpy()[first]
        own = _text.mix(spot ^ np.repeat(seed, size))
        at = np.minimum(np.searchsorted(key, own), max(len(key) - 1, 0))
        times = np.where(key[at] == own, count[at], 0) if len(key) else np.zeros(len(own), np.int64)
        fixed, leading = token != 0, place < LEADING
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offs])
        texts, heads = sums(fixed), sums(fixed & leading)
        done: list[np.ndarray] = []
        for share in SHARES:
            constant = fixed & (leading | (times >= share * n[row]))
            left = sums(constant)
            ok = (left >= CONSTANT * size) & (left > heads) & (left < texts)
            h = _text.mix(np.where(constant, spot, U(0)) + place.astype(U) * U(_K[3]))
            keys = []
            for salt in (_K[6], _K[7]):
                total = np.concatenate([np.zeros(1, U), np.cumsum(h, dtype=U)])[offs]
                keys.append(_text.mix(np.diff(total) + leaf + U(salt)))
                h = h * (h | U(1))
            for before in done:  # both shares may give one template
                ok &= before != keys[0]
            done.append(keys[0])
            which = np.flatnonzero(ok)
            columns = [*_pair([k[which] for k in keys]), *(batch.column(c).take(pa.array(which)) for c in names)]
            yield pa.RecordBatch.from_arrays(columns, ["g1", "g2", *names])


def _identity() -> list[Column]:
    """(o, rid): the document, and the row's text. A row without an id is the document of its text; its o is below all ids but the lowest."""
    text = F.coalesce(F.xxhash64("text"), F.lit(0))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)) + F.shiftrightunsigned(text, 3)).alias("o"), text.alias("rid")]


def leaf_templates(texts: DataFrame, lines: DataFrame) -> DataFrame:
    """(k1, k2, first) of the exact lines that belong to a recurring template of their leaf; ``lines`` has (k1, k2, leaf, first, last, n)."""
    leaves = lines.where("leaf is not null").groupBy("leaf").agg(F.count("*").alias("lines"), F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    leaves = written(leaves.where("lines > 1 and first < last").select("leaf", "lines", "n"), "leaves")
    hot, n = hot_keys(leaves, ["leaf"]), leaves.count()
    tokens = texts.mapInArrow(_tokenised(_bit_table(leaves, n)), "k1 long, k2 int, leaf long, o long, tokens array<int>")
    opened = spread_join(tokens, leaves.select("leaf", F.col("lines").alias("n")), ["leaf"], hot, ["k1"])
    opened = opened.groupBy("k1", "k2").agg(F.min("o").alias("first"), F.max("o").alias("last"), F.min("leaf").alias("leaf"), F.min("n").alias("n"), F.any_value("tokens").alias("tokens"))
    opened = written(opened, "open-lines")
    each = opened.select("leaf", "n", "first", "last", F.posexplode("tokens").alias("place", "token")).where(f"place >= {LEADING} and token <> 0")
    each = each.groupBy("leaf", "place", "token").agg(F.count("*").alias("c"), F.max("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    spot = F.shiftleft(F.col("place").cast("long"), 32).bitwiseOR(F.col("token").cast("long").bitwiseAND(0xFFFFFFFF))
    constant = each.where(F.col("c") >= min(SHARES) * F.col("n")).where("first < last").select("leaf", F.struct(spot.alias("spot"), "c").alias("s"))
    constants = constant.groupBy("leaf").agg(F.collect_list("s").alias("constants"))
    met = spread_join(opened, constants, ["leaf"], hot, ["k1"])
    general = met.select("k1", "k2", "leaf", "n", "first", "last", "tokens", "constants").mapInArrow(_generalised, "g1 long, g2 int, k1 long, k2 int, first long, last long")
    general = written(general, "leaf-templates")
    found = general.groupBy("g1", "g2").agg(F.count("*").alias("n"), F.min("first").alias("a"), F.max("last").alias("b")).where("a < b")
    found = written(found, "recurring-leaf-templates")
    return spread_join(general.select("g1", "g2", "k1", "k2"), found.select("g1", "g2", "a"), ["g1", "g2"], hot_keys(found, ["g1", "g2"], LIGHT_FLOOR), ["k1"]).select("k1", "k2", F.col("a").alias("first"))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(o, rid, lines): the numbers of the lines to drop, for each document that has some."""
    texts = docs.where(F.col("text").isNotNull()).select(*_identity(), "text")
    keyed = written(texts.mapInArrow(_keyed, "k1 long, k2 int, leaf long, o long, rid long, line int"), "keyed")
    lines = keyed.groupBy("k1", "k2").agg(F.min("leaf").alias("leaf"), F.min("o").alias("first"), F.max("o").alias("last"), F.count("*").alias("n"))
    lines = written(lines, "lines")
    own = lines.where("first < last").select("k1", "k2", "first")
    recurring = own.unionByName(leaf_templates(texts, lines)).groupBy("k1", "k2").agg(F.min("first").alias("first"))
    recurring = written(recurring, "templates")
    hot = hot_keys(lines, ["k1", "k2"], LIGHT_FLOOR)
    hits = spread_join(keyed.drop("leaf"), recurring, ["k1", "k2"], hot, ["o", "line"]).where("o > first").select("o", "rid", "line")
    out = written(hits.groupBy("o", "rid").agg(F.collect_set("line").alias("lines")), "dropped")
    for used in (keyed, lines, recurring):
        drop_written(used)
    return out


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the kept text and the added columns ``n_lines`` and ``n_dropped``."""
    o, rid = _identity()
    drops = dropped_lines(docs).withColumnsRenamed({"o": "__o", "rid": "__rid", "lines": "__lines"})
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    keyed = docs.select(*names, o.alias("__ko"), rid.alias("__kr"))
    joined = keyed.join(drops, (F.col("__ko") == F.col("__o")) & (F.col("__kr") == F.col("__rid")), "left")
    lines = F.split("text", "\n")
    left = lambda own: F.array_except(F.sequence(F.lit(0), F.size(own) - 1), "__lines")  # noqa: E731 - by a hash set, in order
    # the lines are the element of an array of one, so that no lambda splits the text anew
    kept = F.get(F.transform(F.array(lines), lambda own: F.array_join(F.transform(left(own), lambda i: F.get(own, i)), "\n")), 0)
    text = F.when(F.col("__lines").isNull(), F.col("text")).otherwise(kept).alias("text")
    return joined.select(*[text if c == "text" else F.col(c) for c in names], F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"), F.when(F.col("__lines").isNull(), 0).otherwise(F.size("__lines")).alias("n_dropped"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept text of every document, with how many lines it had and lost."""
    return drop_recurring_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
