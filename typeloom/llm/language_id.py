"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword of +1/-1 bits; a logistic classifier on hashed n-grams (2 and 3 bytes of
lower-cased letters with word ends) predicts each bit. Decoding is loss-weighted: the language whose
codeword has the least sum of ``weight * log(1 + exp(-bit * margin))``, a bit weighing as much as it
was right in training. A prediction is ambiguous if the runner-up's loss is within ``MARGIN`` or if
more bits are wrong than the code corrects.

Learning takes the documents with a language whose crc32(doc_id as text) mod 5 isn't 0: a sample of
about ``SAMPLE`` of them in all, even over languages (whole texts, and two lines of each, so that
short texts are known too), as vectors of ``DIM`` numbers; that bounds what the driver holds.
Prediction reads every text whole, in one pass without a shuffle.

Null texts and texts without any letter are ``und`` with score 0, as is everything if there is
nothing to learn from; with one language that language has score 1. A null ``doc_id`` isn't held out
and nothing is learned from it. Repeated rows each get their row. Very long texts are read whole; vectors
are made for ``SLICE_ROWS`` texts at a time, so that many short ones need no more memory. Other columns are passed through by
:func:`identify`; those with the names of the added ones are replaced.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeloom.llm import _text

DIM, SAMPLE, ROUNDS, MARGIN = 4096, 1000, 120, 0.5
SLICE_BYTES, SLICE_ROWS = 1 << 20, 512
ADDED = "lang_pred string, score double, ambiguous boolean, runner_up string"


def letters(data: np.ndarray) -> np.ndarray:
    """Letters lower-cased (ASCII and Latin-1), everything else in ASCII 0."""
    out = _text.LOWER[data].copy()
    out[(out < 97) | ((out > 122) & (out < 128))] = 0
    if len(data) > 1:
        upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[upper] += 0x20
    return out


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row for each document: square roots of the shares of its hashed n-grams (n x DIM)."""
    n = len(offs) - 1
    size = np.diff(offs) + 2  # a space before and after each text
    at = np.arange(len(data)) + 2 * np.repeat(np.arange(n), np.diff(offs)) + 1
    x = np.zeros(int(size.sum()), np.uint32)
    x[at] = letters(data)
    doc = np.repeat(np.arange(n), size)
    two = (x[:-1] << 8) | x[1:]
    three = (two[:-1] << 8) | x[2:]
    half = DIM // 2
    total = np.zeros((n, DIM), np.float32)
    for gram, base, width in ((two, 0, 2), (three, half, 3)):
        ok = (x[: len(gram)] > 0) | (x[1 : len(gram) + 1] > 0)
        ok &= doc[: len(gram)] == doc[width - 1 :]
        h = ((gram[ok] * np.uint32(2654435761)) >> np.uint32(32 - 11)).astype(np.int64)
        count = np.bincount(doc[: len(gram)][ok] * half + h, minlength=n * half).reshape(n, half)
        total[:, base : base + half] = np.sqrt(count / np.maximum(count.sum(axis=1, keepdims=True), 1))
    return total


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1: the exhaustive code up to 7 languages, else the best of 200 random ones."""
    if n < 3:
        return np.array([[1.0], [-1.0]])[:n]
    if n <= 7:
        columns = [c for c in itertools.product([1.0, -1.0], repeat=n) if c[0] > 0 and min(c) < 0]
        return np.array(columns).T
    rng, best, far = np.random.default_rng(0), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, int(10 * np.ceil(np.log2(n)))))
        gap = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i)) if n <= 64 else int((code[0] != code[1:]).sum(axis=1).min())
        if gap > far and (np.abs(code.sum(axis=0)) < n).all():
            best, far = code, gap
    return best


class Model:
    """Bit classifiers and the code."""

    def __init__(self, x: np.ndarray, y: np.ndarray, langs: list[str]):
        self.langs, self.code = langs, codewords(len(langs))
        gaps = [int((a != b).sum()) for a, b in itertools.combinations(self.code, 2)]
        self.corrects = (min(gaps) - 1) // 2 if gaps else 0
        bits = self.code[y]
        share = np.bincount(y, minlength=len(langs))
        weight = (1 / (share[y] * len(langs))).astype(np.float32)[:, None]
        w, b = np.zeros((x.shape[1], bits.shape[1]), np.float32), np.zeros(bits.shape[1], np.float32)
        sw, sb = w.copy(), b.copy()
        bits = bits.astype(np.float32)
        for k in range(ROUNDS):  # Nesterov's steps on the weighted logistic loss
            g = -bits * weight / (1 + np.exp(np.clip(bits * (x @ sw + sb), -30, 30)))
            nw, nb = sw - 8 * (x.T @ g), sb - 8 * g.sum(axis=0)
            sw, sb = nw + k / (k + 3) * (nw - w), nb + k / (k + 3) * (nb - b)
            w, b = nw, nb
        self.w, self.b = w, b
        right = (((x @ w + b) * bits > 0) * weight).sum(axis=0)
        self.weight = np.maximum(2 * right - 1, 0.05)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best language, score, ambiguity and runner-up for each row."""
        f = (x @ self.w + self.b).astype(np.float64)
        loss = np.stack([(self.weight * np.logaddexp(0, -f * c)).sum(axis=1) for c in self.code], axis=1)
        order = np.argsort(loss, axis=1, kind="stable")
        best, second = order[:, 0], order[:, min(1, len(self.langs) - 1)]
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        rows = np.arange(len(x))
        wrong = (np.sign(f) != self.code[best]).sum(axis=1)
        ambiguous = (loss[rows, second] - loss[rows, best] < MARGIN) | (wrong > self.corrects)
        if len(self.langs) == 1:
            ambiguous[:] = False
        return best, 1 / p.sum(axis=1), ambiguous, second


def _fold():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on a bounded sample of the labelled documents outside the held-out fold."""
    own = docs.where((_fold() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = {r.lang: r.n for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    each, top = max(20, sample // len(counts)), 1 << 30
    share = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(top, top * each // n))])
    h = F.xxhash64("doc_id", F.lit("language sample"))
    picked = own.withColumn("h", h).where(F.pmod("h", F.lit(top)) < share[F.col("lang")])

    def vectors(batches):
        for batch in batches:
            for h, lang, text in zip(*(batch.column(c).to_pylist() for c in ("h", "lang", "text"))):
                lines = [x for x in text.split("\n") if any(map(str.isalpha, x))]
                texts = [text, *lines[:: max(1, len(lines) // 2)][:2]]
                x = features(*_text.utf8(pa.array(texts, pa.string())))
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(x)), pa.array([lang] * len(x)), pa.array([v.tobytes() for v in x], pa.binary())], ["h", "lang", "x"])

    rows = sorted(picked.select("h", "lang", "text").mapInArrow(vectors, "h long, lang string, x binary").collect())
    langs = sorted({r.lang for r in rows})
    if not langs:
        return None
    x = np.frombuffer(b"".join(bytes(r.x) for r in rows), np.float32).reshape(len(rows), DIM)
    return Model(x, np.array([langs.index(r.lang) for r in rows]), langs)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred, score, ambiguous and runner_up."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by DIM and the code
    added = T._parse_datatype_string(ADDED)
    kept = [f for f in docs.schema if f.name not in added.names]
    names = [f.name for f in kept]

    @_text.releasing
    def task(batches):
        model = held.value
        for batch in batches:
            data, offs = _text.utf8(batch.column("text"))
            for i, j in _text.slices(offs, SLICE_BYTES, SLICE_ROWS):
                own, at = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                ascii_ = np.concatenate([[0], np.cumsum((own | 32 >= 97) & (own | 32 <= 122))])
                some = ascii_[at[1:]] > ascii_[at[:-1]]
                for k in np.flatnonzero(~some & (np.diff(at) > 0)):
                    some[k] = any(map(str.isalpha, own[at[k] : at[k + 1]].tobytes().decode("utf-8", "replace")))
                lang, score = np.full(j - i, "und", object), np.zeros(j - i)
                unsure, other = np.ones(j - i, bool), np.full(j - i, None, object)
                if model is not None and some.any():
                    best, p, doubt, second = model.decode(features(own, at))
                    langs = np.array(model.langs, object)
                    lang[some], score[some], unsure[some] = langs[best[some]], p[some], doubt[some]
                    if len(langs) > 1:
                        other[some] = langs[second[some]]
                rest = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [*(rest.column(n) for n in names), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure), pa.array(other, pa.string())], [*names, *added.names]
                )

    return docs.mapInArrow(task, T.StructType([*kept, *added]))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", F.coalesce(_fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous", "runner_up")
