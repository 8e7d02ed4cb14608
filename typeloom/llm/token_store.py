"""Token ids on disk: a shared zstandard dictionary, one frame a document, an offset index.

A store is a folder with two Parquet tables that hold binary files, so that any file system which
Spark reaches will do. ``dictionary`` has one row: the dictionary's bytes and their SHA-256.
``segments`` has a row for each segment file (``part``, ``seg``, ``n_docs``, ``n_tokens``, ``data``).
``data``, little-endian throughout:

====================  =====================================================================
8 bytes               ``TLSEG01\\0``
32 bytes              SHA-256 of the dictionary with which the frames are compressed
u32, u32, u64         bytes an id, number of documents n, offset of the index
frames                for each document a zstandard frame of its ids
index                 i64[n] doc_id, u8[n] doc_id is null, u64[n] ids before it in this part,
                      u64[n] ids with the end id, u64[n + 1] offsets of the frames
====================  =====================================================================

One document is read with its index entry and its frame alone (:func:`read_document`).

Null texts are empty (their only id is the end id); null ``doc_id`` come first; rows with equal
``doc_id`` are ordered by a hash of their text; an empty table gives an empty store and no rows;
columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.llm import _text, _tokens
from typeloom.plans.shared import scratch

MAGIC, HEAD = b"TLSEG01\0", "<8s32sIIQ"
SEGMENT_BYTES = 4 << 20
SEGMENT_SCHEMA = "part int, seg int, n_docs long, n_tokens long, data binary"


def _documents(batches, path, end):
    """(doc_id or None, ids as bytes) of each row."""
    enc = _tokens.pieces(path)
    tail = enc.pack([end])
    for batch in batches:
        data, offs = _text.utf8(batch.column("text"))
        for key, a, b in zip(batch.column("doc_id").to_pylist(), offs[:-1].tolist(), offs[1:].tolist()):
            yield key, enc.encode(data[a:b].tobytes()) + tail


def train_dictionary(docs: DataFrame, end_id: int = 1, path: str | None = None, rows: int = 1500, most_bytes: int = 16_384, size: int = 65_536) -> bytes:
    """A zstandard dictionary from about ``rows`` sampled id arrays; of a longer one than ``most_bytes``, a run of that length.

    The run's place comes from the array's hash. ``rows`` and ``most_bytes`` bound what reaches the driver.
    Empty if zstandard finds the sample too small.
    """
    import zstandard

    n = docs.count()
    picked = docs.select("doc_id", "text").sample(min(1.0, rows / max(n, 1)), 7) if n > rows else docs.select("doc_id", "text")

    def serialised(batches):
        for _, ids in _documents(batches, path, end_id):
            at = zlib.crc32(ids) % (1 + max(0, len(ids) - most_bytes) // 4) * 4
            ids = ids[at : at + most_bytes]
            yield pa.RecordBatch.from_arrays([pa.array([ids], pa.binary())], ["ids"])

    sample = sorted(bytes(r.ids) for r in picked.mapInArrow(serialised, "ids binary").collect())
    try:
        return zstandard.train_dictionary(size, sample).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_store(docs: DataFrame, folder: str, end_id: int = 1, path: str | None = None, level: int = 3) -> None:
    """Encode all texts and write them in ascending ``doc_id`` order."""
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, end_id, path)
    mark = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(bytearray(dictionary), mark.hex())], "dictionary binary, sha256 string").coalesce(1).write.parquet(f"{folder}/dictionary")

    def segments(batches):
        import zstandard

        part, seg, before = TaskContext.get().partitionId(), 0, 0
        zip_ = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        width = _tokens.pieces(path).kind.itemsize
        frames, index, held = [], [], 0

        def segment():
            offs = struct.calcsize(HEAD) + np.concatenate([[0], np.cumsum([len(f) for f in frames], dtype=np.int64)])
            keys = np.array([k or 0 for k, _, _ in index], "<i8")
            tail = [keys.tobytes(), np.array([k is None for k, _, _ in index], np.uint8).tobytes(), np.array([s for _, s, _ in index], "<u8").tobytes(), np.array([n for _, _, n in index], "<u8").tobytes(), offs.astype("<u8").tobytes()]
            data = b"".join([struct.pack(HEAD, MAGIC, mark, width, len(index), int(offs[-1])), *frames, *tail])
            columns = [pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([len(index)], pa.int64()), pa.array([sum(n for _, _, n in index)], pa.int64()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "seg", "n_docs", "n_tokens", "data"])

        for key, ids in _documents(batches, path, end_id):
            frames.append(zip_.compress(ids))
            n = len(ids) // width
            index.append((key, before, n))
            before, held = before + n, held + len(frames[-1]) + 33
            if held >= SEGMENT_BYTES:
                yield segment()
                frames, index, held, seg = [], [], 0, seg + 1
        if index:
            yield segment()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, F.col("doc_id")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(segments, SEGMENT_SCHEMA).write.parquet(f"{folder}/segments")


def _index(data: bytes):
    magic, mark, width, n, at = struct.unpack_from(HEAD, data)
    if magic != MAGIC:
        raise ValueError("not a segment")
    keys = np.frombuffer(data, "<i8", n, at)
    null = np.frombuffer(data, np.uint8, n, at + 8 * n)
    starts, counts = np.frombuffer(data, "<u8", n, at + 9 * n), np.frombuffer(data, "<u8", n, at + 17 * n)
    return mark, width, keys, null, starts, counts, np.frombuffer(data, "<u8", n + 1, at + 25 * n)


def _opener(dictionary: bytes, mark: bytes):
    import zstandard

    if hashlib.sha256(dictionary).digest() != mark:
        raise ValueError("the segment was written with another dictionary")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def read_document(data: bytes, i: int, dictionary: bytes) -> np.ndarray:
    """The ids of the segment's document number i; no other frame is opened."""
    mark, width, *_, offs = _index(data)
    frame = _opener(dictionary, mark).decompress(data[int(offs[i]) : int(offs[i + 1])])
    return np.frombuffer(frame, f"<u{width}").astype(np.uint32)


def read_store(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """A row for each document in the store: doc_id, start, n_tokens, ids_crc32, and on demand ids (array).

    ``start`` adds a part's offset, which the driver sums over the parts (a row for each task of
    the writer), to the offset that the index keeps.
    """
    dictionary = bytes(spark.read.parquet(f"{folder}/dictionary").head().dictionary)
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(f"{folder}/segments")
    before, total = {}, 0
    for row in sorted(segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        before[row.part] = total
        total += row.n

    def opened(batches):
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data")):
                data = data.as_py()
                mark, width, keys, null, starts, counts, offs = _index(data)
                unzip = _opener(dictionary, mark)
                view, crcs, lists = memoryview(data), [], []
                for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
                    ids = np.frombuffer(unzip.decompress(view[a:b]), f"<u{width}").astype("<u4")
                    crcs.append(zlib.crc32(ids))
                    if with_ids:
                        lists.append(ids)
                columns = [pa.array(keys, mask=null.astype(bool)), pa.array(starts.astype(np.int64) + before[part]), pa.array(counts.astype(np.int64)), pa.array(crcs, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.tolist() for x in lists], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return segments.select("part", "data").mapInArrow(opened, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), folder)
    return read_store(spark, folder)
