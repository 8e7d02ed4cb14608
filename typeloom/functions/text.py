"""Text functions: wikilinks, headings with section paths, byte positions, content hash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: target[::repo[@commit]][#anchor][^block or ^^block][:field], in that order. An @ without a repo is part of
#: the target, and a : behind an anchor is part of the heading: only a block or a bare target has a field.
LINK = r"\[\[([^\]\[:#^]+)(?:::([^\]\[:@#^]+)(?:@([0-9a-f]+))?)?(?:#([^\]\[^]+))?(?:(\^\^?)([A-Za-z0-9_-]+))?(?::([A-Za-z_][A-Za-z0-9_]*))?\]\]"
PARTS = ("target", "repo", "pin", "anchor", "mode", "block", "field")


def parse_link(link: Column) -> Column:
    """A struct of the parts of a whole link; null for text that isn't one. Absent parts are empty."""
    parts = F.struct(*[F.regexp_extract(link, f"^\\s*{LINK}\\s*$", i + 1).alias(n) for i, n in enumerate(PARTS)])
    return F.when(link.rlike(f"^\\s*{LINK}\\s*$"), parts)


def looks_like_link(text: Column) -> Column:
    return text.rlike(r"^\s*\[\[.+\]\]\s*$")


def links_in(text: Column) -> Column:
    """All well-formed links of a text, as an array of structs."""
    return F.transform(F.regexp_extract_all(text, F.lit(LINK), 0), parse_link)


def all_links(notes: DataFrame) -> DataFrame:
    """(path, pos, and all parts): every link of every note, in order of appearance."""
    return notes.select("path", F.posexplode(links_in(F.col("body"))).alias("pos", "link")).select("path", "pos", *[F.col("link")[n].alias(n) for n in PARTS])


def headings(notes: DataFrame) -> DataFrame:
    """(path, line, level, text, section): ATX headings with the path of headings above, root first."""
    lines = notes.select("path", F.posexplode(F.split("body", "\n")).alias("line", "l")).where(F.col("l").rlike("^#{1,6} "))
    own = lines.select("path", F.col("line").cast("long").alias("line"), F.length(F.regexp_extract("l", "^(#{1,6}) ", 1)).cast("long").alias("level"), F.trim(F.regexp_replace("l", "^#{1,6} ", "")).alias("text"))
    before = Window.partitionBy("path").orderBy("line")
    # of the headings so far, those of lower level than every later one up to here
    upto = own.withColumn("__all", F.collect_list(F.struct("level", "text")).over(before))
    kept = F.aggregate("__all", F.expr("cast(array() as array<struct<level:bigint,text:string>>)"), lambda acc, h: F.concat(F.filter(acc, lambda x: x["level"] < h["level"]), F.array(h)))
    return upto.select("path", "line", "level", "text", F.array_join(F.transform(kept, lambda x: x["text"]), " / ").alias("section"))


def sizes(notes: DataFrame) -> DataFrame:
    return notes.select("path", F.octet_length("body").cast("long").alias("bytes"), F.length("body").cast("long").alias("chars"), F.size(F.split("body", "\n")).cast("long").alias("lines"))


def line_column(text: Column, byte: Column) -> Column:
    """1-based line and 1-based byte column of a byte offset."""
    head = F.substring(F.encode(text, "utf-8"), F.lit(1), byte)
    shown = F.decode(head, "utf-8")
    line = F.regexp_count(shown, F.lit("\n")) + 1
    last = F.element_at(F.split(shown, "\n"), -1)
    return F.struct(line.alias("line"), (F.octet_length(last) + 1).alias("column"))


def malformed_links(notes: DataFrame) -> DataFrame:
    """(path, pos, text): double brackets on one line that are no well-formed link."""
    found = F.regexp_extract_all("body", F.lit(r"\[\[[^\]\[\n]*\]\]"), 0)
    return notes.select("path", F.posexplode(found).alias("pos", "text")).where(~F.col("text").rlike(f"^{LINK}$"))


def open_fences(notes: DataFrame) -> DataFrame:
    """(path, line) of a fence that is never closed: the last of an odd number of fence lines."""
    lines = notes.select("path", F.posexplode(F.split("body", "\n")).alias("line", "l")).where(F.col("l").rlike("^```"))
    return lines.groupBy("path").agg(F.count("*").alias("n"), F.max("line").cast("long").alias("line")).where("n % 2 = 1").select("path", "line")


def fnv1a(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """FNV-1a 64 of each slice, all slices at once: step k mixes byte k of every slice that has one."""
    size = np.diff(offs)
    order = np.argsort(-size, kind="stable")
    start, size = offs[:-1][order], size[order]
    h = np.full(len(size), 0xCBF29CE484222325, np.uint64)
    live = len(size)
    for k in range(int(size.max(initial=0))):
        while live and size[live - 1] <= k:
            live -= 1
        h[:live] = (h[:live] ^ data[start[:live] + k]) * np.uint64(0x100000001B3)
    out = np.empty_like(h)
    out[order] = h
    return out


def content_hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, hash): 16 lower-case hex digits; a null text hashes like an empty one."""

    def task(batches):
        for batch in batches:
            col = pc.fill_null(batch.column("text"), "").cast(pa.large_string())
            if not len(col):
                continue
            _, offs, data = col.buffers()
            offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
            data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            hashes = fnv1a(data, offs)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f"{int(x):016x}" for x in hashes])], ["doc_id", "hash"])

    return docs.mapInArrow(task, "doc_id long, hash string")
