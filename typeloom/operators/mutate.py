"""Edits of a versioned file table (path, text), each a new DataFrame; nothing is written in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class EditRefused(ValueError):
    """The edit's guard doesn't hold."""


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def write_file(files: DataFrame, path: str, text: str, expected: str | None = None) -> DataFrame:
    """Put a file; with ``expected`` only if the present text has that hash (compare and set)."""
    if expected is not None and files.where((F.col("path") == path) & (text_hash(F.col("text")) == expected)).isEmpty():
        raise EditRefused(f"{path} has another hash")
    new = files.sparkSession.createDataFrame([(path, text)], "path string, text string")
    return files.where(F.col("path") != path).unionByName(new)


def delete_file(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("path") != path)


def edit_file(files: DataFrame, path: str, old: str, new: str, replace_all: bool = False) -> DataFrame:
    """Exact replacement; ``old`` must occur once unless all are meant."""
    n = files.where(F.col("path") == path).select((F.size(F.split("text", _quoted(old))) - 1).alias("n")).first()
    if n is None or n.n < 1 or (n.n > 1 and not replace_all):
        raise EditRefused(f"{0 if n is None else n.n} occurrences")
    return files.withColumn("text", F.when(F.col("path") == path, F.replace("text", F.lit(old), F.lit(new))).otherwise(F.col("text")))


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def rename(files: DataFrame, moves: DataFrame) -> DataFrame:
    """Move files (old_path, new_path, old_stem, new_stem) and rewrite unpinned links to their stems in every text.

    Texts ask for the stems that they link to; only texts with a hit change.
    """
    stems = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"\[\[([^\]\[:#^]+)"), 1), F.lower))
    wanted = files.select("path", F.explode(stems).alias("stem")).join(moves.select(F.lower("old_stem").alias("stem"), "new_stem"), "stem")
    table = wanted.groupBy("path").agg(F.collect_list(F.struct("stem", "new_stem")).alias("renames"))
    joined = files.join(table, "path", "left").join(moves.select(F.col("old_path").alias("path"), "new_path"), "path", "left")

    def swap(text: Column, r: Column) -> Column:
        # the stem must end there or go on with an anchor, block or field; another repo's file keeps its name, pinned or not
        pattern = F.concat(F.lit(r"(?i)\[\[\Q"), r["stem"], F.lit(r"\E(?=[\]#^]|:(?!:))"))
        return F.regexp_replace(text, pattern, F.concat(F.lit("[["), r["new_stem"]))

    text = F.when(F.col("renames").isNull(), F.col("text")).otherwise(F.aggregate("renames", F.col("text"), swap))
    return joined.select(F.coalesce("new_path", "path").alias("path"), text.alias("text"))


def assign_block_id(text: str, line: int, block_id: str) -> str:
    """Put ``^id`` at the end of a line; a line that has one keeps it."""
    import re

    lines = text.split("\n")
    if not re.search(r"(^|\s)\^[A-Za-z0-9_-]+\s*$", lines[line]):
        lines[line] = f"{lines[line].rstrip()} ^{block_id}"
    return "\n".join(lines)


def ensure_mixin(claims: list[str], mixin: str, closure: dict[str, set[str]]) -> list[str]:
    """Add a claim unless another implies it."""
    return claims if any(mixin in closure.get(c, {c}) for c in claims) else [*claims, mixin]


def render_yaml(value, indent: int = 0) -> str:
    """A JSON-like value as block YAML; texts that would read as something else are quoted."""
    import json
    import re

    pad = "  " * indent
    if isinstance(value, dict):
        return "".join(f"{pad}{k}:" + (f"\n{render_yaml(v, indent + 1)}" if isinstance(v, (dict, list)) and v else f" {render_yaml(v)}\n") for k, v in value.items()) or f"{pad}{{}}\n"
    if isinstance(value, list):
        return "".join(f"{pad}-" + (f"\n{render_yaml(v, indent + 1)}" if isinstance(v, (dict, list)) and v else f" {render_yaml(v)}\n") for v in value) or f"{pad}[]\n"
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    plain = re.fullmatch(r"[A-Za-z_][A-Za-z0-9_ ./-]*", value) and value == value.strip() and value not in ("true", "false", "null", "yes", "no", "on", "off")
    return value if plain else json.dumps(value, ensure_ascii=False)
