"""Diagnostics: one constraint query for each code, all with the columns (path, code, severity, field)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typeloom.operators.graph import resolve_links


def _row(code: str, severity: str = "error", field: Column | None = None) -> list[Column]:
    return [F.col("path"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), (F.lit(None).cast("string") if field is None else field).alias("field")]


def required_absent(files: DataFrame, values: DataFrame, effective: DataFrame, body_fields: tuple[str, ...] = ("items",)) -> DataFrame:
    """Required fields without a value; ``body_fields`` are filled by inline records, which :func:`cardinality` counts."""
    need = effective.where("required").where(~F.col("field").isin(*body_fields)).select(F.col("name").alias("kind"), "field")
    return files.select("path", "kind").join(need, "kind").join(values.select("path", "field").distinct(), ["path", "field"], "left_anti").select(*_row("required-field-absent", field=F.col("field")))


def enum_mismatch(values: DataFrame, up: DataFrame, fields: DataFrame) -> DataFrame:
    own = fields.where("members <> ''").join(up.select(F.col("ancestor").alias("type"), F.col("name").alias("kind")), "type")
    seen = values.where("txt is not null").join(own.select("kind", "field", "members"), ["kind", "field"])
    return seen.where(~F.col("members").contains(F.concat(F.lit(","), F.col("txt"), F.lit(",")))).select(*_row("field-shape-mismatch", field=F.col("field")))


def out_of_refinement(values: DataFrame, up: DataFrame, fields: DataFrame) -> DataFrame:
    own = fields.where("shape like 'Number{%'").join(up.select(F.col("ancestor").alias("type"), F.col("name").alias("kind")), "type")
    seen = values.where("num is not null").join(own.select("kind", "field", "min_v", "max_v").distinct(), ["kind", "field"])
    return seen.where("num < min_v or num > max_v").select(*_row("value-out-of-refinement", field=F.col("field")))


def nested_out_of_refinement(inline: DataFrame, fields: DataFrame) -> DataFrame:
    """The same for fields of inline records."""
    long = inline.select("path", "type", F.explode(F.create_map(F.lit("quantity"), "quantity", F.lit("discount"), "discount")).alias("field", "num"))
    return long.join(fields.select("type", "field", "min_v", "max_v"), ["type", "field"]).where("num < min_v or num > max_v").select(*_row("value-out-of-refinement", field=F.concat(F.lit("items."), F.col("field"))))


def cardinality(files: DataFrame, inline: DataFrame, low: int, high: int, kinds: tuple[str, ...]) -> DataFrame:
    """Files of the kinds whose number of inline records is outside low..high."""
    n = inline.groupBy("path").agg(F.count("*").alias("n"))
    own = files.where(F.col("kind").isin(*kinds)).select("path").join(n, "path", "left")
    return own.where(~F.coalesce("n", F.lit(0)).between(low, high)).select(*_row("cardinality-mismatch", field=F.lit("items")))


def duplicate_block_ids(inline: DataFrame) -> DataFrame:
    """Every block id of a file after its first."""
    order = Window.partitionBy("path", "block_id").orderBy("n")
    return inline.withColumn("__n", F.row_number().over(order)).where("__n > 1").select(*_row("duplicate-block-id", "warning", F.col("block_id")))


def dangling(links: DataFrame, files: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """Missing, ambiguous and escaping references; navigational ones are warnings."""
    bad = (resolved or resolve_links(links, files)).where(F.col("outcome").isin("missing", "ambiguous", "escaping"))
    severity = F.when(F.col("slot").isNull(), "warning").otherwise("error")
    return bad.select(F.col("src").alias("path"), F.concat(F.lit("reference-target-"), F.col("outcome")).alias("code"), severity.alias("severity"), F.col("slot").alias("field"))


def target_type_mismatch(links: DataFrame, files: DataFrame, up: DataFrame, refs: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """Resolved references whose target isn't of the slot's type."""
    kinds = files.select("path", "kind")
    own = (resolved or resolve_links(links, files)).where("outcome = 'resolved' and slot is not null").select("src", "slot", "dst")
    typed = own.join(kinds.select(F.col("path").alias("dst"), F.col("kind").alias("dst_kind")), "dst").join(kinds.select(F.col("path").alias("src"), "kind"), "src")
    slots = refs.join(up.select(F.col("ancestor").alias("type"), F.col("name").alias("kind")), "type").select("kind", F.col("field").alias("slot"), "target")
    fit = up.select(F.col("name").alias("dst_kind"), F.col("ancestor").alias("target"))
    return typed.join(slots, ["kind", "slot"]).join(fit, ["dst_kind", "target"], "left_anti").select(F.col("src").alias("path"), F.lit("reference-target-type-mismatch").alias("code"), F.lit("error").alias("severity"), F.col("slot").alias("field"))


def claim_legality(claims: DataFrame, types: DataFrame) -> DataFrame:
    """Claims (path, claim) of unknown, abstract or sealed types."""
    seen = claims.join(types.select(F.col("name").alias("claim"), "is_abstract", "is_sealed"), "claim", "left")
    code = F.when(F.col("is_abstract").isNull(), "unknown-type-claim").when(F.col("is_sealed"), "sealed-parent-claimed").when(F.col("is_abstract"), "abstract-type-claimed")
    return seen.select("path", code.alias("code"), F.lit("error").alias("severity"), F.col("claim").alias("field")).where("code is not null")


def multi_leaf(claims: DataFrame, up: DataFrame, sealed: DataFrame) -> DataFrame:
    """Files that claim more than one member of a sealed family."""
    member = up.select(F.col("name").alias("claim"), F.col("ancestor").alias("member")).join(sealed, "member").select("claim", F.col("parent").alias("root"), "member")
    return claims.join(member, "claim").groupBy("path", "root").agg(F.countDistinct("member").alias("n")).where("n > 1").select(*_row("multi-leaf-in-sealed-family", field=F.col("root")))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def faulty(resolved: DataFrame) -> DataFrame:
    """(src, slot, dst, outcome) of resolved links without those that :func:`dangling` and :func:`target_type_mismatch` pass over."""
    return resolved.where("outcome in ('missing', 'ambiguous', 'escaping') or outcome = 'resolved' and slot is not null").select("src", "slot", "dst", "outcome")


def diagnostics(kb: dict[str, DataFrame], up: DataFrame, effective: DataFrame, resolved: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """All diagnostics of a knowledge base; ``resolved`` are its links, if they have been resolved before.

    If ``kb`` holds some files only, with what is theirs, ``targets`` are all files: those that links may point to.
    """
    files, values, links, fields, inline = (kb[f"kb_{x}"] for x in ("files", "values", "links", "fields", "inline"))
    return union_all(
        [
            required_absent(files, values, effective),
            enum_mismatch(values, up, fields),
            out_of_refinement(values, up, fields),
            nested_out_of_refinement(inline, fields),
            cardinality(files, inline, 1, 5, ("order", "rush_order")),
            duplicate_block_ids(inline),
            dangling(links, targets or files, resolved),
            target_type_mismatch(links, targets or files, up, kb["kb_refs"], resolved),
        ]
    )


def counts(found: DataFrame) -> DataFrame:
    """(severity, code, n) by severity, by code, and in all."""
    return found.sparkSession.sql("select severity, code, count(*) as n from {d} group by grouping sets ((), (severity), (code))", d=found)


def under(found: DataFrame, prefix: str) -> DataFrame:
    """Diagnostics of files under a directory; whole path components match."""
    p = prefix.rstrip("/")
    return found.where((F.col("path") == p) | F.col("path").startswith(p + "/"))
