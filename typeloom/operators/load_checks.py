"""Checks and reads over type definitions as they are loaded: (name, owner, ...) tables of a few thousand rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _found(code: str, *columns) -> list:
    return [*columns, F.lit(code).alias("code")]


def graph_of(defs: DataFrame) -> DataFrame:
    """(name, owner, kept): of several definitions (name, owner) of one name the first owner's is kept."""
    order = F.row_number().over(Window.partitionBy("name").orderBy("owner"))
    return defs.select("name", "owner", (order == 1).alias("kept"))


def identities(defs: DataFrame, fields: DataFrame) -> DataFrame:
    """(name, owner, identity): a hash of the name's field declarations in order; definitions with equal fields are one."""
    own = fields.groupBy(F.col("type").alias("name")).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "field", "shape"))), ";").alias("text"))
    return defs.join(own, "name", "left").select("name", "owner", F.md5(F.concat_ws("|", "name", "extra", F.coalesce("text", F.lit("")))).alias("identity"))


def name_conflicts(ids: DataFrame) -> DataFrame:
    """(name, n): names with several identities."""
    return ids.groupBy("name").agg(F.countDistinct("identity").alias("n")).where("n > 1")


def types_page(defs: DataFrame, limit: int, offset: int = 0, owner: str | None = None) -> DataFrame:
    """(name, owner): one definition a name in order of names, or all of one owner."""
    own = graph_of(defs).where("kept") if owner is None else defs.where(F.col("owner") == owner)
    return own.select("name", "owner").orderBy("name").offset(offset).limit(limit)


def redundant_abstract(types: DataFrame) -> DataFrame:
    return types.where("is_abstract and is_sealed").select(*_found("redundant-abstract-on-sealed", "name"))


def meta_targets(metas: DataFrame, types: DataFrame) -> DataFrame:
    """Meta blocks (type, meta) of no known type."""
    return metas.join(types.select(F.col("name").alias("meta")), "meta", "left_anti").select(*_found("required-meta-target-missing", "type", "meta"))


def duplicate_meta(metas: DataFrame) -> DataFrame:
    return metas.groupBy("type", "meta").agg(F.count("*").alias("n")).where("n > 1").select(*_found("duplicate-meta", "type", "meta"))


def unmet_meta(metas: DataFrame, required: DataFrame, up: DataFrame) -> DataFrame:
    """(type, meta): a required meta (base, meta) that neither a descendant nor any of its ancestors states."""
    need = up.join(required.withColumnRenamed("base", "ancestor"), "ancestor").select("name", "meta").distinct()
    has = up.join(metas.select(F.col("type").alias("ancestor"), "meta"), "ancestor").select("name", "meta").distinct()
    return need.join(has, ["name", "meta"], "left_anti").select(F.col("name").alias("type"), "meta")


def brand_checks(brands: DataFrame, fields: DataFrame) -> DataFrame:
    """(name, field, code): brands with fields of their own, and slots that refer to a brand as if it were a record."""
    mixed = fields.join(brands.select(F.col("name").alias("type")), "type").select(F.col("type").alias("name"), "field", F.lit("brand-with-fields").alias("code"))
    base = F.regexp_extract("shape", r"^([a-z]\w*)[*&]", 1)
    pointed = fields.withColumn("brand", base).join(brands.select(F.col("name").alias("brand")), "brand", "left_semi")
    return mixed.unionByName(pointed.select(F.col("type").alias("name"), "field", F.lit("brand-not-referenceable").alias("code")))


def admits_reference(fields: DataFrame) -> DataFrame:
    """(type, field, admits): whether a slot's shape takes a reference."""
    return fields.select("type", "field", F.col("shape").rlike(r"[*&]").alias("admits"))


def compound_subsumption(operands: DataFrame, up: DataFrame) -> DataFrame:
    """(type, field, flagged, by): operands of a slot's union or intersection (type, field, kind, operand) that another makes redundant.

    In a union the narrower is flagged, in an intersection the wider; ``any`` is wider than all.
    """
    other = operands.select("type", "field", F.col("operand").alias("wide"))
    within = up.where("name <> ancestor").select(F.col("name").alias("operand"), F.col("ancestor").alias("wide"))
    wider = operands.select(F.col("operand")).distinct().where("operand <> 'any'").select("operand", F.lit("any").alias("wide"))
    hit = operands.join(other, ["type", "field"]).join(within.unionByName(wider).distinct(), ["operand", "wide"])
    union = F.col("kind") == "union"
    return hit.select("type", "field", F.when(union, F.col("operand")).otherwise(F.col("wide")).alias("flagged"), F.when(union, F.col("wide")).otherwise(F.col("operand")).alias("by"))


def cardinality_subsumption(branches: DataFrame) -> DataFrame:
    """(type, field, branch, by): branches (type, field, branch, low, high) of one slot whose counts lie within another's; of equal ones the later."""
    a, b = branches.alias("a"), branches.alias("b")
    inside = (F.col("a.low") >= F.col("b.low")) & (F.col("a.high") <= F.col("b.high"))
    equal = (F.col("a.low") == F.col("b.low")) & (F.col("a.high") == F.col("b.high"))
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("type", "field")]
    hit = a.join(b, same[0] & same[1]).where((F.col("a.branch") != F.col("b.branch")) & inside & (~equal | (F.col("a.branch") > F.col("b.branch"))))
    return hit.select("a.type", "a.field", "a.branch", F.col("b.branch").alias("by"))


def outside_type_dir(def_files: DataFrame) -> DataFrame:
    """Definition files (path) with no folder named type above them."""
    return def_files.where(~F.array_contains(F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1), "type")).select(*_found("type-def-outside-type-dir", "path"))


def divergent_uses(values: DataFrame, effective: DataFrame) -> DataFrame:
    """(path, field): values of a divergent field that name no origin."""
    bad = effective.where("divergent").select(F.col("name").alias("kind"), "field")
    return values.join(F.broadcast(bad), ["kind", "field"], "left_semi").select("path", "field").distinct()  # a vocabulary's fields


def null_anchors(values: DataFrame, effective: DataFrame, filled: DataFrame) -> DataFrame:
    """(path, field): required fields that are given as null and that no body part (path, field) fills."""
    need = effective.where("required").select(F.col("name").alias("kind"), "field")
    null = values.where("num is null and txt is null").join(F.broadcast(need), ["kind", "field"], "left_semi")
    return null.join(filled.select("path", "field").distinct(), ["path", "field"], "left_anti").select("path", "field")


def section_presence(headings: DataFrame, notes: DataFrame, required: list[str]) -> DataFrame:
    """(path, section, code): required level-1 sections that are missing, or that stand before the one required earlier."""
    rows = notes.sparkSession.createDataFrame(list(enumerate(required)), "n int, section string")
    asked = notes.select("path", F.explode(F.array(*[F.struct(F.lit(i).alias("n"), F.lit(s).alias("section")) for i, s in enumerate(required)])).alias("q")).select("path", "q.*")
    first = headings.where("level = 1").select("path", "line", "text").join(F.broadcast(rows), F.col("text") == F.col("section")).groupBy("path", "section").agg(F.min("line").alias("line"))
    seen = asked.join(first, ["path", "section"], "left")
    before = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    code: Column = F.when(F.col("line").isNull(), "required-section-missing").when(F.col("line") < F.max("line").over(before), "section-out-of-order")
    return seen.select("path", "section", code.alias("code")).where("code is not null")
