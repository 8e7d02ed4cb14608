"""Body templates, contributions of bodies to fields, placement of files, and checks of values that are in no file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.operators import validate as V
from typeloom.plans.shared import written

STEP = " / "


def _prefixes(section: str) -> Column:
    """A section path and all paths above it."""
    steps = F.split(section, STEP)
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), STEP))


def fills_contracts(files: DataFrame, up: DataFrame, contracts: DataFrame, sections: DataFrame, contributions: DataFrame) -> DataFrame:
    """(path, code, scope, field) of contracts (type, scope, field, exclusive) on sections that a file (path, section) has.

    Each named field needs a contribution (path, field, surface, section) from the body at or below the
    scope; an exclusive contract allows no other field there, and gives one row for each that comes.
    """
    own = contracts.join(up.select(F.col("ancestor").alias("type"), F.col("name").alias("kind")), "type")
    due = files.select("path", "kind").join(F.broadcast(own), "kind").join(sections.select("path", F.col("section").alias("scope")), ["path", "scope"], "left_semi")  # a vocabulary's contracts
    body = contributions.where("surface <> 'frontmatter'").select("path", "field", F.explode(_prefixes("section")).alias("scope"))
    unmet = due.select("path", "scope", "field").distinct().join(body, ["path", "scope", "field"], "left_anti")
    closed = due.where("exclusive").groupBy("path", "scope", "type").agg(F.collect_set("field").alias("allowed"))  # a contract's fields
    extra = body.join(closed, ["path", "scope"]).where(~F.array_contains("allowed", F.col("field")))
    named = lambda df, code: df.select("path", F.lit(code).alias("code"), "scope", "field")
    return named(unmet, "fills-contract-unmet").unionByName(named(extra, "fills-contract-exceeded"))


def contract_checks(contracts: DataFrame, up: DataFrame, effective: DataFrame) -> DataFrame:
    """(type, scope, field, code): contracts that name a field the type lacks, or that lie within the scope of an exclusive one without that field."""
    known = effective.select(F.col("name").alias("type"), "field")
    unknown = contracts.join(known, ["type", "field"], "left_anti").select("type", "scope", "field", F.lit("fills-unknown-field").alias("code"))
    wide = contracts.where("exclusive").groupBy("type", F.col("scope").alias("outer")).agg(F.collect_set("field").alias("allowed"))
    above = contracts.select("type", "scope", "field", F.explode(_prefixes("scope")).alias("outer")).where("outer <> scope")
    nested = above.join(wide, ["type", "outer"]).where(~F.array_contains("allowed", F.col("field")))
    return unknown.unionByName(nested.select("type", "scope", "field", F.lit("fills-contract-conflict-nested-exclusivity").alias("code")).distinct())


def splice(items: DataFrame) -> DataFrame:
    """(type, place, section): the body of each type, items (type, pos, section, use) in order; a ``use`` stands for that type's body.

    ``place`` sorts as text: positions of two digits from the outside in. A body that would stand within
    itself is left out there.
    """
    step = lambda p: F.lpad(F.col(p).cast("string"), 2, "0")
    left = items.select("type", step("pos").alias("place"), "section", "use", F.array("type").alias("trail"))
    done = None
    inner = items.select(F.col("type").alias("of"), F.col("pos").alias("__pos"), F.col("section").alias("__section"), F.col("use").alias("__use"))
    while True:
        left = written(left, "spliced")
        flat = left.where("use is null").select("type", "place", "section")
        done = flat if done is None else done.unionByName(flat)
        nested = left.where("use is not null and not array_contains(trail, use)")
        if nested.isEmpty():
            return done
        opened = nested.join(inner, nested["use"] == inner["of"])
        left = opened.select("type", F.concat_ws(".", "place", step("__pos")).alias("place"), F.col("__section").alias("section"), F.col("__use").alias("use"), F.concat("trail", F.array("of")).alias("trail"))


def use_checks(items: DataFrame, up: DataFrame, cycles: DataFrame) -> DataFrame:
    """(type, use, code): uses of types outside the closure or without a body, and those on a cycle (name)."""
    uses = items.where("use is not null").select("type", "use").distinct()
    within = up.select(F.col("name").alias("type"), F.col("ancestor").alias("use"))
    bodies = items.select(F.col("type").alias("use")).distinct()
    named = lambda df, code: df.select("type", "use", F.lit(code).alias("code"))
    looped = uses.join(cycles.select(F.col("name").alias("type")), "type", "left_semi").join(cycles.select(F.col("name").alias("use")), "use", "left_semi")
    return named(uses.join(within, ["type", "use"], "left_anti"), "body-use-out-of-closure").unionByName(named(uses.join(bodies, "use", "left_anti"), "body-use-target-has-no-body")).unionByName(named(looped, "body-use-cycle"))


def frontmatter_visibility(contributions: DataFrame, values: DataFrame, files: DataFrame, effective: DataFrame) -> DataFrame:
    """(path, field): fields of the type that the body fills though the front matter has no key for them."""
    body = contributions.where("surface <> 'frontmatter'").select("path", "field").distinct()
    keyed = values.select("path", "field").unionByName(contributions.where("surface = 'frontmatter'").select("path", "field")).distinct()
    known = effective.select(F.col("name").alias("kind"), "field")
    return body.join(keyed, ["path", "field"], "left_anti").join(files.select("path", "kind"), "path").join(F.broadcast(known), ["kind", "field"], "left_semi").select("path", "field")  # a vocabulary's fields


def slot_contributions(lists: DataFrame) -> DataFrame:
    """(path, field, at, value): one contribution for each element of a list slot (path, field, values); an empty list has none."""
    return lists.select("path", "field", F.posexplode("values").alias("at", "value"))


def glob_pattern(glob: Column) -> Column:
    """Regular expression of a directory with a final slash; ``*`` is one step, ``**`` any number."""
    literal = F.replace(F.concat(glob, F.lit("/")), F.lit("."), F.lit("[.]"))
    many = F.replace(literal, F.lit("**/"), F.lit("\u0001"))
    one = F.replace(many, F.lit("*"), F.lit("[^/]+"))
    return F.concat(F.lit("^"), F.replace(one, F.lit("\u0001"), F.lit("(?:[^/]+/)*")), F.lit("$"))


def location_checks(files: DataFrame, up: DataFrame, specs: DataFrame) -> DataFrame:
    """(path, code, severity, owner) of files (path, stem, kind, k) against the locations (type, dir, name, ext, strict) of their types.

    An unmet strict location is an error. If any location is met, unmet soft ones are hints; if none is,
    and one is soft, there is one warning. An empty part asks for nothing; ``%key%`` in a name is the key.
    """
    own = specs.join(up.select(F.col("ancestor").alias("type"), F.col("name").alias("kind")), "type").withColumn("__dir", glob_pattern(F.col("dir")))
    seen = files.select("path", "stem", "kind", "k").join(F.broadcast(own), "kind")  # a vocabulary's locations
    folder = F.regexp_extract("path", "^(.*/)?[^/]*$", 1)
    name = F.replace("name", F.lit("%key%"), F.col("k").cast("string"))
    met = ((F.col("dir") == "") | F.rlike(folder, F.col("__dir"))) & ((F.col("name") == "") | (F.col("stem") == name)) & ((F.col("ext") == "") | F.endswith("path", F.concat(F.lit("."), "ext")))
    seen = seen.select("path", "type", "strict", met.alias("met"))
    whole = seen.groupBy("path").agg(F.bool_or("met").alias("any"), F.bool_or(~F.col("strict")).alias("soft"))
    code = F.when(F.col("strict"), "location-strict-violation").otherwise("location-partial-unmet")
    severity = F.when(F.col("strict"), "error").otherwise("hint")
    each = seen.where("not met").join(whole.where("any"), "path", "left").where("strict or any").select("path", code.alias("code"), severity.alias("severity"), F.col("type").alias("owner"))
    none = whole.where("not any and soft").select("path", F.lit("location-mismatch").alias("code"), F.lit("warning").alias("severity"), F.lit(None).cast("string").alias("owner"))
    return each.unionByName(none)


def value_verdicts(asked: DataFrame, values: DataFrame, types: DataFrame, up: DataFrame, fields: DataFrame, effective: DataFrame) -> DataFrame:
    """(path, kind, valid, codes) of values (path, field, num, txt) asked (path, kind) for a type each; a name of no concrete type is invalid."""
    usable = types.where("not is_abstract and not is_sealed").select(F.col("name").alias("kind"))
    strange = asked.join(usable, "kind", "left_anti").select("path", F.lit("unknown-type-claim").alias("code"))
    typed = values.join(asked, "path")
    found = V.union_all([V.required_absent(asked, values, effective, ()), V.enum_mismatch(typed, up, fields), V.out_of_refinement(typed, up, fields)]).select("path", "code")
    codes = found.unionByName(strange).groupBy("path").agg(F.array_join(F.sort_array(F.collect_set("code")), ",").alias("codes"))
    return asked.join(codes, "path", "left").select("path", "kind", F.col("codes").isNull().alias("valid"), F.coalesce("codes", F.lit("")).alias("codes"))
