"""Algebra and checks over the type vocabulary: types, parents, sealed members, fields and slot references.

A vocabulary has some thousands of rows; its tables stay DataFrames so that they join with instances.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.plans.shared import written

PRIMITIVES = ("String", "Number", "Boolean", "Date", "DateTime", "Url", "any", "opaque", "file", "type")


def transitive(start: DataFrame, steps: DataFrame) -> DataFrame:
    """(name, member): reflexive closure of ``start`` (name) over steps (child, parent); cycles are legal.

    Semi-naive: each round joins only the pairs that the last one found, until there are none.
    """
    reach = written(start.select("name", F.col("name").alias("member")).distinct(), "closure")
    front = reach
    while True:
        found = front.join(steps.select(F.col("child").alias("member"), "parent"), "member").select("name", F.col("parent").alias("member")).distinct()
        front = written(found.join(reach, ["name", "member"], "left_anti"), "front")
        if front.isEmpty():
            break
        reach = written(reach.unionByName(front), "closure")
    return reach


def closure(types: DataFrame, parents: DataFrame) -> DataFrame:
    """(name, ancestor): every defined type with itself and its defined ancestors."""
    defined = types.select(F.col("name").alias("parent"))
    return transitive(types.select("name"), parents.join(defined, "parent", "left_semi")).withColumnRenamed("member", "ancestor")


def referenced_closure(types: DataFrame, parents: DataFrame, refs: DataFrame) -> DataFrame:
    """(name, member): ancestors and the types that fields name, transitively."""
    steps = parents.select("child", "parent").unionByName(refs.select(F.col("type").alias("child"), F.col("target").alias("parent"))).distinct()
    return transitive(types.select("name"), steps)


def children(parents: DataFrame) -> DataFrame:
    """(name, children): direct children, sorted, comma-joined."""
    return parents.groupBy(F.col("parent").alias("name")).agg(F.array_join(F.sort_array(F.collect_set("child")), ",").alias("children"))


def is_abstract(types: DataFrame) -> DataFrame:
    """A type is abstract if declared so or sealed."""
    return types.select("name", (F.col("is_abstract") | F.col("is_sealed")).alias("is_abstract"), "is_sealed")


def subtypes(types: DataFrame, up: DataFrame) -> DataFrame:
    """(base, name): proper descendants of every base."""
    return up.where("name <> ancestor").select(F.col("ancestor").alias("base"), "name")


def type_tree(types: DataFrame, parents: DataFrame) -> DataFrame:
    """(name, parent): parent edges inside the set; roots have a null parent."""
    inside = parents.join(types.select(F.col("name").alias("parent")), "parent", "left_semi").select(F.col("child").alias("name"), "parent")
    return types.select("name").join(inside, "name", "left")


def type_counts(types: DataFrame) -> DataFrame:
    """(owner, n) by owner, and the total with a null owner."""
    return types.rollup("owner").agg(F.count("*").alias("n"))


def effective_fields(up: DataFrame, fields: DataFrame) -> DataFrame:
    """(name, field, shape, required, divergent, origins): fields of the closure.

    Declarations with equal shape text are one field; others make it divergent (null shape). A field is
    required if any origin requires it; origins are sorted.
    """
    own = up.join(fields.select(F.col("type").alias("ancestor"), "field", "shape", "optional"), "ancestor")
    agg = own.groupBy("name", "field").agg(
        F.min("shape").alias("lo"), F.max("shape").alias("hi"), F.bool_or(~F.col("optional")).alias("required"), F.array_join(F.sort_array(F.collect_set("ancestor")), ",").alias("origins")
    )
    return agg.select("name", "field", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("shape"), "required", (F.col("lo") != F.col("hi")).alias("divergent"), "origins")


def qualifier_candidates(up: DataFrame, fields: DataFrame) -> DataFrame:
    """(name, field, qualifier, n): how many origins ``field{qualifier}`` selects on a type (0, 1 or many)."""
    origins = up.join(fields.select(F.col("type").alias("ancestor"), "field"), "ancestor").select("name", "field", F.col("ancestor").alias("origin"))
    asked = up.select("name", F.col("ancestor").alias("qualifier"))
    named = asked.join(origins.select("name", "field").distinct(), "name")
    within = up.select(F.col("name").alias("qualifier"), F.col("ancestor").alias("origin"))
    hits = origins.join(within, "origin").groupBy("name", "field", "qualifier").agg(F.count("*").alias("n"))
    return named.join(hits, ["name", "field", "qualifier"], "left").select("name", "field", "qualifier", F.coalesce("n", F.lit(0)).alias("n"))


def cycles(parents: DataFrame) -> DataFrame:
    """Types that are their own proper ancestors."""
    steps = parents.select("child", "parent")
    first = steps.select(F.col("child").alias("name"), F.col("parent").alias("member")).distinct()
    reach = transitive(first.select(F.col("member").alias("name")).distinct(), steps).withColumnRenamed("name", "via")
    return first.withColumnRenamed("member", "via").join(reach, "via").where("name = member").select("name").distinct()


def absent_parents(types: DataFrame, parents: DataFrame) -> DataFrame:
    return parents.join(types.select(F.col("name").alias("parent")), "parent", "left_anti").select(F.col("child").alias("name"), F.col("parent").alias("target"))


def absent_slot_types(types: DataFrame, refs: DataFrame) -> DataFrame:
    return refs.join(types.select(F.col("name").alias("target")), "target", "left_anti").select(F.col("type").alias("name"), "field", "target")


def bad_names(types: DataFrame) -> DataFrame:
    """(name, code): names against the grammar, or reserved."""
    code = F.when(F.col("name").isin(*PRIMITIVES), "reserved-type-name").when(~F.col("name").rlike("^[a-z][A-Za-z0-9_]*$"), "invalid-type-name")
    return types.select("name", code.alias("code")).where("code is not null")


def field_redeclarations(up: DataFrame, fields: DataFrame) -> DataFrame:
    """(name, field, ancestor): a subtype declares a field that it inherits."""
    mine = fields.select(F.col("type").alias("name"), "field")
    theirs = fields.select(F.col("type").alias("ancestor"), "field")
    return up.where("name <> ancestor").join(mine, "name").join(theirs, ["ancestor", "field"]).select("name", "field", "ancestor")


def sealed_breaches(types: DataFrame, up: DataFrame, sealed: DataFrame) -> DataFrame:
    """(name, root): proper descendants of a sealed type that don't come through a listed member."""
    below = up.where("name <> ancestor").join(types.where("is_sealed").select(F.col("name").alias("ancestor")), "ancestor")
    through = up.select("name", F.col("ancestor").alias("member")).join(sealed.select(F.col("parent").alias("ancestor"), "member"), "member")
    return below.join(through.select("name", "ancestor").distinct(), ["name", "ancestor"], "left_anti").select("name", F.col("ancestor").alias("root"))


def sealed_families(up: DataFrame, sealed: DataFrame) -> DataFrame:
    """(root, member, n): types under each listed member of a sealed root."""
    return sealed.join(up.select(F.col("ancestor").alias("member"), "name"), "member").groupBy(F.col("parent").alias("root"), "member").agg(F.count("*").alias("n"))


def redundant_claims(claims: DataFrame, up: DataFrame) -> DataFrame:
    """(path, claim, code) of claims (path, claim): claimed twice, or an ancestor of another claim of the file."""
    twice = claims.groupBy("path", "claim").agg(F.count("*").alias("n")).where("n > 1").select("path", "claim", F.lit("duplicate-claim").alias("code"))
    each = claims.distinct()
    wide = each.join(up.where("name <> ancestor").select(F.col("name").alias("claim"), "ancestor"), "claim").select("path", F.col("ancestor").alias("claim")).distinct()
    return twice.unionByName(each.join(wide, ["path", "claim"], "left_semi").select("path", "claim", F.lit("subsumption-in-mixin").alias("code")))


def unsatisfiable_refinements(fields: DataFrame) -> DataFrame:
    return fields.where("min_v > max_v").select("type", "field")


def imports(types: DataFrame, parents: DataFrame) -> DataFrame:
    """(owner, target): types that another owner's types extend."""
    mine = parents.join(types.select(F.col("name").alias("child"), "owner"), "child")
    theirs = types.select(F.col("name").alias("parent"), F.col("owner").alias("other"))
    return mine.join(theirs, "parent").where("owner <> other").select("owner", F.col("parent").alias("target")).distinct()


def type_graph(types: DataFrame, parents: DataFrame, refs: DataFrame, instances: DataFrame) -> DataFrame:
    """(from_node, to_node, relation, n): subtype, field-type and instance-of edges with multiplicity."""
    sub = parents.select(F.col("child").alias("from_node"), F.col("parent").alias("to_node"), F.lit("subtype").alias("relation"))
    field = refs.select(F.col("type").alias("from_node"), F.col("target").alias("to_node"), F.lit("field-type").alias("relation"))
    own = instances.select(F.lit("instances").alias("from_node"), F.col("kind").alias("to_node"), F.lit("instance-of").alias("relation"))
    known = types.select(F.col("name").alias("to_node"))
    return sub.unionByName(field).unionByName(own).join(known, "to_node", "left_semi").groupBy("from_node", "to_node", "relation").agg(F.count("*").alias("n"))


def type_batch(types: DataFrame, names: list[str]) -> DataFrame:
    """(pos, asked, owner): positional lookup, null for misses."""
    asked = types.sparkSession.createDataFrame(list(enumerate(names)), "pos int, asked string")
    return asked.join(types.select(F.col("name").alias("asked"), "owner"), "asked", "left").select("pos", "asked", "owner")


def lookup_meta(start: str, parents: dict[str, list[str]], blocks: dict[str, dict | None], meta: str):
    """First meta block of a type, then of its parents depth-first in claim order; an empty ``meta: []`` (None) stops that branch."""
    seen: set[str] = set()

    def walk(name: str):
        if name in seen:
            return None
        seen.add(name)
        own = blocks.get(name, {})
        if own is None:
            return None
        if meta in own:
            return name, own[meta]
        return next((hit for p in parents.get(name, []) if (hit := walk(p))), None)

    return walk(start)


def closure_ids(local: dict[str, str], edges: dict[str, list[str]]) -> dict[str, str]:
    """Identity of each type: strongly connected components, hashed from the sinks up; a component's members share theirs.

    ``local`` has a hash of each definition; a name that edges mention but ``local`` lacks is a sink.
    """
    import hashlib

    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    on: set[str] = set()
    out: dict[str, str] = {}

    def close(part: list[str]) -> None:
        beyond = sorted({out[t] for m in part for t in edges.get(m, []) if t not in part})
        text = repr((sorted((m, local.get(m, "")) for m in part), beyond))
        digest = hashlib.sha256(text.encode()).hexdigest()[:16]
        out.update(dict.fromkeys(part, digest))

    for root in sorted({*local, *edges, *(t for ts in edges.values() for t in ts)}):
        if root in index:
            continue
        work = [(root, iter(edges.get(root, [])))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for target in rest:
                if target not in index:
                    index[target] = low[target] = len(index)
                    stack.append(target)
                    on.add(target)
                    work.append((target, iter(edges.get(target, []))))
                    break
                if target in on:
                    low[node] = min(low[node], index[target])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    part = []
                    while not part or part[-1] != node:
                        part.append(stack.pop())
                        on.discard(part[-1])
                    close(part)
    return out
