"""Members of a workspace: which repos belong to it, where they lie and in what role, and checks over them.

All tables here have a row for a repo, a place or a dependency: a few thousand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.operators.typegraph import transitive

#: The role that a repo keeps if it is reached in several, and the place that wins; first comes first.
PRECEDENCE, PLACES = ("entry", "edit", "dep", "discover"), ("sibling", "registry", "cache")
EDITABLE = ("entry", "edit")


def _rank(value: str, order: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*map(F.lit, order)), F.col(value))


def locate(places: DataFrame, order: tuple[str, ...] = PLACES) -> DataFrame:
    """(repo, place, root): of the places (repo, place, root) of a repo the first in order; of several roots there the least."""
    first = places.groupBy("repo").agg(F.min(F.struct(_rank("place", order).alias("rank"), "root", "place")).alias("m"))
    return first.select("repo", "m.place", "m.root")


def assemble(claims: DataFrame, located: DataFrame, disabled: DataFrame) -> DataFrame:
    """(repo, role, editable, root) of the claims (repo, role) that aren't disabled (repo); root is null where the repo lies nowhere."""
    role = claims.join(disabled, "repo", "left_anti").groupBy("repo").agg(F.min(F.struct(_rank("role", PRECEDENCE).alias("rank"), "role")).alias("m"))
    members = role.select("repo", F.col("m.role").alias("role"), F.col("m.role").isin(*EDITABLE).alias("editable"))
    return members.join(located.select("repo", "root"), "repo", "left")


def dependencies(deps: DataFrame, located: DataFrame) -> DataFrame:
    """(repo, dep, root) of declared dependencies (repo, dep); root is null for those that lie nowhere."""
    return deps.join(located.select(F.col("repo").alias("dep"), "root"), "dep", "left").select("repo", "dep", "root")


def fixpoint(entry: DataFrame, deps: DataFrame, located: DataFrame) -> DataFrame:
    """(repo, mounted): the entry (repo) and what it depends on, read from manifest to manifest; a repo that lies nowhere has none to read."""
    known = located.select("repo", F.lit(True).alias("mounted"))
    steps = deps.join(known, "repo", "left_semi").select(F.col("repo").alias("child"), F.col("dep").alias("parent"))
    reached = transitive(entry.select(F.col("repo").alias("name")), steps).select(F.col("member").alias("repo")).distinct()
    return reached.join(known, "repo", "left").select("repo", F.coalesce("mounted", F.lit(False)).alias("mounted"))


def locks(deps: DataFrame, located: DataFrame, pinned: DataFrame) -> DataFrame:
    """(repo, dep): for each repo outside the cache every pinned repo (repo) that its dependencies lead to, through pinned and local ones."""
    local = located.where("place <> 'cache'").select("repo")
    steps = deps.join(local.unionByName(pinned.select("repo")).distinct(), "repo", "left_semi")
    reached = transitive(local.select(F.col("repo").alias("name")), steps.select(F.col("repo").alias("child"), F.col("dep").alias("parent")))
    own = reached.where("name <> member").select(F.col("name").alias("repo"), F.col("member").alias("dep"))
    return own.join(pinned.select(F.col("repo").alias("dep")), "dep", "left_semi").select("repo", "dep")


def consistency(claims: DataFrame, places: DataFrame, deps: DataFrame, disabled: DataFrame) -> DataFrame:
    """(repo, code, severity, about): contradictions among claims, places, dependencies and the disabled."""
    located, out = locate(places), None
    has = lambda role: claims.where(F.col("role") == role).select("repo").distinct()
    on = lambda role: has(role).join(disabled, "repo", "left_anti")
    lost = deps.join(located.select(F.col("repo").alias("dep")), "dep", "left_anti").join(disabled.select(F.col("repo").alias("dep")), "dep", "left_anti")
    for rows, code, severity in (
        (places.groupBy("repo", "place").agg(F.countDistinct("root").alias("n")).where("n > 1").select("repo", F.col("place").alias("about")), "duplicate-repo-name", "warning"),
        (lost.select("repo", F.col("dep").alias("about")), "peer-unmounted", "warning"),
        (on("edit").join(located, "repo", "left_anti"), "edit-member-unmounted", "warning"),
        (on("discover").join(located, "repo", "left_anti"), "discover-member-unmounted", "warning"),
        (on("edit").join(located.where("place = 'cache'"), "repo", "left_semi"), "edit-member-read-only", "warning"),
        (has("edit").join(has("discover"), "repo", "left_semi"), "workspace-member-role-conflict", "error"),
        (has("discover").join(has("dep"), "repo", "left_semi"), "discover-member-is-a-dependency", "hint"),
        (disabled.join(claims, "repo", "left_anti").select("repo"), "disabled-member-not-declared", "warning"),
    ):
        about = F.col("about") if "about" in rows.columns else F.lit(None).cast("string")
        found = rows.select("repo", F.lit(code).alias("code"), F.lit(severity).alias("severity"), about.alias("about"))
        out = found if out is None else out.unionByName(found)
    return out


def readme_checks(files: DataFrame, members: DataFrame, claim: str = "readme") -> DataFrame:
    """(path, code): a root README.md of ``claim`` for each editable member, and for no other file."""
    root = F.concat("repo", F.lit("/README.md"))
    asked = members.where("editable").select("repo", root.alias("path"))
    seen = asked.join(files.select("path", "kind"), "path", "left")
    code = F.when(F.col("kind").isNull(), "repo-missing-readme").when(F.col("kind") != claim, "readme-type-undeclared")
    lost = files.where((F.col("kind") == claim) & (F.col("path") != root)).select("path", F.lit("readme-misplaced").alias("code"))
    return seen.select("path", code.alias("code")).where("code is not null").unionByName(lost)


def fold(defs: DataFrame, parents: DataFrame, own: str) -> DataFrame:
    """(name, identity, repo): what one repo's definitions (repo, name, identity) reach over parents (child, parent, both ``repo::name``); one row an identity, of the first repo."""
    key = F.concat_ws("::", "repo", "name")
    reached = transitive(defs.where(F.col("repo") == own).select(key.alias("name")), parents).select(F.col("member").alias("key")).distinct()
    return defs.withColumn("key", key).join(reached, "key", "left_semi").groupBy("name", "identity").agg(F.min("repo").alias("repo"))
