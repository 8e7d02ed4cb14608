"""Registered queries over workspace members, body templates, placement and single values."""

from __future__ import annotations

from pyspark.sql import functions as F

from typeloom.operators import bodies as B
from typeloom.operators import instances as I
from typeloom.operators import members as M
from typeloom.operators import typegraph as T
from typeloom.operators import validate as V
from typeloom.plans.registry import _ALL, _EFFECTIVE, _KB, _TP, _UP, _WITH, _diagnostics, _query, _up

# ---- members

_LOC = "loc as (select repo, arg_min(place, r) as place, min(root) filter (r = low) as root from (select *, min(r) over (partition by repo) as low from (select *, case place when 'sibling' then 1 when 'registry' then 2 else 3 end as r from {kb_places})) group by repo)"
_ROLES = "rl as (select repo, arg_min(role, r) as role from (select *, case role when 'entry' then 1 when 'edit' then 2 when 'dep' then 3 else 4 end as r from {kb_member_claims}) where repo not in (select repo from {kb_disabled}) group by repo)"


@_query(f"with {_LOC} select repo, place, root from loc", "kb_places")
def resolve_repo_name(places):
    return M.locate(places)


@_query(f"with {_LOC}, {_ROLES} select rl.repo, role, role in ('entry', 'edit') as editable, root from rl left join loc on loc.repo = rl.repo", "kb_member_claims", "kb_places", "kb_disabled")
def member_assembly(claims, places, disabled):
    return M.assemble(claims, M.locate(places), disabled)


@_query(f"with {_LOC} select d.repo, dep, root from {{kb_repo_deps}} d left join loc on loc.repo = dep", "kb_repo_deps", "kb_places")
def dependency_resolution(deps, places):
    return M.dependencies(deps, M.locate(places))


@_query("with recursive hit(repo) as (select 'AFRICA' union select d.dep from hit h join {kb_repo_deps} d on d.repo = h.repo where h.repo in (select repo from {kb_places})) select repo, repo in (select repo from {kb_places}) as mounted from hit", "kb_member_claims", "kb_repo_deps", "kb_places")
def member_fixpoint(claims, deps, places):
    return M.fixpoint(claims.where("role = 'entry'"), deps, M.locate(places))


@_query(
    f"with recursive {_LOC}, way(repo, dep) as (select l.repo, d.dep from loc l join {{kb_repo_deps}} d on d.repo = l.repo where place <> 'cache' union select w.repo, d.dep from way w join {{kb_repo_deps}} d on d.repo = w.dep where w.dep in (select repo from {{kb_pinned}}) or w.dep in (select repo from loc where place <> 'cache')) select repo, dep from way where dep in (select repo from {{kb_pinned}}) and repo <> dep",
    "kb_repo_deps", "kb_places", "kb_pinned",
)
def lock_partition(deps, places, pinned):
    return M.locks(deps, M.locate(places), pinned)


@_query(
    f"""with {_LOC}, has as (select distinct repo, role from {{kb_member_claims}}), live as (select * from has where repo not in (select repo from {{kb_disabled}}))
    select repo, 'duplicate-repo-name' as code, 'warning' as severity, place as about from {{kb_places}} group by repo, place having count(distinct root) > 1
    union all select repo, 'peer-unmounted', 'warning', dep from {{kb_repo_deps}} where dep not in (select repo from loc) and dep not in (select repo from {{kb_disabled}})
    union all select repo, role || '-member-unmounted', 'warning', null from live where role in ('edit', 'discover') and repo not in (select repo from loc)
    union all select repo, 'edit-member-read-only', 'warning', null from live where role = 'edit' and repo in (select repo from loc where place = 'cache')
    union all select repo, 'workspace-member-role-conflict', 'error', null from has group by repo having bool_or(role = 'edit') and bool_or(role = 'discover')
    union all select repo, 'discover-member-is-a-dependency', 'hint', null from has group by repo having bool_or(role = 'dep') and bool_or(role = 'discover')
    union all select repo, 'disabled-member-not-declared', 'warning', null from {{kb_disabled}} where repo not in (select repo from has)""",
    "kb_member_claims", "kb_places", "kb_repo_deps", "kb_disabled",
)
def workspace_consistency(claims, places, deps, disabled):
    return M.consistency(claims, places, deps, disabled)


@_query(
    f"with {_ROLES}, asked as (select repo || '/README.md' as path from rl where role in ('entry', 'edit')) select path, case when kind is null then 'repo-missing-readme' else 'readme-type-undeclared' end as code from asked left join {{kb_readmes}} using (path) where kind is distinct from 'readme' union all select path, 'readme-misplaced' from {{kb_readmes}} where kind = 'readme' and path <> repo || '/README.md'",
    "kb_member_claims", "kb_places", "kb_disabled", "kb_readmes",
)
def readme_obligation(claims, places, disabled, files):
    return M.readme_checks(files, M.assemble(claims, M.locate(places), disabled))


_XPARENTS = "xp as (select crepo || '::' || child as child, prepo || '::' || parent as parent from {kb_xparents})"
_XKEYS = lambda parents: parents.select(F.concat_ws("::", "crepo", "child").alias("child"), F.concat_ws("::", "prepo", "parent").alias("parent"))


@_query(f"with recursive {_XPARENTS}, hit(key) as (select repo || '::' || name from {{kb_xdefs}} where repo = 'ASIA' union select parent from hit join xp on child = key) select name, md5(body) as identity, min(repo) as repo from {{kb_xdefs}} where repo || '::' || name in (select key from hit) group by name, md5(body)", "kb_xdefs", "kb_xparents")
def cross_repo_fold(defs, parents):
    """What the definitions of ASIA reach in other repos, one row an identity."""
    return M.fold(defs.select("repo", "name", F.md5("body").alias("identity")), _XKEYS(parents), "ASIA")


@_query(f"with recursive {_XPARENTS}, r(name, member) as (select child, parent from xp union select r.name, xp.parent from r join xp on r.member = xp.child) select distinct name from r where name = member", "kb_xparents")
def cross_repo_cycles(parents):
    return T.cycles(_XKEYS(parents))


# ---- bodies

_UNDER = "(c.section = scope or starts_with(c.section, scope || ' / '))"


@_query(
    f"""with recursive {_UP}, due as (select f.path, s.scope, s.type, s.field, s.exclusive from {{kb_files}} f join up u on u.name = f.kind join {{kb_contracts}} s on s.type = u.ancestor where exists (select 1 from {{kb_sections}} x where x.path = f.path and x.section = s.scope)),
    body as (select * from {{kb_contributions}} where surface <> 'frontmatter')
    select distinct path, 'fills-contract-unmet' as code, scope, field from due d where not exists (select 1 from body c where c.path = d.path and c.field = d.field and {_UNDER})
    union all select d.path, 'fills-contract-exceeded', d.scope, c.field from (select distinct path, scope, type from due where exclusive) d join body c on c.path = d.path and {_UNDER} where not exists (select 1 from {{kb_contracts}} k where k.type = d.type and k.scope = d.scope and k.field = c.field)""",
    *_TP, "kb_files", "kb_contracts", "kb_sections", "kb_contributions",
)
def fills_contracts(types, parents, files, contracts, sections, contributions):
    return B.fills_contracts(files, _up(types, parents), contracts, sections, contributions)


@_query(
    f"with recursive {_UP}, {_EFFECTIVE} select type, scope, field, 'fills-unknown-field' as code from {{kb_contracts}} c where not exists (select 1 from eff where eff.name = c.type and eff.field = c.field) union all select distinct c.type, c.scope, c.field, 'fills-contract-conflict-nested-exclusivity' from {{kb_contracts}} c join {{kb_contracts}} o on o.type = c.type and o.exclusive and starts_with(c.scope, o.scope || ' / ') where not exists (select 1 from {{kb_contracts}} k where k.type = o.type and k.scope = o.scope and k.field = c.field)",
    *_TP, "kb_fields", "kb_contracts",
)
def contract_checks(types, parents, fields, contracts):
    up = _up(types, parents)
    return B.contract_checks(contracts, up, T.effective_fields(up, fields))


@_query(
    "with recursive s(type, place, section, use, trail) as (select type, lpad(cast(pos as varchar), 2, '0'), section, use, [type] from {kb_bodies} union all select s.type, s.place || '.' || lpad(cast(b.pos as varchar), 2, '0'), b.section, b.use, list_append(s.trail, b.type) from s join {kb_bodies} b on b.type = s.use where not list_contains(s.trail, s.use)) select type, place, section from s where use is null",
    "kb_bodies",
)
def body_splice(items):
    return B.splice(items)


@_query(
    f"with recursive {_UP}, uses as (select distinct type, use from {{kb_bodies}} where use is not null), r(a, b) as (select type, use from uses union select r.a, u.use from r join uses u on u.type = r.b) select type, use, 'body-use-out-of-closure' as code from uses where not exists (select 1 from up where name = type and ancestor = use) union all select type, use, 'body-use-target-has-no-body' from uses where use not in (select type from {{kb_bodies}}) union all select type, use, 'body-use-cycle' from uses where type in (select a from r where a = b) and use in (select a from r where a = b)",
    *_TP, "kb_bodies",
)
def body_use_checks(types, parents, items):
    steps = items.where("use is not null").select(F.col("type").alias("child"), F.col("use").alias("parent"))
    return B.use_checks(items, _up(types, parents), T.cycles(steps))


@_query(
    f"with recursive {_UP}, {_EFFECTIVE} select distinct c.path, c.field from {{kb_contributions}} c join {{kb_files}} f on f.path = c.path join eff e on e.name = f.kind and e.field = c.field where c.surface <> 'frontmatter' and not exists (select 1 from {{kb_values}} v where v.path = c.path and v.field = c.field) and not exists (select 1 from {{kb_contributions}} m where m.path = c.path and m.field = c.field and m.surface = 'frontmatter')",
    *_TP, "kb_fields", "kb_contributions", "kb_values", "kb_files",
)
def frontmatter_visibility(types, parents, fields, contributions, values, files):
    return B.frontmatter_visibility(contributions, values, files, T.effective_fields(_up(types, parents), fields))


@_query("select path, field, cast(i - 1 as integer) as at, ls[i] as value from (select path, field, ls, unnest(range(1, len(ls) + 1)) as i from (select path, field, string_split(text, ',') as ls from {kb_lists}))", "kb_lists")
def slot_contributions(lists):
    return B.slot_contributions(lists.select("path", "field", F.split("text", ",").alias("values")))


@_query(
    f"""with recursive {_UP}, seen as (select f.path, s.type, s.strict, (dir = '' or regexp_full_match(f.path[:length(f.path) - position('/' in reverse(f.path)) + 1], replace(replace(replace(replace(dir || '/', '.', '[.]'), '**/', chr(1)), '*', '[^/]+'), chr(1), '(?:[^/]+/)*')))
      and (s.name = '' or f.stem = replace(s.name, '%key%', cast(f.k as varchar))) and (ext = '' or ends_with(f.path, '.' || ext)) as met from {{kb_files}} f join up u on u.name = f.kind join {{kb_locations}} s on s.type = u.ancestor),
    whole as (select path, bool_or(met) as hit, bool_or(not strict) as soft from seen group by path)
    select path, case when strict then 'location-strict-violation' else 'location-partial-unmet' end as code, case when strict then 'error' else 'hint' end as severity, type as owner from seen join whole using (path) where not met and (strict or hit)
    union all select path, 'location-mismatch', 'warning', null from whole where not hit and soft""",
    *_TP, "kb_files", "kb_locations",
)
def location_checks(types, parents, files, specs):
    return B.location_checks(files, _up(types, parents), specs)


# ---- values and instances


@_query(
    f"""with recursive {_UP}, {_EFFECTIVE}, found as (
      select a.path, 'required-field-absent' as code from {{kb_asked}} a join eff e on e.name = a.kind and e.required where not exists (select 1 from {{kb_asked_values}} v where v.path = a.path and v.field = e.field)
      union all select a.path, 'field-shape-mismatch' from {{kb_asked}} a join {{kb_asked_values}} v on v.path = a.path join up u on u.name = a.kind join {{kb_fields}} f on f.type = u.ancestor and f.field = v.field and f.members <> '' where v.txt is not null and position(',' || v.txt || ',' in f.members) = 0
      union all select a.path, 'value-out-of-refinement' from {{kb_asked}} a join {{kb_asked_values}} v on v.path = a.path join up u on u.name = a.kind join {{kb_fields}} f on f.type = u.ancestor and f.field = v.field and starts_with(f.shape, 'Number{{') where v.num < f.min_v or v.num > f.max_v
      union all select path, 'unknown-type-claim' from {{kb_asked}} where kind not in (select name from {{kb_types}} where not is_abstract and not is_sealed)),
    codes as (select path, string_agg(distinct code, ',' order by code) as codes from found group by path)
    select a.path, a.kind, codes is null as valid, coalesce(codes, '') as codes from {{kb_asked}} a left join codes c on c.path = a.path""",
    *_TP, "kb_fields", "kb_asked", "kb_asked_values",
)
def validate_value(types, parents, fields, asked, values):
    up = _up(types, parents)
    return B.value_verdicts(asked, values, types, up, fields, T.effective_fields(up, fields))


@_query(f"with recursive {_UP} select distinct event_id, o.type, o.claim from {{kb_offers}} o join up a on a.name = o.type join up b on b.name = o.claim and b.ancestor = a.ancestor join {{kb_types}} t on t.name = a.ancestor and t.is_sealed where o.type <> o.claim", *_TP, "kb_offers")
def candidate_supersedes(types, parents, offers):
    return I.supersedes(offers.select("event_id", "type"), offers.select("event_id", "claim"), _up(types, parents), types.where("is_sealed").select("name"))


_ONE = "(select min(path) from {kb_files} where kind = 'vip')"


@_query(
    f"{_WITH}, d as ({_ALL}) select f.path, f.kind, (select count(*) from {{kb_values}} v where v.path = f.path) as n_values, coalesce((select string_agg(code || coalesce(':' || field, ''), ',' order by code || coalesce(':' || field, '')) from d where d.path = f.path), '') as found from {{kb_files}} f where f.path = {_ONE}",
    *_KB,
)
def instance(*tables):
    """One instance with its number of values and its diagnostics."""
    kb = dict(zip(_KB, tables))
    one = kb["kb_files"].where("kind = 'vip'").agg(F.min("path").alias("path"))
    mine = lambda df: df.join(F.broadcast(one), "path", "left_semi")  # noqa: E731 - one row
    codes = _diagnostics(*tables, mine=mine).select("path", F.concat("code", F.coalesce(F.concat(F.lit(":"), "field"), F.lit(""))).alias("c"))
    found = codes.groupBy("path").agg(F.array_join(F.sort_array(F.collect_list("c")), ",").alias("found"))
    n = mine(kb["kb_values"]).groupBy("path").agg(F.count("*").alias("n_values"))
    own = mine(kb["kb_files"]).select("path", "kind").join(n, "path", "left").join(found, "path", "left")
    return own.select("path", "kind", F.coalesce("n_values", F.lit(0)).alias("n_values"), F.coalesce("found", F.lit("")).alias("found"))
