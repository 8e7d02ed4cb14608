"""Registered queries over addresses, other repos, type definitions, instances and subscriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from typeloom.functions import text as X
from typeloom.operators import catalog as C
from typeloom.operators import deltas as D
from typeloom.operators import graph as G
from typeloom.operators import load_checks as L
from typeloom.operators import resolve as R
from typeloom.operators import typegraph as T
from typeloom.plans.registry import _EFFECTIVE, _HEADS, _KEYS, _LF, _RESOLVED, _TP, _UP, _query, _up

# ---- type definitions

_GRAPH = "g as (select name, owner, row_number() over (partition by name order by owner) = 1 as kept from {kb_defs})"
_IDS = "ids as (select d.name, d.owner, md5(d.name || '|' || d.extra || '|' || coalesce(t, '')) as identity from {kb_defs} d left join (select type, string_agg(field || ':' || shape, ';' order by field || ':' || shape) as t from {kb_fields} group by type) f on f.type = d.name)"


@_query(f"with {_GRAPH} select name, owner, kept from g", "kb_defs")
def type_graph_build(defs):
    return L.graph_of(defs)


@_query(f"with {_IDS} select distinct name, identity from ids", "kb_defs", "kb_fields")
def name_fits(defs, fields):
    return L.identities(defs, fields).select("name", "identity").distinct()


@_query(f"with {_IDS} select name, count(distinct identity) as n from ids group by name having count(distinct identity) > 1", "kb_defs", "kb_fields")
def name_conflicts(defs, fields):
    return L.name_conflicts(L.identities(defs, fields))


@_query(f"with {_GRAPH} select name, owner from g where kept order by name limit 10 offset 3", "kb_defs")
def types(defs):
    return L.types_page(defs, 10, 3)


@_query("select name, owner from {kb_defs} where owner = 'ext' order by name limit 6", "kb_defs")
def types_of_repo(defs):
    return L.types_page(defs, 6, owner="ext")


@_query("select name, 'redundant-abstract-on-sealed' as code from {kb_defs} where is_abstract and is_sealed", "kb_defs")
def redundant_abstract(defs):
    return L.redundant_abstract(defs)


@_query("select type, meta, 'required-meta-target-missing' as code from {kb_metas} where meta not in (select name from {kb_types})", "kb_metas", "kb_types")
def required_meta_targets(metas, types):
    return L.meta_targets(metas, types)


@_query("select type, meta, 'duplicate-meta' as code from {kb_metas} group by type, meta having count(*) > 1", "kb_metas")
def duplicate_meta(metas):
    return L.duplicate_meta(metas)


@_query(f"with recursive {_UP} select distinct u.name as type, r.meta from up u join {{kb_required_metas}} r on r.base = u.ancestor where not exists (select 1 from up v join {{kb_metas}} m on m.type = v.ancestor and m.meta = r.meta where v.name = u.name)", *_TP, "kb_metas", "kb_required_metas")
def unmet_required_meta(types, parents, metas, required):
    return L.unmet_meta(metas, required, _up(types, parents))


@_query("select f.type as name, field, 'brand-with-fields' as code from {kb_fields} f join {kb_brands} b on b.name = f.type union all select f.type, field, 'brand-not-referenceable' from {kb_fields} f join {kb_brands} b on starts_with(f.shape, b.name || '*') or starts_with(f.shape, b.name || '&')", "kb_fields", "kb_brands")
def brand_checks(fields, brands):
    return L.brand_checks(brands, fields)


@_query("select type, field, contains(shape, '*') or contains(shape, '&') as admits from {kb_fields}", "kb_fields")
def reference_slots(fields):
    return L.admits_reference(fields)


@_query(f"with recursive {_UP}, wider as (select name as operand, ancestor as wide from up where name <> ancestor union select name, 'any' from {{kb_types}}) select a.type, a.field, case when a.kind = 'union' then a.operand else b.operand end as flagged, case when a.kind = 'union' then b.operand else a.operand end as by from {{kb_operands}} a join {{kb_operands}} b on a.type = b.type and a.field = b.field join wider w on w.operand = a.operand and w.wide = b.operand", *_TP, "kb_operands")
def compound_subsumption(types, parents, operands):
    return L.compound_subsumption(operands, _up(types, parents))


@_query("select a.type, a.field, a.branch, b.branch as by from {kb_branches} a join {kb_branches} b on a.type = b.type and a.field = b.field and a.branch <> b.branch where a.low >= b.low and a.high <= b.high and not (a.low = b.low and a.high = b.high and a.branch < b.branch)", "kb_branches")
def cardinality_subsumption(branches):
    return L.cardinality_subsumption(branches)


@_query("select path, 'type-def-outside-type-dir' as code from {kb_def_files} where not contains('/' || path, '/type/')", "kb_def_files")
def type_defs_outside(files):
    return L.outside_type_dir(files)


@_query("select kind as type, path as referrer, 'claim' as how from {kb_files} union select parent, child, 'extends' from {kb_parents} union select member, parent, 'sealed' from {kb_sealed} union select target, type, 'slot' from {kb_refs}", "kb_files", "kb_parents", "kb_sealed", "kb_refs")
def type_referrers(files, parents, sealed, refs):
    return R.type_referrers(files, parents, sealed, refs)


# ---- addresses

_BLOCKS = "blk as (select path, block_id, min(n) as pos from {kb_inline} group by path, block_id)"


@_query(f"with {_BLOCKS} select src, dst, block, coalesce(pos, -1) as pos, case when pos is null then 'missing' else 'resolved' end as outcome from {{kb_block_links}} l left join blk on blk.path = l.dst and blk.block_id = l.block", "kb_block_links", "kb_inline")
def resolve_block_id(links, inline):
    return R.resolve_blocks(links, inline.select("path", "block_id", F.col("n").alias("pos"))).fillna(-1, ["pos"])


@_query("select path, string_agg(distinct block_id, ',' order by block_id) as ids, count(distinct block_id) as n from {kb_inline} group by path", "kb_inline")
def record_block_ids(inline):
    return inline.groupBy("path").agg(F.array_join(F.sort_array(F.collect_set("block_id")), ",").alias("ids"), F.countDistinct("block_id").alias("n"))


_ASKED = "asked as (select path as src, path as dst, case when length(path) % 3 = 0 then 'USER' when length(path) % 3 = 1 then 'Turn 1' else 'none' end as anchor from {kb_notes})"


@_query(f"with {_HEADS}, {_ASKED} select src, dst, anchor, coalesce(min(h.line), -1) as line, case when min(h.line) is null then 'missing' else 'resolved' end as outcome from asked left join h on h.path = asked.dst and lower(h.text) = lower(anchor) group by src, dst, anchor", "kb_notes")
def resolve_anchor(notes):
    n = F.length("path") % 3
    asked = notes.select(F.col("path").alias("src"), F.col("path").alias("dst"), F.when(n == 0, "USER").when(n == 1, "Turn 1").otherwise("none").alias("anchor"))
    return R.resolve_anchors(asked, X.headings(notes)).fillna(-1, ["line"])


@_query("with l as (select path, cast(i - 1 as integer) as pos, ls[i] as t from (select path, ls, unnest(range(1, len(ls) + 1)) as i from (select path, string_split(body, chr(10)) as ls from {kb_notes}))), s as (select *, coalesce(sum(strlen(t) + 1) over (partition by path order by pos rows between unbounded preceding and 1 preceding), 0) as b from l) select path, 'b' || cast(pos as varchar) as block_id, pos, cast(b as bigint) as start, cast(b + strlen(t) as bigint) as end from s where starts_with(t, '## ')", "kb_notes")
def block_span(notes):
    lines = notes.select("path", F.posexplode(F.split("body", "\n")).alias("pos", "text"))
    return R.block_spans(lines.withColumn("block_id", F.when(F.col("text").startswith("## "), F.concat(F.lit("b"), F.col("pos").cast("string"))).otherwise("")))


_ROUTED = "rt as (select l.*, case when l.scope is null or l.scope = l.repo then 'self' when d.scope is not null and r.repo is not null then 'dependency' when d.scope is not null then 'unavailable' when r.repo is not null then 'undeclared' else 'unknown' end as route from {kb_scoped_links} l left join {kb_repos} r on r.repo = l.scope left join (select distinct repo, scope from {kb_depends}) d on d.repo = l.repo and d.scope = l.scope)"


@_query(f"with {_ROUTED} select repo, scope, route, count(*) as n from rt group by all", "kb_scoped_links", "kb_repos", "kb_depends")
def cross_repo_routes(links, repos, depends):
    return R.route(links, repos, depends).groupBy("repo", "scope", "route").agg(F.count("*").alias("n"))


@_query(
    f"with {_ROUTED}, k as (select repo, lower(stem) as key, count(distinct path) as n, min(path) as path from {{kb_files}} group by 1, 2) select rt.src, rt.repo, rt.scope, rt.target, rt.route, case when route not in ('self', 'dependency') then route when n is null then 'missing' when n = 1 then 'resolved' else 'ambiguous' end as outcome, case when route in ('self', 'dependency') and n = 1 then k.path end as dst from rt left join k on k.repo = coalesce(rt.scope, rt.repo) and k.key = rt.target",
    "kb_scoped_links", "kb_repos", "kb_depends", "kb_files",
)
def cross_repo_resolve(links, repos, depends, files):
    return R.resolve_across(R.route(links, repos, depends), files)


@_query(f"with {_KEYS} select target, case when n = 1 then p end as dst from (select distinct target from {{kb_scoped_links}}) t left join (select key, count(distinct path) as n, min(path) as p from keys where rank > 0 group by key) k on k.key = lower(t.target)", "kb_scoped_links", "kb_files")
def resolve_any_repo(links, files):
    return R.resolve_any(links, files)


@_query(f"with {_KEYS}, gone as (select path from {{kb_files}} where kind = 'part' and k % 10 = 0) select key, rank, path from keys where path not in (select path from gone) union all select 'new/' || path, 0, 'new/' || path from gone union all select lower(stem) || '.md', 1, 'new/' || path from {{kb_files}} where path in (select path from gone) union all select lower(stem), 2, 'new/' || path from {{kb_files}} where path in (select path from gone)", "kb_files")
def index_update(files):
    """Names after every tenth part has moved below new/, kept without a rebuild."""
    moved = files.where("kind = 'part' and k % 10 = 0")
    return R.update_keys(G.file_keys(files), moved.select("path"), moved.select(F.concat(F.lit("new/"), "path").alias("path"), "stem"))


@_query(f"with {_RESOLVED} select distinct src from edge where dst in (select path from {{kb_files}} where kind = 'nation' and k < 5) and slot in (select field from {{kb_refs}})", *_LF, "kb_refs")
def identity_dependents(links, files, refs):
    return R.identity_dependents(G.edges(links, files), files.where("kind = 'nation' and k < 5"), refs)


@_query(
    "with recursive t(path, now, seq, steps) as (select old, old, cast(-1 as bigint), 0 from (select distinct old from {kb_moves}) union all select t.path, m.new, m.seq, t.steps + 1 from t join {kb_moves} m on m.old = t.now and m.seq > t.seq where not exists (select 1 from {kb_moves} x where x.old = t.now and x.seq > t.seq and x.seq < m.seq)) select path, arg_max(now, steps) as now, max(steps) as steps from t group by path",
    "kb_moves",
)
def forward_trace(moves):
    return R.trace_moves(moves, moves.select(F.col("old").alias("path")).distinct())


# ---- instances


@_query("select path, kind, string_agg(field || '=' || coalesce(txt, cast(cast(num as bigint) as varchar)), ';' order by field || '=' || coalesce(txt, cast(cast(num as bigint) as varchar))) as shown, count(*) as n from {kb_values} where field <> 'balance' and field <> 'total' group by path, kind", "kb_values")
def instances(values):
    """Every instance with the values that are whole numbers or text."""
    shown = F.concat_ws("=", "field", F.coalesce("txt", F.col("num").cast("long").cast("string")))
    return values.where("field <> 'balance' and field <> 'total'").groupBy("path", "kind").agg(F.array_join(F.sort_array(F.collect_list(shown)), ";").alias("shown"), F.count("*").alias("n"))


@_query(f"with recursive {_UP}, s as (select path, kind as type from {{kb_files}} union all select path, type from {{kb_inline}}) select distinct path from s where type in (select name from up where ancestor = 'line')", *_TP, "kb_files", "kb_inline")
def instance_files_of(types, parents, files, inline):
    """Files that are or hold an instance of ``line`` or a type below it."""
    below = _up(types, parents).where("ancestor = 'line'").select(F.col("name").alias("type"))
    sites = files.select("path", F.col("kind").alias("type")).unionByName(inline.select("path", "type"))
    return sites.join(F.broadcast(below), "type", "left_semi").select("path").distinct()  # a vocabulary's types


@_query(f"with recursive {_UP}, {_EFFECTIVE} select distinct v.path, v.field from {{kb_values}} v join eff e on e.name = v.kind and e.field = v.field and e.divergent", *_TP, "kb_fields", "kb_values")
def divergent_bare_use(types, parents, fields, values):
    return L.divergent_uses(values, T.effective_fields(_up(types, parents), fields))


_NULLED = "nulled as (select path, kind, field, case when path like '%7.md' then null else num end as num, case when path like '%7.md' then null else txt end as txt from {kb_values})"


@_query(f"with recursive {_UP}, {_EFFECTIVE}, {_NULLED} select n.path, n.field from nulled n join eff e on e.name = n.kind and e.field = n.field and e.required where num is null and txt is null and not exists (select 1 from {{kb_links}} l where l.src = n.path and l.slot = n.field)", *_TP, "kb_fields", "kb_values", "kb_links")
def null_anchor(types, parents, fields, values, links):
    """Null keys in files that end in 7; links with a slot fill theirs."""
    gone = F.col("path").like("%7.md")
    nulled = values.select("path", "kind", "field", F.when(~gone, F.col("num")).alias("num"), F.when(~gone, F.col("txt")).alias("txt"))
    return L.null_anchors(nulled, T.effective_fields(_up(types, parents), fields), links.where("slot is not null").select(F.col("src").alias("path"), F.col("slot").alias("field")))


@_query(
    f"with {_HEADS}, q as (select path, n, s from {{kb_notes}}, (values (0, 'user'), (1, 'assistant')) v(n, s)), f as (select path, text, min(line) as line from h where level = 1 group by path, text), j as (select q.path, q.n, q.s, f.line, max(f.line) over (partition by q.path order by q.n rows between unbounded preceding and 1 preceding) as m from q left join f on f.path = q.path and f.text = q.s) select path, s as section, case when line is null then 'required-section-missing' else 'section-out-of-order' end as code from j where line is null or line < m",
    "kb_notes",
)
def section_presence(notes):
    return L.section_presence(X.headings(notes), notes, ["user", "assistant"])


@_query("select path, strlen(body) as bytes, sha256(body) as hash, body from {kb_notes}", "kb_notes")
def content(notes):
    return notes.select("path", F.octet_length("body").cast("long").alias("bytes"), F.sha2("body", 256).alias("hash"), "body")


# ---- history and subscriptions


@_query("select path, commit_id from {kb_commit_files} where md5(path || '@' || status) in (select md5(path || '@' || status) from {kb_commit_files} where commit_id < 50)", "kb_commit_files")
def find_by_blob(changed):
    """Places that hold one of the blobs of the first commits."""
    blob = F.md5(F.concat_ws("@", "path", "status"))
    seen = changed.select("path", "commit_id", blob.alias("blob"))
    return seen.join(seen.where("commit_id < 50").select("blob").distinct(), "blob", "left_semi").select("path", "commit_id")


@_query("select path, 'removed' as change from {kb_files} where k % 10 = 1 union all select 'copy/' || path, 'added' from {kb_files} where k % 10 = 2", "kb_files")
def files_delta(files):
    """The path set before and after every file of key 1 mod 10 goes and copies of those of 2 mod 10 come."""
    before = files.select("path")
    after = files.where("k % 10 <> 1").select("path").unionByName(files.where("k % 10 = 2").select(F.concat(F.lit("copy/"), "path").alias("path")))
    return D.multiset_delta(before, after)


@_query(
    f"with {_IDS}, a as (select name, owner, identity from ids where owner <> 'core' or name <> 'part'), b as (select name, owner, case when name = 'vip' then 'new' else identity end as identity from ids where name <> 'both') select coalesce(a.name, b.name) as name, coalesce(a.owner, b.owner) as owner, case when a.identity is null then 'added' when b.identity is null then 'removed' else 'changed' end as change from a full join b on a.name = b.name and a.owner = b.owner where a.identity is distinct from b.identity",
    "kb_defs", "kb_fields",
)
def types_delta(defs, fields):
    """Identities that come, go or change between two vocabularies."""
    ids = L.identities(defs, fields)
    before = ids.where("owner <> 'core' or name <> 'part'")
    after = ids.where("name <> 'both'").withColumn("identity", F.when(F.col("name") == "vip", "new").otherwise(F.col("identity")))
    key = lambda df: df.select(F.concat_ws("@", "name", "owner").alias("key"), F.col("identity").alias("mark"))
    out = D.changes(key(before), key(after))
    return out.select(F.split("key", "@")[0].alias("name"), F.split("key", "@")[1].alias("owner"), F.when(F.col("change") == "modified", "changed").otherwise(F.col("change")).alias("change"))


@_query("select commit_id, day, subject from {kb_commits} where day > '1997-12-31'", "kb_commits")
def new_commits(commits):
    """What a subscriber that has seen 1997 gets."""
    return C.commits_since(commits, "1997-12-31")


@_query("select path, case when path like '%.type.yaml' or path like '%repo.yaml' then 'full' else 'incremental' end as how from (select path from {kb_def_files} union all select path from {kb_files} where k % 100 = 0 union all select repo || '/repo.yaml' from {kb_repos})", "kb_def_files", "kb_files", "kb_repos")
def classify_dirty(defs, files, repos):
    dirty = defs.select("path").unionByName(files.where("k % 100 = 0").select("path")).unionByName(repos.select(F.concat("repo", F.lit("/repo.yaml")).alias("path")))
    return D.classify_dirty(dirty)
