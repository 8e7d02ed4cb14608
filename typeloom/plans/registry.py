"""Every registered query of the library, with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.functions import text as X
from typeloom.operators import catalog as C
from typeloom.operators import deltas as D
from typeloom.operators import graph as G
from typeloom.operators import instances as I
from typeloom.operators import typegraph as T
from typeloom.operators import validate as V
from typeloom.plans.shared import written
from typeloom.sources.derive import knowledge_base, with_tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def _query(oracle: str | None, *tables: str):
    """Register a function of the derived tables ``kb_<name>`` (or raw tables) under its own name."""

    def register(f):
        name = f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            kb = knowledge_base(spark, sf_dir, *tables)
            return f(*[kb[t] for t in tables])

        _QUERIES[name] = run
        if oracle:
            _ORACLES[name] = with_tables(oracle)
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


# ---- pieces of SQL that several oracles share

_KEYS = "keys as (select path as key, 0 as rank, path from {kb_files} union all select lower(path[length(path) - position('/' in reverse(path)) + 2:]), 1, path from {kb_files} union all select lower(stem), 2, path from {kb_files})"
_RESOLVED = (
    _KEYS
    + """,
tg as (select distinct target, case when position('/' in target) > 0 then target else lower(target) end as key, starts_with(target, '../') as esc from {kb_links} where pin is null),
hit as (select target, rank, count(distinct path) as n, min(path) as path from tg join keys using (key) where not esc group by target, rank),
best as (select target, arg_min(n, rank) as n, arg_min(path, rank) as path from hit group by target),
res as (select l.*, case when l.pin is null and b.n = 1 then b.path end as dst,
  case when l.pin is not null then 'pinned' when t.esc then 'escaping' when b.n is null then 'missing' when b.n = 1 then 'resolved' else 'ambiguous' end as outcome
  from {kb_links} l left join tg t on l.target = t.target left join best b on l.target = b.target),
edge as (select src, dst, slot, surface from res where outcome = 'resolved')"""
)
_UP = "up(name, ancestor) as (select name, name from {kb_types} union select u.name, p.parent from up u join {kb_parents} p on u.ancestor = p.child join {kb_types} t on p.parent = t.name)"
_EFFECTIVE = "eff as (select u.name, f.field, case when min(shape) = max(shape) then min(shape) end as shape, bool_or(not optional) as required, min(shape) <> max(shape) as divergent, string_agg(distinct f.type, ',' order by f.type) as origins from up u join {kb_fields} f on u.ancestor = f.type group by u.name, f.field)"
_SITES = "site as (select path as site, kind as type, 'file' as origin from {kb_files} union all select path || '#items/' || cast(n as varchar), type, 'nested' from {kb_inline})"
_CANDIDATES = """usable as (select name as type from {kb_types} where not is_abstract and not is_sealed),
need as (select e.name as type, e.field, e.required from eff e where e.name in (select type from usable)),
tot as (select type, count(*) as required from need where required group by type),
hits as (select event_id, type, count(*) filter (required) as have, count(*) filter (not required) as also_optional from (select distinct event_id, field from {kb_records}) r join need using (field) group by event_id, type),
cand as (select event_id, h.type, t.required, also_optional from hits h join tot t on h.type = t.type where have = t.required)"""

_LF = ("kb_links", "kb_files")
_TP = ("kb_types", "kb_parents")


# ---- reference graph


@_query(f"with {_RESOLVED} select dst as path, count(*) filter (slot is not null) as structural, count(*) as total from edge group by dst order by 2 desc, 3 desc, 1 limit 100", *_LF)
def hubs(links, files):
    return G.hubs(links, files, limit=100)


@_query(f"with {_RESOLVED} select dst as path, count(*) filter (slot is not null) as structural, count(*) as total from edge group by dst", *_LF)
def hub_counts(links, files):
    return G.hubs(links, files)


@_query(f"with {_RESOLVED} select outcome, surface, count(*) as n from res group by outcome, surface", *_LF)
def resolve_target(links, files):
    return G.resolve_links(links, files).groupBy("outcome", "surface").agg(F.count("*").alias("n"))


@_query(f"with {_RESOLVED} select src, target, dst, case when outcome = 'pinned' then 'pin' when outcome <> 'resolved' then 'broken' when surface = 'frontmatter' then 'field' when surface = 'body' and slot is not null then 'contributing' else 'navigational' end as kind from res", *_LF)
def references_out(links, files):
    return G.references_out(links, files)


@_query(f"with {_RESOLVED} select dst, count(*) filter (surface = 'frontmatter') as field, count(*) filter (surface = 'body' and slot is not null) as contributing, count(*) filter (surface <> 'frontmatter' and slot is null) as navigational from edge group by dst", *_LF)
def references_in(links, files):
    return G.references_in(links, files)


_LINK_GRAPH = "deg as (select path, sum(o) as o, sum(i) as i from (select src as path, 1 as o, 0 as i from edge union all select dst, 0, 1 from edge) group by path), lg as (select f.path, f.kind, cast(coalesce(o, 0) as bigint) as out_degree, cast(coalesce(i, 0) as bigint) as in_degree from {kb_files} f left join deg using (path))"


@_query(f"with {_RESOLVED}, {_LINK_GRAPH} select path, kind, out_degree, in_degree from lg", *_LF)
def link_graph(links, files):
    return G.link_graph(links, files)


@_query(f"with {_RESOLVED}, {_LINK_GRAPH} select 'in' as direction, in_degree as degree, count(*) as n from lg group by 2 union all select 'out', out_degree, count(*) from lg group by 2", *_LF)
def degree_histogram(links, files):
    return G.degree_histogram(links, files)


@_query(None, *_LF)
def weak_components(links, files):
    """Every file over every resolved link; recursive SQL is too slow for them, the tests hold it against a union-find."""
    return G.weak_components(links, files)


@_query(None, *_LF)
def graph_shape(links, files):
    return G.graph_shape(links, files)


_SEED = "select min(path) as path from {kb_files} where kind = 'supplier'"


@_query(
    f"""with {_RESOLVED}, step as (select src as near, dst as far from edge union select dst, src from edge),
    l0 as ({_SEED}), l1 as (select distinct far as path from step join l0 on near = path where far not in (select path from l0)),
    l2 as (select distinct far as path from step join l1 on near = path where far not in (select path from l0 union select path from l1))
    select path, 0 as depth from l0 union all select path, 1 from l1 union all select path, 2 from l2""",
    *_LF,
)
def neighborhood(links, files):
    seed = files.where("kind = 'supplier'").agg(F.min("path").alias("path"))
    return G.neighborhood(G.edges(links, files), seed, 2)


@_query(
    f"with {_RESOLVED}, l0 as ({_SEED}), l1 as (select distinct src as path from edge join l0 on dst = path where src not in (select path from l0)) select path, 0 as depth from l0 union all select path, 1 from (select path from l1 order by path limit 9)",
    *_LF,
)
def neighborhood_budget(links, files):
    """Inbound neighbours under a node budget of ten: within the level, paths in order."""
    seed = files.where("kind = 'supplier'").agg(F.min("path").alias("path"))
    return G.neighborhood(G.edges(links, files), seed, 1, "in", budget=10)


@_query("select target, pin, count(*) as n from {kb_links} where pin is not null group by all", "kb_links")
def pins(links):
    return G.pins(links)


@_query("select distinct src from {kb_links} where lower(target) in (select lower(stem) from {kb_files} where kind = 'region' union select lower(stem) || '.md' from {kb_files} where kind = 'region')", *_LF)
def edge_flip_sources(links, files):
    return G.edge_flip_sources(links, files.where("kind = 'region'"))


@_query("select distinct lower(target) as key, src from {kb_links}", "kb_links")
def referenced_names(links):
    return G.referenced_names(links)


@_query("select page_id, cast(i - 1 as integer) as pos, hs[i] as href from (select page_id, hs, unnest(range(1, len(hs) + 1)) as i from (select page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) as hs from {pages}))", "pages")
def external_links(pages):
    return G.external_links(pages)


# ---- type graph


def _up(types, parents):
    return T.closure(types, parents)


@_query(f"with recursive {_UP} select name, ancestor from up", *_TP)
def type_closure(types, parents):
    return _up(types, parents)


@_query(f"with recursive {_UP} select ancestor as base, name from up where name <> ancestor", *_TP)
def subtypes(types, parents):
    return T.subtypes(types, _up(types, parents))


@_query("with recursive step as (select child, parent from {kb_parents} union select type, target from {kb_refs}), r(name, member) as (select name, name from {kb_types} union select r.name, s.parent from r join step s on r.member = s.child) select name, member from r", *_TP, "kb_refs")
def referenced_closure(types, parents, refs):
    return T.referenced_closure(types, parents, refs)


@_query("select parent as name, string_agg(distinct child, ',' order by child) as children from {kb_parents} group by parent", "kb_parents")
def children_of(parents):
    return T.children(parents)


@_query("select name, is_abstract or is_sealed as is_abstract, is_sealed from {kb_types}", "kb_types")
def abstract_types(types):
    return T.is_abstract(types)


@_query("select t.name, p.parent from {kb_types} t left join (select * from {kb_parents} where parent in (select name from {kb_types})) p on t.name = p.child", *_TP)
def type_tree(types, parents):
    return T.type_tree(types, parents)


@_query("select owner, count(*) as n from {kb_types} group by rollup (owner)", "kb_types")
def type_counts(types):
    return T.type_counts(types)


@_query(f"with recursive {_UP}, {_EFFECTIVE} select name, field, shape, required, divergent, origins from eff", *_TP, "kb_fields")
def effective_shape(types, parents, fields):
    return T.effective_fields(_up(types, parents), fields)


@_query(
    f"""with recursive {_UP}, org as (select u.name, f.field, f.type as origin from up u join {{kb_fields}} f on u.ancestor = f.type),
    asked as (select distinct u.name, o.field, u.ancestor as qualifier from up u join org o using (name))
    select a.name, a.field, a.qualifier, count(w.ancestor) as n from asked a left join org o on o.name = a.name and o.field = a.field left join up w on w.name = a.qualifier and w.ancestor = o.origin group by all""",
    *_TP, "kb_fields",
)
def qualifier_candidates(types, parents, fields):
    return T.qualifier_candidates(_up(types, parents), fields)


@_query("with recursive r(name, member) as (select child, parent from {kb_parents} union select r.name, p.parent from r join {kb_parents} p on r.member = p.child) select distinct name from r where name = member", "kb_parents")
def type_cycles(parents):
    return T.cycles(parents)


@_query("select child as name, parent as target from {kb_parents} where parent not in (select name from {kb_types})", *_TP)
def absent_parents(types, parents):
    return T.absent_parents(types, parents)


@_query("select type as name, field, target from {kb_refs} where target not in (select name from {kb_types})", "kb_types", "kb_refs")
def absent_slot_types(types, refs):
    return T.absent_slot_types(types, refs)


@_query("select name, case when name in ('String', 'Number', 'Boolean', 'Date', 'DateTime', 'Url', 'any', 'opaque', 'file', 'type') then 'reserved-type-name' else 'invalid-type-name' end as code from {kb_types} where name in ('String', 'Number', 'Boolean', 'Date', 'DateTime', 'Url', 'any', 'opaque', 'file', 'type') or not regexp_full_match(name, '[a-z][A-Za-z0-9_]*')", "kb_types")
def type_names(types):
    return T.bad_names(types)


@_query(f"with recursive {_UP} select u.name, m.field, u.ancestor from up u join {{kb_fields}} m on m.type = u.name join {{kb_fields}} t on t.type = u.ancestor and t.field = m.field where u.name <> u.ancestor", *_TP, "kb_fields")
def field_redeclaration(types, parents, fields):
    return T.field_redeclarations(_up(types, parents), fields)


@_query(f"with recursive {_UP} select u.name, u.ancestor as root from up u join {{kb_types}} t on t.name = u.ancestor and t.is_sealed where u.name <> u.ancestor and not exists (select 1 from up v join {{kb_sealed}} s on s.member = v.ancestor and s.parent = u.ancestor where v.name = u.name)", *_TP, "kb_sealed")
def sealed_reachability(types, parents, sealed):
    return T.sealed_breaches(types, _up(types, parents), sealed)


@_query(f"with recursive {_UP} select s.parent as root, s.member, count(*) as n from {{kb_sealed}} s join up u on u.ancestor = s.member group by all", *_TP, "kb_sealed")
def sealed_families(types, parents, sealed):
    return T.sealed_families(_up(types, parents), sealed)


@_query("select type, field from {kb_fields} where min_v > max_v", "kb_fields")
def refinement_unsatisfiable(fields):
    return T.unsatisfiable_refinements(fields)


@_query("select distinct c.owner, p.parent as target from {kb_parents} p join {kb_types} c on c.name = p.child join {kb_types} t on t.name = p.parent where c.owner <> t.owner", *_TP)
def imports(types, parents):
    return T.imports(types, parents)


@_query(
    "select from_node, to_node, relation, count(*) as n from (select child as from_node, parent as to_node, 'subtype' as relation from {kb_parents} union all select type, target, 'field-type' from {kb_refs} union all select 'instances', kind, 'instance-of' from {kb_files}) where to_node in (select name from {kb_types}) group by all",
    *_TP, "kb_refs", "kb_files",
)
def type_graph(types, parents, refs, files):
    return T.type_graph(types, parents, refs, files)


@_query("select cast(a.pos as integer) as pos, a.asked, t.owner from (values (0, 'part'), (1, 'missing'), (2, 'vip'), (3, 'part')) a(pos, asked) left join {kb_types} t on t.name = a.asked", "kb_types")
def type_batch(types):
    return T.type_batch(types, ["part", "missing", "vip", "part"])


# claims: every file claims its kind; some claim more, on purpose wrongly
_CLAIMS = "claims as (select path, kind as claim from {kb_files} union all select path, 'party' from {kb_files} where kind = 'vip' union all select path, 'supplier' from {kb_files} where kind = 'customer' and k % 100 = 0 union all select path, kind from {kb_files} where kind = 'nation' and k % 9 = 0 union all select path, 'nonsense' from {kb_files} where kind = 'part' and k % 500 = 0 union all select path, 'audited' from {kb_files} where kind = 'supplier' and k % 20 = 0)"


def _claims(files):
    more = lambda claim, rule: files.where(rule).select("path", F.lit(claim).alias("claim"))
    own = files.select("path", F.col("kind").alias("claim"))
    parts = [own, more("party", "kind = 'vip'"), more("supplier", "kind = 'customer' and k % 100 = 0"), more("nation", "kind = 'nation' and k % 9 = 0"), more("nonsense", "kind = 'part' and k % 500 = 0"), more("audited", "kind = 'supplier' and k % 20 = 0")]
    return V.union_all(parts)


@_query(f"with recursive {_UP}, {_CLAIMS} select path, claim, 'duplicate-claim' as code from claims group by 1, 2 having count(*) > 1 union all select path, claim, 'subsumption-in-mixin' from (select distinct c.path, u.ancestor as claim from claims c join up u on u.name = c.claim and u.name <> u.ancestor) w where exists (select 1 from claims c where c.path = w.path and c.claim = w.claim)", *_TP, "kb_files")
def redundant_claims(types, parents, files):
    return T.redundant_claims(_claims(files), _up(types, parents))


@_query(f"with {_CLAIMS} select path, code, 'error' as severity, field from (select c.path, c.claim as field, case when t.name is null then 'unknown-type-claim' when is_sealed then 'sealed-parent-claimed' when is_abstract then 'abstract-type-claimed' end as code from claims c left join {{kb_types}} t on t.name = c.claim) where code is not null", "kb_types", "kb_files")
def claim_legality(types, files):
    return V.claim_legality(_claims(files), types)


@_query(f"with recursive {_UP}, {_CLAIMS} select path, 'multi-leaf-in-sealed-family' as code, 'error' as severity, s.parent as field from claims c join up u on u.name = c.claim join {{kb_sealed}} s on s.member = u.ancestor group by path, s.parent having count(distinct s.member) > 1", *_TP, "kb_sealed", "kb_files")
def multi_leaf_in_sealed_family(types, parents, sealed, files):
    return V.multi_leaf(_claims(files), _up(types, parents), sealed)


# ---- instances


@_query(f"with recursive {_UP}, {_SITES} select site, type, origin, type = 'document' as claimed from site where type in (select name from up where ancestor = 'document')", *_TP, "kb_files", "kb_inline")
def instances_of(types, parents, files, inline):
    return I.instances_of(files, inline, _up(types, parents), "document")


@_query(f"with recursive {_UP}, {_SITES} select u.ancestor as name, count(*) as n from site s join up u on u.name = s.type group by 1 union all select null, count(*) from site", *_TP, "kb_files", "kb_inline")
def instance_counts(types, parents, files, inline):
    return I.instance_counts(files, inline, _up(types, parents))


@_query(f"with recursive {_UP}, {_EFFECTIVE}, {_CANDIDATES} select event_id, type, required, also_optional from cand", *_TP, "kb_fields", "kb_records")
def candidates(types, parents, fields, records):
    return I.candidates(records, types, T.effective_fields(_up(types, parents), fields))


@_query(f"with recursive {_UP}, {_EFFECTIVE}, {_CANDIDATES} select type, count(distinct event_id) as n from cand group by type", *_TP, "kb_fields", "kb_records")
def candidate_counts(types, parents, fields, records):
    return I.candidate_counts(I.candidates(records, types, T.effective_fields(_up(types, parents), fields)))


@_query(f"with recursive {_UP}, {_EFFECTIVE}, {_CANDIDATES} select event_id, type from (select *, row_number() over (partition by event_id order by required desc, also_optional desc, type) as r from cand) where r = 1", *_TP, "kb_fields", "kb_records")
def candidate_ranking(types, parents, fields, records):
    return I.best_candidates(I.candidates(records, types, T.effective_fields(_up(types, parents), fields)))


@_query(
    """with c as (select src as path, coalesce(slot, 'links') as field, lower(target) as value, surface from {kb_links} union all select src, 'links', lower(target), 'doc' from {kb_links} where pos > 100)
    select path, field, value, string_agg(distinct surface, ',' order by surface) as surfaces, count(*) as n from c group by path, field, value""",
    "kb_links",
)
def effective_values(links):
    own = links.select(F.col("src").alias("path"), F.coalesce("slot", F.lit("links")).alias("field"), F.lower("target").alias("value"), "surface")
    doc = links.where("pos > 100").select(F.col("src").alias("path"), F.lit("links").alias("field"), F.lower("target").alias("value"), F.lit("doc").alias("surface"))
    return I.value_containers(own.unionByName(doc))


# ---- validation

_D = {
    "required_field_absent": "select f.path, 'required-field-absent' as code, 'error' as severity, e.field from {kb_files} f join eff e on e.name = f.kind and e.required and e.field <> 'items' where not exists (select 1 from {kb_values} v where v.path = f.path and v.field = e.field)",
    "enum_mismatch": "select v.path, 'field-shape-mismatch' as code, 'error' as severity, v.field from {kb_values} v join up u on u.name = v.kind join {kb_fields} f on f.type = u.ancestor and f.field = v.field and f.members <> '' where v.txt is not null and position(',' || v.txt || ',' in f.members) = 0",
    "value_out_of_refinement": "select v.path, 'value-out-of-refinement' as code, 'error' as severity, v.field from {kb_values} v join (select distinct u.name as kind, f.field, f.min_v, f.max_v from up u join {kb_fields} f on f.type = u.ancestor where f.shape like 'Number{%') r on r.kind = v.kind and r.field = v.field where v.num < r.min_v or v.num > r.max_v",
    "nested_out_of_refinement": "select path, 'value-out-of-refinement' as code, 'error' as severity, 'items.' || f.field as field from (select path, type, 'quantity' as field, quantity as num from {kb_inline} union all select path, type, 'discount', discount from {kb_inline}) i join {kb_fields} f on f.type = i.type and f.field = i.field where num < min_v or num > max_v",
    "cardinality": "select f.path, 'cardinality-mismatch' as code, 'error' as severity, 'items' as field from {kb_files} f left join (select path, count(*) as n from {kb_inline} group by path) i on i.path = f.path where f.kind in ('order', 'rush_order') and not coalesce(n, 0) between 1 and 5",
    "duplicate_block_ids": "select path, 'duplicate-block-id' as code, 'warning' as severity, block_id as field from (select *, row_number() over (partition by path, block_id order by n) as r from {kb_inline}) where r > 1",
    "dangling_links": "select src as path, 'reference-target-' || outcome as code, case when slot is null then 'warning' else 'error' end as severity, slot as field from res where outcome in ('missing', 'ambiguous', 'escaping')",
    "target_type_mismatch": "select e.src as path, 'reference-target-type-mismatch' as code, 'error' as severity, e.slot as field from edge e join {kb_files} d on d.path = e.dst join {kb_files} s on s.path = e.src join up u on u.name = s.kind join {kb_refs} r on r.type = u.ancestor and r.field = e.slot where not exists (select 1 from up w where w.name = d.kind and w.ancestor = r.target)",
}
_ALL = " union all ".join(f"({sql})" for sql in _D.values())
_WITH = f"with recursive {_UP}, {_EFFECTIVE}, {_RESOLVED}"
_VOCABULARY = (*_TP, "kb_fields")


@_query(f"{_WITH} {_D['required_field_absent']}", *_VOCABULARY, "kb_files", "kb_values")
def required_field_absent(types, parents, fields, files, values):
    return V.required_absent(files, values, T.effective_fields(_up(types, parents), fields))


@_query(f"{_WITH} {_D['enum_mismatch']}", *_VOCABULARY, "kb_values")
def enum_mismatch(types, parents, fields, values):
    return V.enum_mismatch(values, _up(types, parents), fields)


@_query(f"{_WITH} {_D['value_out_of_refinement']}", *_VOCABULARY, "kb_values")
def value_out_of_refinement(types, parents, fields, values):
    return V.out_of_refinement(values, _up(types, parents), fields)


@_query(_D["nested_out_of_refinement"], "kb_inline", "kb_fields")
def nested_out_of_refinement(inline, fields):
    return V.nested_out_of_refinement(inline, fields)


@_query(_D["cardinality"], "kb_files", "kb_inline")
def cardinality(files, inline):
    return V.cardinality(files, inline, 1, 5, ("order", "rush_order"))


@_query(_D["duplicate_block_ids"], "kb_inline")
def duplicate_block_ids(inline):
    return V.duplicate_block_ids(inline)


@_query(f"{_WITH} {_D['dangling_links']}", *_LF)
def dangling_links(links, files):
    return V.dangling(links, files)


@_query(f"{_WITH} {_D['target_type_mismatch']}", *_VOCABULARY, *_LF, "kb_refs")
def target_type_mismatch(types, parents, fields, links, files, refs):
    return V.target_type_mismatch(links, files, _up(types, parents), refs)


_KB = ("kb_types", "kb_parents", "kb_fields", "kb_files", "kb_values", "kb_links", "kb_inline", "kb_refs")


def _diagnostics(*tables, mine=None):
    """All diagnostics, or those of the files that ``mine`` keeps of a table with a path: each comes from its file's own rows and the files its links name."""
    kb = dict(zip(_KB, tables))
    files, up = kb["kb_files"], _up(kb["kb_types"], kb["kb_parents"])
    if mine:
        kb |= {t: mine(kb[t]) for t in ("kb_files", "kb_values", "kb_inline")}
        kb["kb_links"] = mine(kb["kb_links"].withColumnRenamed("src", "path")).withColumnRenamed("path", "src")
    resolved = written(V.faulty(G.resolve_links(kb["kb_links"], files)), "resolved")
    return V.diagnostics(kb, up, T.effective_fields(up, kb["kb_fields"]), resolved, files)


@_query(f"{_WITH} {_ALL}", *_KB)
def diagnostics(*tables):
    return _diagnostics(*tables)


@_query(f"{_WITH}, d as ({_ALL}) select severity, code, count(*) as n from d group by grouping sets ((), (severity), (code))", *_KB)
def diagnostic_counts(*tables):
    return V.counts(written(_diagnostics(*tables), "diagnostics"))


@_query(f"{_WITH}, d as ({_ALL}) select path, code, severity, field from d where starts_with(path, 'ASIA/order/')", *_KB)
def diagnostics_under(*tables):
    return _diagnostics(*tables, mine=lambda df: V.under(df, "ASIA/order"))


@_query(f"{_WITH}, d as ({_ALL}) select path, code, severity, field from d order by path, code, field nulls first limit 50 offset 100", *_KB)
def diagnostics_page(*tables):
    return I.pages_of(_diagnostics(*tables), ["path", "code", F.asc_nulls_first("field")], 50, 100)


@_query("with a as (select path, 'x' as code from {kb_inline} where n > 3), b as (select path, 'x' as code from {kb_inline} where n > 2 and n < 6) select path, count(*) filter (c = 'added') as added, count(*) filter (c = 'removed') as removed from (select path, 'removed' as c from (select * from a except all select * from b) union all select path, 'added' from (select * from b except all select * from a)) group by path", "kb_inline")
def preview_mutation(inline):
    """Diagnostics of lines beyond a bound, before and after the bound moves."""
    mark = lambda rule: inline.where(rule).select("path", F.lit("x").alias("code"))
    return D.blast_radius(mark("n > 3"), mark("n > 2 and n < 6"))


# ---- catalogue and history


@_query("select path, stem, kind from {kb_files} order by string_split(path, '/'), k limit 200 offset 300", "kb_files")
def files_page(files):
    return C.files_page(files, 200, 300)


@_query("select distinct string_split(path[6:], '/')[1] as name, position('/' in path[6:]) > 0 as is_dir from {kb_files} where starts_with(path, 'ASIA/')", "kb_files")
def dir_entries(files):
    return C.dir_entries(files, "ASIA")


@_query("select repo, string_split(path, '/')[2] as dir, count(*) as n from {kb_files} group by all", "kb_files")
def top_level_dirs(files):
    return C.top_level_dirs(files)


@_query("select path, arg_max(root_repo, length(root)) as repo from (select f.path, r.root, r.root_repo from {kb_files} f left join (select repo as root_repo, repo as root from {kb_repos} union all select 'parts', 'ASIA/part') r on starts_with(f.path, r.root || '/') or f.path = r.root) group by path", "kb_files", "kb_repos")
def resolve_member(files, repos):
    nested = files.sparkSession.createDataFrame([("parts", "ASIA/part")], "repo string, root string")
    return C.resolve_member(files, repos.select("repo", F.col("repo").alias("root")).unionByName(nested))


@_query("select path, stem, kind from {kb_files} where repo in (select repo from {kb_repos} where editable)", "kb_files", "kb_repos")
def scope_own(files, repos):
    return C.in_scope(files, repos).select("path", "stem", "kind")


@_query("select r.repo, role, editable, count(path) as files, count(distinct kind) as kinds from {kb_repos} r left join {kb_files} f using (repo) group by all", "kb_files", "kb_repos")
def overview(files, repos):
    return C.overview(files, repos)


@_query("select repo, lower(stem) as stem, count(distinct path) as n from {kb_files} group by 1, 2 having count(distinct path) > 1", "kb_files")
def name_collisions(files):
    return C.name_collisions(files)


@_query("select c_nationkey as key, count(distinct c_mktsegment) as n from {customer} group by 1 having count(distinct c_mktsegment) > 1", "customer")
def identity_conflicts(customer):
    return C.conflicts(customer.select(F.col("c_nationkey").alias("key"), "c_mktsegment"), "key", "c_mktsegment")


@_query("select commit_id, day, author, subject, trailer from {kb_commits} order by day desc, commit_id limit 100", "kb_commits")
def recent_commits(commits):
    return C.recent_commits(commits, 100)


@_query("select path, commit_id, day, status, row_number() over (partition by path order by day desc, commit_id, status) as place from {kb_commit_files} join {kb_commits} using (commit_id)", "kb_commits", "kb_commit_files")
def file_history(commits, changed):
    return C.file_history(commits, changed)


@_query("select cast(a.pos as integer) as pos, cast(a.commit_id as bigint) as commit_id, c.subject, c.subject is not null as available from (values (0, 5), (1, -1), (2, 7)) a(pos, commit_id) left join {kb_commits} c on c.commit_id = a.commit_id", "kb_commits")
def commit_meta(commits):
    return C.commit_meta(commits, [5, -1, 7])


@_query("select commit_id, regexp_extract(trailer, '^([A-Za-z][A-Za-z-]*): +(.+)$', 1) as key, regexp_extract(trailer, '^([A-Za-z][A-Za-z-]*): +(.+)$', 2) as value from {kb_commits} where regexp_matches(trailer, '^([A-Za-z][A-Za-z-]*): +(.+)$')", "kb_commits")
def trailers(commits):
    return C.trailers(commits)


@_query("select path from (select path, status, row_number() over (partition by path order by day desc, commit_id desc, status desc) as r from {kb_commit_files} join {kb_commits} using (commit_id) where day between '1996-01-01' and '1996-12-31') where r = 1 and status = 'D'", "kb_commits", "kb_commit_files")
def deleted_between(commits, changed):
    return C.deleted_between(commits, changed, "1996-01-01", "1996-12-31")


# ---- versions

_SNAP = "select user_id as key, arg_max(event_type, row(ts, event_type)) as mark from {events} where ts < (select mid from m{k}) group by 1"


@_query(
    """with b as (select min(ts) + (max(ts) - min(ts)) / 2 as mid from {events}),
    s1 as (select user_id as key, max(row(ts, event_type)) as m from {events} where ts < (select mid from b) group by 1), s2 as (select user_id as key, max(row(ts, event_type)) as m from {events} group by 1),
    j as (select coalesce(s1.key, s2.key) as key, s1.m[2] as old, s2.m[2] as new from s1 full join s2 on s1.key = s2.key)
    select key, case when old is null then 'added' when new is null then 'removed' else 'modified' end as change from j where old is distinct from new""",
    "events",
)
def changes(events):
    span = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    rows = events.select(F.col("user_id").alias("key"), "ts", F.col("event_type").alias("mark"))
    middle = span.a + (span.b - span.a) / 2
    full = rows.groupBy("key").agg(F.max(F.struct("ts", "mark")).alias("m")).select("key", F.col("m.mark").alias("mark"))
    return D.changes(D.snapshot(rows, middle.isoformat(sep=" ")), full)


@_query("with a as (select src, target from {kb_links} where pos < 103), b as (select src, target from {kb_links} where pos > 1) select src, target, 'removed' as change from (select * from a except all select * from b) union all select src, target, 'added' from (select * from b except all select * from a)", "kb_links")
def link_graph_delta(links):
    own = links.select("src", "target", "pos")
    return D.multiset_delta(own.where("pos < 103").drop("pos"), own.where("pos > 1").drop("pos"))


@_query("with a as (select path, n from {kb_inline} where quantity > 40), b as (select path, n from {kb_inline} where quantity > 42) select distinct path from ((select * from a except all select * from b) union all (select * from b except all select * from a))", "kb_inline")
def diagnostics_delta(inline):
    mark = lambda rule: inline.where(rule).select("path", "n")
    return D.touched_files(mark("quantity > 40"), mark("quantity > 42"))


@_query("select path from {kb_files} where starts_with(path, 'ASIA/part/') or starts_with(path, 'EUROPE/order/')", "kb_files")
def expand_removed_directories(files):
    gone = files.sparkSession.createDataFrame([("ASIA/part",), ("EUROPE/order",)], "dir string")
    return D.expand_removed(gone, files)


@_query("select path, 'again' as state from {kb_files} where k % 10 = 0 union all select path, 'kept' from {kb_files} where k % 10 <> 0", "kb_files")
def parse_reuse(files):
    now = files.groupBy("path").agg(F.min("k").alias("k"), F.min(F.col("k").cast("string")).alias("hash"))
    stored = now.where("k % 10 <> 0").select("path", "hash")
    kept, again = D.reusable(stored, now)
    return kept.select("path", F.lit("kept").alias("state")).unionByName(again.select("path", F.lit("again").alias("state")))


# ---- text


_PARTS = ", ".join(f"regexp_extract(link, link_re, {i + 1}) as {n}" for i, n in enumerate(X.PARTS))


@_query(f"with r as (select '{X.LINK}' as link_re), l as (select path, link_re, unnest(range(len(ls))) as pos, unnest(ls) as link from (select path, link_re, regexp_extract_all(body, link_re) as ls from {{kb_notes}}, r)) select path, cast(pos as integer) as pos, {_PARTS} from l".replace("{kb_notes}", "{{kb_notes}}").replace("{{", "{").replace("}}", "}"), "kb_notes")
def wikilinks(notes):
    """Every link of every note with all its parts."""
    return X.all_links(notes)


@_query("select path, cast(pos as integer) as pos, text from (select path, unnest(range(len(ls))) as pos, unnest(ls) as text from (select path, regexp_extract_all(body, '\\[\\[[^\\]\\[\\n]*\\]\\]') as ls from {kb_notes})) where text in ('[[]]', '[[#x]]')", "kb_notes")
def malformed_links(notes):
    return X.malformed_links(notes)


@_query("select path, cast(max(i) - 1 as bigint) as line from (select path, unnest(range(1, len(ls) + 1)) as i, unnest(ls) as l from (select path, string_split(body, chr(10)) as ls from {kb_notes})) where starts_with(l, '```') group by path having count(*) % 2 = 1", "kb_notes")
def unterminated_fences(notes):
    return X.open_fences(notes)


_HEADS = "h as (select path, cast(i - 1 as bigint) as line, length(l) - length(ltrim(l, '#')) as level, trim(ltrim(l, '#')) as text from (select path, ls[i] as l, i from (select path, ls, unnest(range(1, len(ls) + 1)) as i from (select path, string_split(body, chr(10)) as ls from {kb_notes}))) where regexp_matches(l, '^##?#?#?#?#? '))"


@_query(f"with {_HEADS}, up as (select h.path, h.line, g.line as spot, g.text from h join h g on g.path = h.path and g.line <= h.line and (g.line = h.line or g.level < h.level) and not exists (select 1 from h k where k.path = h.path and k.line > g.line and k.line <= h.line and k.level <= g.level)) select h.path, h.line, h.level, h.text, s.section from h join (select path, line, string_agg(text, ' / ' order by spot) as section from up group by path, line) s on s.path = h.path and s.line = h.line", "kb_notes")
def headings(notes):
    return X.headings(notes)


@_query("select path, strlen(body) as bytes, length(body) as chars, len(string_split(body, chr(10))) as lines from {kb_notes}", "kb_notes")
def line_index(notes):
    return X.sizes(notes)


@_query("select doc_id, sha256(coalesce(text, '')) as hash from {documents}", "documents")
def fingerprint(documents):
    return documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))


@_query(None, "documents")
def content_hash(documents):
    """FNV-1a of every whole text."""
    return X.content_hashes(documents.select("doc_id", "text"))


from typeloom.plans import files, more, workspace  # noqa: E402, F401 - they register their queries here
