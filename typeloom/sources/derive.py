"""A knowledge base derived from the star-schema tables, as SQL that Spark and DuckDB both run.

Each entry of ``DERIVED`` may use the raw tables and the entries before it, as ``{name}``. Spark gets
DataFrames for the names (:func:`knowledge_base`), so Catalyst sees one plan; DuckDB gets common table
expressions (:func:`with_tables`).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from typeloom.plans.shared import written

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "labels", "benchmark")

DERIVED: dict[str, str] = {
    # type vocabulary: constants, a few on purpose wrong
    "kb_types": """select * from (values
        ('entity', true, false, 'core'), ('party', false, true, 'core'), ('customer', false, false, 'core'), ('supplier', false, false, 'core'),
        ('place', true, false, 'core'), ('nation', false, false, 'core'), ('region', false, false, 'core'), ('item', false, false, 'core'),
        ('part', false, false, 'core'), ('document', false, false, 'core'), ('order', false, false, 'core'), ('audited', true, false, 'ext'),
        ('vip', false, false, 'ext'), ('premium', false, false, 'ext'), ('rush_order', false, false, 'ext'), ('line', false, false, 'core'),
        ('ring_a', false, false, 'ext'), ('ring_b', false, false, 'ext'), ('Bad-Name', false, false, 'ext'), ('String', false, false, 'ext'), ('orphan', false, false, 'ext'))
        as t(name, is_abstract, is_sealed, owner)""",
    "kb_parents": """select * from (values
        ('party', 'entity'), ('customer', 'party'), ('supplier', 'party'), ('place', 'entity'), ('nation', 'place'), ('region', 'place'), ('item', 'entity'),
        ('part', 'item'), ('document', 'entity'), ('order', 'document'), ('vip', 'customer'), ('vip', 'audited'), ('premium', 'party'), ('rush_order', 'order'),
        ('rush_order', 'audited'), ('ring_a', 'ring_b'), ('ring_b', 'ring_a'), ('orphan', 'nowhere')) as t(child, parent)""",
    "kb_sealed": "select * from (values ('party', 'customer'), ('party', 'supplier')) as t(parent, member)",
    "kb_fields": """select * from (values
        ('entity', 'key', 'Number', false, 0.0, 1.0e12, ''), ('entity', 'label', 'String', true, -1.0e12, 1.0e12, ''),
        ('party', 'balance', 'Number{>=0}', false, 0.0, 1.0e12, ''), ('party', 'nation', 'nation*', false, -1.0e12, 1.0e12, ''),
        ('customer', 'segment', '[AUTOMOBILE, BUILDING, MACHINERY]', false, -1.0e12, 1.0e12, ',AUTOMOBILE,BUILDING,MACHINERY,'),
        ('nation', 'region', 'region*', false, -1.0e12, 1.0e12, ''), ('part', 'size', 'Number{1..40}', false, 1.0, 40.0, ''), ('part', 'brand', 'String', true, -1.0e12, 1.0e12, ''),
        ('order', 'status', '[F, O]', false, -1.0e12, 1.0e12, ',F,O,'), ('order', 'total', 'Number', false, -1.0e12, 1.0e12, ''),
        ('order', 'customer', 'customer*', false, -1.0e12, 1.0e12, ''), ('order', 'items', 'line[1..5]', false, -1.0e12, 1.0e12, ''),
        ('audited', 'label', 'Number', true, -1.0e12, 1.0e12, ''), ('audited', 'auditor', 'party*', true, -1.0e12, 1.0e12, ''),
        ('vip', 'balance', 'Number', false, -1.0e12, 1.0e12, ''), ('line', 'quantity', 'Number{1..50}', false, 1.0, 50.0, ''), ('line', 'discount', 'Number{0..0.08}', false, 0.0, 0.08, ''),
        ('orphan', 'ghost', 'phantom*', true, -1.0e12, 1.0e12, ''), ('ring_a', 'never', 'Number{9..3}', true, 9.0, 3.0, '')) as t(type, field, shape, optional, min_v, max_v, members)""",
    "kb_refs": "select * from (values ('party', 'nation', 'nation'), ('nation', 'region', 'region'), ('order', 'customer', 'customer'), ('order', 'items', 'line'), ('order', 'supplier', 'customer'), ('audited', 'auditor', 'party'), ('orphan', 'ghost', 'phantom')) as t(type, field, target)",
    "kb_repos": "select r_name as repo, r_regionkey as repo_id, r_regionkey % 2 = 0 as editable, case when r_regionkey = 0 then 'entry' when r_regionkey % 2 = 0 then 'edit' else 'dep' end as role from {region}",
    "kb_nations": "select n.n_nationkey, n.n_name, r.r_name as repo from {nation} n join {region} r on n.n_regionkey = r.r_regionkey",
    # files: parts whose key ends in 50 take their predecessor's stem, so that stem is ambiguous; those in 55 one of their own repo
    "kb_files": """
        select r_name as repo, r_name || '/region/region-' || cast(r_regionkey as string) || '.md' as path, 'region-' || cast(r_regionkey as string) as stem, 'region' as kind, cast(r_regionkey as bigint) as k from {region}
        union all select repo, repo || '/nation/nation-' || cast(n_nationkey as string) || '.md', 'nation-' || cast(n_nationkey as string), 'nation', cast(n_nationkey as bigint) from {kb_nations}
        union all select n.repo, n.repo || '/customer/customer-' || cast(c_custkey as string) || '.md', 'customer-' || cast(c_custkey as string), case when c_custkey % 40 = 0 then 'vip' else 'customer' end, c_custkey from {customer} c join {kb_nations} n on c.c_nationkey = n.n_nationkey
        union all select n.repo, n.repo || '/supplier/supplier-' || cast(s_suppkey as string) || '.md', 'supplier-' || cast(s_suppkey as string), 'supplier', s_suppkey from {supplier} s join {kb_nations} n on s.s_nationkey = n.n_nationkey
        union all select r.r_name, r.r_name || '/part/p' || cast(p_partkey as string) || '/part-' || cast(case when p_partkey % 100 = 50 then p_partkey - 1 when p_partkey % 100 = 55 then p_partkey - 10 else p_partkey end as string) || '.md', 'part-' || cast(case when p_partkey % 100 = 50 then p_partkey - 1 when p_partkey % 100 = 55 then p_partkey - 10 else p_partkey end as string), 'part', p_partkey from {part} p join {region} r on p.p_partkey % 5 = r.r_regionkey
        union all select n.repo, n.repo || '/order/order-' || cast(o_orderkey as string) || '.md', 'order-' || cast(o_orderkey as string), case when o_orderpriority = '1-URGENT' then 'rush_order' else 'order' end, o_orderkey from {orders} o join {customer} c on o.o_custkey = c.c_custkey join {kb_nations} n on c.c_nationkey = n.n_nationkey""",
    "kb_order_files": "select k, path, repo from {kb_files} where kind in ('order', 'rush_order')",
    # links: target text as authored; line 7 of an order pins a commit, orders of key % 97 = 0 miss their part
    "kb_links": """
        select f.path as src, f.repo, 'region-' || cast(n.n_regionkey as string) as target, 'region' as slot, 'frontmatter' as surface, cast(0 as bigint) as pos, cast(null as string) as pin from {kb_files} f join {nation} n on f.kind = 'nation' and f.k = n.n_nationkey
        union all select f.path, f.repo, 'Nation-' || cast(c.c_nationkey as string), 'nation', 'frontmatter', cast(0 as bigint), cast(null as string) from {kb_files} f join {customer} c on f.kind in ('customer', 'vip') and f.k = c.c_custkey
        union all select f.path, f.repo, 'nation-' || cast(s.s_nationkey as string) || '.md', 'nation', 'frontmatter', cast(0 as bigint), cast(null as string) from {kb_files} f join {supplier} s on f.kind = 'supplier' and f.k = s.s_suppkey
        union all select f.path, f.repo, 'customer-' || cast(o.o_custkey as string), 'customer', 'frontmatter', cast(0 as bigint), cast(null as string) from {kb_order_files} f join {orders} o on f.k = o.o_orderkey
        union all select f.path, f.repo, case when l.l_orderkey % 97 = 0 then 'gone/part-' else 'part-' end || cast(l.l_partkey as string), cast(null as string), 'body', cast(l.l_linenumber as bigint), case when l.l_linenumber = 7 then 'c0ffee' else cast(null as string) end from {lineitem} l join {kb_order_files} f on l.l_orderkey = f.k
        union all select f.path, f.repo, case when l.l_suppkey % 211 = 0 then '../../supplier-' else 'supplier-' end || cast(l.l_suppkey as string), case when l.l_linenumber = 1 then 'supplier' else cast(null as string) end, 'body', cast(l.l_linenumber as bigint) + 100, cast(null as string) from {lineitem} l join {kb_order_files} f on l.l_orderkey = f.k""",
    # values: numbers and texts of the typed fields
    "kb_values": """
        select path, kind, 'key' as field, cast(k as double) as num, cast(null as string) as txt from {kb_files}
        union all select f.path, f.kind, 'balance', c_acctbal, null from {kb_files} f join {customer} c on f.kind in ('customer', 'vip') and f.k = c.c_custkey where c_custkey % 33 <> 0
        union all select f.path, f.kind, 'segment', null, c_mktsegment from {kb_files} f join {customer} c on f.kind in ('customer', 'vip') and f.k = c.c_custkey
        union all select f.path, f.kind, 'nation', null, 'nation' from {kb_files} f where f.kind in ('customer', 'vip', 'supplier')
        union all select f.path, f.kind, 'balance', s_acctbal, null from {kb_files} f join {supplier} s on f.kind = 'supplier' and f.k = s.s_suppkey
        union all select f.path, f.kind, 'region', null, 'region' from {kb_files} f where f.kind = 'nation'
        union all select f.path, f.kind, 'size', cast(p_size as double), null from {kb_files} f join {part} p on f.kind = 'part' and f.k = p.p_partkey
        union all select f.path, f.kind, 'brand', null, p_brand from {kb_files} f join {part} p on f.kind = 'part' and f.k = p.p_partkey where p_partkey % 7 <> 0
        union all select f.path, f.kind, 'status', null, o_orderstatus from {kb_files} f join {orders} o on f.kind in ('order', 'rush_order') and f.k = o.o_orderkey
        union all select f.path, f.kind, 'total', o_totalprice, null from {kb_files} f join {orders} o on f.kind in ('order', 'rush_order') and f.k = o.o_orderkey where o_orderkey % 51 <> 0
        union all select f.path, f.kind, 'customer', null, 'customer' from {kb_files} f where f.kind in ('order', 'rush_order')""",
    # inline records: an order's lines
    "kb_inline": "select f.path, f.repo, cast(l.l_linenumber as bigint) as n, 'line' as type, l.l_quantity as quantity, l.l_discount as discount, 'l' || cast(l.l_linenumber % 6 as string) as block_id from {lineitem} l join {kb_order_files} f on l.l_orderkey = f.k",
    # untyped records: which keys an event carries
    "kb_records": """select event_id, event_type, field from (
        select event_id, event_type, 'key' as field from {events}
        union all select event_id, event_type, 'size' from {events} where event_id % 2 = 0
        union all select event_id, event_type, 'brand' from {events} where event_id % 3 = 0
        union all select event_id, event_type, 'status' from {events} where event_id % 5 < 3
        union all select event_id, event_type, 'total' from {events} where event_id % 5 < 2
        union all select event_id, event_type, 'customer' from {events} where event_id % 5 = 1
        union all select event_id, event_type, 'items' from {events} where event_id % 10 = 1
        union all select event_id, event_type, 'region' from {events} where event_id % 11 = 0) r""",
    # whole files as text, for the parser; some on purpose wrong
    "kb_markdown": """select 'c/customer-' || cast(c_custkey as string) || '.md' as path, c_custkey as k, c_nationkey as nation, c_mktsegment as segment,
        '---' || chr(10) || 'type: ' || case when c_custkey % 5 = 0 then '[customer, audited]' else 'customer' end || chr(10) || 'key: ' || cast(c_custkey as string) || chr(10)
        || case when c_custkey % 11 = 0 then '' else 'segment: ' || c_mktsegment || chr(10) end || case when c_custkey % 13 = 0 then 'key: 0' || chr(10) else '' end
        || case when c_custkey % 17 = 0 then 'bad: [1, 2' || chr(10) else '' end || 'nation: "[[nation-' || cast(c_nationkey as string) || ']]"' || chr(10) || 'box:' || chr(10) || '  type: inner' || chr(10) || '  ^: b' || cast(c_custkey % 10 as string) || chr(10)
        || case when c_custkey % 19 = 0 then '' else '---' || chr(10) end || '# Customer' || chr(10) || 'See [[nation-' || cast(c_nationkey as string) || '#Top]], not `[[masked]]`' || chr(10) || '```yaml [:note]' || chr(10) || '[[hidden]]' || chr(10) || '```' || chr(10) || '^f1' || chr(10) || '## Sub ^s1' || chr(10) || 'end ^m1'
        || case when c_custkey % 23 = 0 then chr(10) || '```' || chr(10) || 'open' else '' end as text from {customer}""",
    "kb_type_files": "select * from (values ('type/base.type.yaml', 'abstract: true\nfields:\n  key: Number\n  label?: String\n'), ('type/customer.type.yaml', 'extends: base\nfields:\n  segment: String\n  nation: nation*\n'), ('type/audited.type.yaml', 'extends: [base, ghost]\nsealed: [customer]\nfields: {}\n')) as t(path, text)",
    # several definitions of one name, metas, brands, compound slots, definition files: constants
    "kb_defs": "select name, owner, '' as extra, is_abstract, is_sealed from {kb_types} union all select * from (values ('part', 'ext', 'other', false, false), ('region', 'ext', '', false, false), ('both', 'ext', '', true, true)) as t(name, owner, extra, is_abstract, is_sealed)",
    "kb_metas": "select * from (values ('entity', 'audited'), ('part', 'audited'), ('part', 'audited'), ('order', 'nowhere'), ('nation', 'line')) as t(type, meta)",
    "kb_required_metas": "select * from (values ('place', 'line'), ('party', 'audited'), ('item', 'vip')) as t(base, meta)",
    "kb_brands": "select * from (values ('line', '(Number, Number)'), ('region', 'String')) as t(name, shape)",
    "kb_operands": "select * from (values ('order', 'payer', 'union', 'customer'), ('order', 'payer', 'union', 'party'), ('order', 'payer', 'union', 'part'), ('audited', 'by', 'intersection', 'vip'), ('audited', 'by', 'intersection', 'party'), ('part', 'note', 'union', 'any'), ('part', 'note', 'union', 'nation')) as t(type, field, kind, operand)",
    "kb_branches": "select * from (values ('order', 'items', 'a', 0, 9), ('order', 'items', 'b', 1, 9), ('order', 'items', 'c', 2, 4), ('part', 'tags', 'a', 1, 3), ('part', 'tags', 'b', 1, 3), ('part', 'codes', 'a', 1, 3), ('part', 'codes', 'b', 2, 5)) as t(type, field, branch, low, high)",
    "kb_def_files": "select case when is_sealed or name = 'part' then 'lib/' || name || '.type.yaml' else 'lib/type/' || owner || '/' || name || '.type.yaml' end as path from {kb_types} union all select 'type.type.yaml'",
    # links into blocks of orders, and links with a scope
    "kb_block_links": "select 'log/' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) as src, f.path as dst, 'l' || cast((l_linenumber + 3) % 8 as string) as block from {lineitem} l join {kb_order_files} f on l.l_orderkey = f.k",
    "kb_scoped_links": "select f.path as src, f.repo, case when l.l_linenumber % 5 = 0 then 'ATLANTIS' when l.l_linenumber % 4 = 0 then 'EUROPE' when l.l_linenumber % 3 = 0 then 'ASIA' when l.l_linenumber % 2 = 0 then f.repo end as scope, 'part-' || cast(l.l_partkey as string) as target from {lineitem} l join {kb_order_files} f on l.l_orderkey = f.k",
    "kb_depends": "select repo, 'EUROPE' as scope from {kb_repos} where repo_id > 1 union all select repo, 'ATLANTIS' from {kb_repos} where repo_id % 2 = 0",
    "kb_moves": "select 'n' || cast(o_custkey as string) as old, 'n' || cast((o_custkey * 7 + o_orderkey) % 1009 as string) as new, o_orderkey as seq from {orders} where o_orderkey % 3 = 0",
    "kb_commits": "select o_orderkey as commit_id, cast(cast(o_orderdate as date) as string) as day, o_custkey as author, 'Change ' || cast(o_orderkey as string) as subject, case when o_orderkey % 4 = 0 then 'Reviewed-by: clerk ' || cast(o_custkey % 7 as string) else o_orderpriority end as trailer from {orders}",
    "kb_commit_files": "select l_orderkey as commit_id, 'part/' || cast(l_partkey as string) || '.md' as path, case when l_linenumber = 1 then 'A' when l_returnflag = 'R' then 'D' else 'M' end as status from {lineitem}",
    # a workspace: roles that repos are claimed in, places where they lie, dependencies; constants, some contradictory
    "kb_member_claims": "select * from (values ('AFRICA', 'entry'), ('AFRICA', 'dep'), ('AMERICA', 'edit'), ('AMERICA', 'discover'), ('ASIA', 'discover'), ('ASIA', 'dep'), ('EUROPE', 'edit'), ('MIDDLE EAST', 'dep'), ('ATLANTIS', 'edit'), ('LEMURIA', 'discover')) as t(repo, role)",
    "kb_places": "select * from (values ('AFRICA', 'sibling', '/w/africa'), ('AFRICA', 'cache', '/c/africa'), ('AMERICA', 'registry', '/r/america'), ('AMERICA', 'registry', '/r/america-old'), ('ASIA', 'cache', '/c/asia'), ('ASIA', 'registry', '/r/asia'), ('EUROPE', 'cache', '/c/europe'), ('MIDDLE EAST', 'cache', '/c/middle-east')) as t(repo, place, root)",
    "kb_disabled": "select * from (values ('LEMURIA'), ('MU')) as t(repo)",
    "kb_pinned": "select * from (values ('EUROPE'), ('MIDDLE EAST')) as t(repo)",
    "kb_repo_deps": "select * from (values ('AFRICA', 'AMERICA'), ('AFRICA', 'ATLANTIS'), ('AMERICA', 'EUROPE'), ('EUROPE', 'MIDDLE EAST'), ('MIDDLE EAST', 'EUROPE'), ('ASIA', 'MU'), ('ASIA', 'MIDDLE EAST'), ('ATLANTIS', 'ASIA')) as t(repo, dep)",
    "kb_readmes": "select repo, path, kind from {kb_files} union all select * from (values ('AFRICA', 'AFRICA/README.md', 'readme'), ('AMERICA', 'AMERICA/README.md', 'note'), ('ASIA', 'ASIA/doc/README.md', 'readme')) as t(repo, path, kind)",
    # definitions of several repos that extend each other
    "kb_xdefs": "select * from (values ('ASIA', 'trade', 'a'), ('ASIA', 'port', 'b'), ('EUROPE', 'trade', 'a'), ('EUROPE', 'deal', 'c'), ('AFRICA', 'deal', 'c'), ('AFRICA', 'base', 'd'), ('AMERICA', 'base', 'e')) as t(repo, name, body)",
    "kb_xparents": "select * from (values ('ASIA', 'trade', 'EUROPE', 'deal'), ('ASIA', 'port', 'AFRICA', 'deal'), ('EUROPE', 'deal', 'AFRICA', 'base'), ('AFRICA', 'deal', 'ASIA', 'port'), ('AMERICA', 'base', 'AFRICA', 'base')) as t(crepo, child, prepo, parent)",
    # bodies: contracts on sections, templates that use each other, and what the lines of orders contribute
    "kb_contracts": "select * from (values ('order', 'Outcome', 'items', false), ('order', 'Outcome', 'customer', false), ('order', 'Log', 'status', true), ('order', 'Log / Deep', 'items', false), ('rush_order', 'Outcome / Result', 'customer', true), ('rush_order', 'Log', 'ghost', false)) as t(type, scope, field, exclusive)",
    "kb_contributions": "select f.path, case when l.l_linenumber % 4 = 1 then 'customer' when l.l_linenumber % 4 = 2 then 'items' when l.l_linenumber % 4 = 3 then 'status' else 'note' end as field, case when l.l_linenumber = 1 then 'frontmatter' when l.l_linenumber % 2 = 0 then 'wikilink' else 'fence' end as surface, case when l.l_quantity > 25 then 'Outcome / Result' when l.l_quantity > 10 then 'Outcome' else 'Log' end as section from {lineitem} l join {kb_order_files} f on l.l_orderkey = f.k",
    "kb_sections": "select distinct path, section from {kb_contributions} union select path, 'Outcome' from {kb_contributions} where section = 'Outcome / Result'",
    "kb_bodies": "select * from (values ('document', 1, 'Summary', null), ('order', 1, 'Head', null), ('order', 2, null, 'document'), ('order', 3, 'Tail', null), ('rush_order', 1, null, 'order'), ('rush_order', 2, 'Haste', null), ('rush_order', 3, null, 'audited'), ('ring_a', 1, 'A', null), ('ring_a', 2, null, 'ring_b'), ('ring_b', 1, null, 'ring_a'), ('ring_b', 2, 'B', null), ('part', 1, null, 'order')) as t(type, pos, section, use)",
    "kb_lists": "select path, 'dates' as field, concat_ws(',', cast(cast(o_orderdate as date) as string), o_orderpriority, o_orderstatus) as text from {orders} join {kb_order_files} on k = o_orderkey",
    # where files of a type belong
    "kb_locations": "select * from (values ('order', '*/order', 'order-%key%', 'md', false), ('audited', '**/audit', '', '', false), ('part', '*/part/*', 'part-%key%', 'md', true), ('nation', '**', '', 'yaml', false), ('customer', 'EUROPE/**', '', '', false), ('supplier', 'ASIA/*', 'supplier-%key%', '', true)) as t(type, dir, name, ext, strict)",
    # values that are in no file, each for a type; and types that are offered to events next to what they claim
    "kb_asked": "select 'q' || cast(event_id as string) as path, case when event_id % 4 = 0 then 'part' when event_id % 4 = 1 then 'order' when event_id % 4 = 2 then 'region' when event_id % 8 = 3 then 'party' else 'nothing' end as kind from {events}",
    "kb_asked_values": "select 'q' || cast(event_id as string) as path, 'key' as field, cast(event_id as double) as num, cast(null as string) as txt from {events} union all select 'q' || cast(event_id as string), 'size', cast(event_id % 60 as double), cast(null as string) from {events} union all select 'q' || cast(event_id as string), 'status', cast(null as double), case when event_id % 3 = 0 then 'F' else 'X' end from {events} where event_id % 5 <> 0",
    "kb_offers": "select event_id, case when event_id % 2 = 0 then 'vip' when event_id % 3 = 0 then 'premium' else 'part' end as type, case when event_id % 5 = 0 then 'supplier' when event_id % 5 = 1 then 'vip' else 'nation' end as claim from {events}",
    # rendered notes: a heading, a body with a link and a fence, from conversations
    "kb_notes": "select 'notes/' || cast(conv_id as string) || '-' || cast(turn as string) || '.md' as path, '# ' || role || chr(10) || 'See [[note ' || cast(conv_id % 10 as string) || case when turn % 2 = 0 then '#top' else '' end || case when turn % 3 = 0 then '^b1' else '' end || ']]' || case when turn % 5 = 0 then ' and [[a b::lib@c0ffee#Top^^b2:f]]' when turn % 5 = 1 then ' not [[]] nor [[#x]]' else '' end || chr(10) || '## turn ' || cast(turn as string) || chr(10) || text || case when conv_id % 7 = 0 then chr(10) || '```yaml' || chr(10) || 'open: 1' when conv_id % 7 = 1 then chr(10) || '```' || chr(10) || 'x' || chr(10) || '```' else '' end as body from {conversations} where text is not null",
}


#: Derived tables that many queries read: written once an application and folder.
SHARED = ("kb_files", "kb_links", "kb_values")
_WRITTEN: dict[tuple[str, str, str], DataFrame] = {}


def knowledge_base(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The named derived tables (all if none is named) and what they rest on; all but ``SHARED`` are lazy DataFrames.

    A source table must not change while an application reads it.
    """
    out: dict[str, DataFrame] = {}

    def get(name: str) -> DataFrame:
        if name not in out:
            if name in DERIVED:
                text = DERIVED[name]
                key = (spark.sparkContext.applicationId, sf_dir, name)
                if key in _WRITTEN:
                    out[name] = _WRITTEN[key]
                    return out[name]
                out[name] = spark.sql(text, **{n: get(n) for n in sorted(set(re.findall(r"\{(\w+)\}", text)))})
                if name in SHARED:
                    out[name] = _WRITTEN[key] = written(out[name], name)
            else:
                out[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return out[name]

    for name in names or DERIVED:
        get(name)
    return out


def with_tables(sql: str) -> str:
    """DuckDB SQL with the derived tables that ``sql`` names as {name} put before it; it may begin with its own tables, ``with ... select``."""
    need: list[str] = []

    def add(text: str) -> None:
        for n in re.findall(r"\{(\w+)\}", text):
            if n in DERIVED and n not in need:
                add(DERIVED[n])
                need.append(n)

    add(sql)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    tables = ",\n".join(f"{n} as ({plain(DERIVED[n])})" for n in need)
    body = plain(sql).strip()
    if not need:
        return body
    if body.lower().startswith("with recursive"):
        return f"with recursive {tables},\n{body[14:]}"
    if body.lower().startswith("with "):
        return f"with {tables},\n{body[5:]}"
    return f"with {tables}\n{body}"
