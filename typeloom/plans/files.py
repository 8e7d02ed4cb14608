"""Registered queries that start from whole files: parse, vocabulary, and checks over what was parsed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.functions import grammar
from typeloom.operators import typegraph as T
from typeloom.operators import validate as V
from typeloom.plans.registry import _query
from typeloom.plans.shared import written
from typeloom.sources import folder, markdown

# what the parser makes of kb_markdown: every 17th file is malformed, every 19th has no end of its front matter
_GOOD = "good as (select *, 'nation-' || cast(nation as varchar) as target from {kb_markdown} where k % 19 <> 0 and k % 17 <> 0)"


def _parsed(texts: DataFrame) -> DataFrame:
    return written(folder.parse_texts(texts), "parsed")


if markdown.yaml is not None:

    @_query("select path, case when k % 19 = 0 then 'note' when k % 17 = 0 then 'unparsed' else 'instance' end as kind, case when k % 19 = 0 or k % 17 = 0 then '' when k % 5 = 0 then 'customer,audited' else 'customer' end as claims from {kb_markdown}", "kb_markdown")
    def parsed_files(texts):
        return _parsed(texts).select("path", "kind", F.array_join("claim", ",").alias("claims"))

    @_query(f"with {_GOOD} select path, 'key' as field, cast(k as varchar) as value from good union all select path, 'segment', segment from good where k % 11 <> 0 union all select path, 'nation', '[[' || target || ']]' from good", "kb_markdown")
    def parsed_fields(texts):
        return folder.field_values(folder.tables(_parsed(texts))["instances"]).where("field <> 'box'")

    @_query(f"with {_GOOD} select path, '[[' || target || '#Top]]' as text from good union all select path, '[[nation-' || cast(nation as varchar) || '#Top]]' from {{kb_markdown}} where k % 19 = 0 union all select path, '[[nation-' || cast(nation as varchar) || ']]' from {{kb_markdown}} where k % 19 = 0", "kb_markdown")
    def parsed_links(texts):
        """Links of bodies, without those in code; a file whose front matter has no end is all body."""
        return folder.tables(_parsed(texts))["links"].select("path", "text")

    @_query(f"with {_GOOD} select path, '/box' as pointer, 'inner' as claim, 'b' || cast(k % 10 as varchar) as block_id from good", "kb_markdown")
    def parsed_records(texts):
        return folder.tables(_parsed(texts))["records"].select("path", "pointer", "claim", "block_id")

    @_query("select path, b as block_id, e as kind from {kb_markdown}, (values ('f1', 'fence'), ('s1', 'heading'), ('m1', 'marker')) v(b, e) where k % 17 <> 0 or k % 19 = 0", "kb_markdown")
    def parsed_blocks(texts):
        return folder.tables(_parsed(texts))["blocks"].select("path", "block_id", "kind")

    @_query("select path, 'duplicate-key:key' as code from {kb_markdown} where k % 13 = 0 and k % 17 <> 0 and k % 19 <> 0 union all select path, 'malformed-yaml' from {kb_markdown} where k % 17 = 0 and k % 19 <> 0 union all select path, 'unterminated-frontmatter' from {kb_markdown} where k % 19 = 0 union all select path, 'unterminated-fence' from {kb_markdown} where k % 23 = 0 and (k % 17 <> 0 or k % 19 = 0)", "kb_markdown")
    def parsed_diagnostics(texts):
        return folder.tables(_parsed(texts))["diagnostics"]

    @_query("select * from (values ('audited', 'base', null, null, null), ('audited', 'ghost', null, null, null), ('customer', 'base', null, null, null), ('base', null, 'key', 'Number', false), ('base', null, 'label', 'String', true), ('customer', null, 'segment', 'String', false), ('customer', null, 'nation', 'nation*', false)) t(name, parent, field, shape, optional)", "kb_type_files")
    def parsed_types(texts):
        v = folder.type_vocabulary(folder.tables(_parsed(texts))["type_defs"])
        parents = v["parents"].select(F.col("child").alias("name"), "parent")
        fields = v["fields"].select(F.col("type").alias("name"), "field", "shape", "optional")
        return parents.unionByName(fields, allowMissingColumns=True)

    @_query(f"with {_GOOD} select path, 'required-field-absent' as code, 'error' as severity, 'segment' as field from good where k % 11 = 0", "kb_markdown", "kb_type_files")
    def parsed_required_absent(texts, defs):
        """Files through the parser and types through the parser meet in a check."""
        parsed = folder.tables(_parsed(texts))
        v = folder.type_vocabulary(folder.tables(_parsed(defs))["type_defs"])
        claims = parsed["instances"].select("path", F.explode("claim").alias("kind"))
        effective = T.effective_fields(T.closure(v["types"], v["parents"]), v["fields"])
        return V.required_absent(claims, folder.field_values(parsed["instances"]), effective, ()).distinct()


def _shapes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        parsed = [grammar.parse_shape(x) for x in frame["shape"]]
        yield pd.DataFrame({"shape": frame["shape"], "kind": [s.kind for s in parsed], "types": [",".join(sorted(grammar.type_names(s))) for s in parsed], "empty": [grammar.unsatisfiable(s) for s in parsed]})


@_query("select distinct shape, case when shape like '[%' then 'enum' when shape like '%*' then 'reference' when shape like '%]' then 'list' else 'scalar' end as kind, regexp_extract(shape, '^([a-z]+)[*\\[]', 1) as types, shape like '%{9..3}' as empty from {kb_fields}", "kb_fields")
def shapes(fields):
    """Every distinct slot shape, parsed once."""
    return fields.select("shape").distinct().mapInPandas(_shapes, "shape string, kind string, types string, empty boolean")
