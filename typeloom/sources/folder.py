"""Folders of markdown and YAML files as DataFrames."""

from __future__ import annotations

import fnmatch
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.plans.skew import dealt
from typeloom.sources.markdown import READ_CAP, parse_file

PARSED = (
    "path string, kind string, claim array<string>, fields string, errors array<string>, "
    "events array<struct<kind:string,start:long,end:long,section:array<string>,level:int,text:string,info:string,block_id:string>>, "
    "records array<struct<field_path:array<string>,claim:string,block_id:string,pointer:string>>"
)
DEFAULT_EXCLUDES = ("node_modules/", "target/", ".*")


def ignore_rules(lines: list[str]) -> list[tuple[bool, str]]:
    """(keep, regular expression) of gitignore-like patterns; the last that fits decides."""
    out = []
    for line in lines:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        keep, pattern = line.startswith("!"), line.lstrip("!")
        anchored = pattern.strip("/").count("/") > 0 or pattern.startswith("/")
        body = fnmatch.translate(pattern.strip("/")).removeprefix("(?s:").removesuffix(")\\Z").removesuffix(")\\z").replace(".*", "[^/]*")
        out.append((keep, ("^" if anchored else "(^|/)") + body + ("/" if pattern.endswith("/") else "(/|$)")))
    return out


def kept(path: str, rules: list[tuple[bool, str]]) -> bool:
    verdict = True
    for keep, rule in rules:
        if re.search(rule, path):
            verdict = keep
    return verdict


def read_files(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """(path, length, content) below root, paths relative; ignored files and contents over the read cap are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^[a-z]+:/*", "/", root).rstrip("/")
    rel = F.regexp_replace("path", f"^[a-z]+:/*{re.escape(base)}/", "")
    verdict = F.lit(True)
    for keep, rule in ignore_rules([*DEFAULT_EXCLUDES, *(ignore or [])]):
        verdict = F.when(rel.rlike(rule), F.lit(keep)).otherwise(verdict)
    return files.select(rel.alias("path"), "length", F.when(F.col("length") <= READ_CAP, F.col("content")).alias("content"), verdict.alias("__kept")).where("__kept").drop("__kept")


def parse(files: DataFrame) -> DataFrame:
    """One parsed row for each file."""

    def task(frames):
        for frame in frames:
            yield pd.DataFrame([parse_file(p, bytes(c)) if c is not None else {"path": p, "kind": "unparsed", "claim": [], "fields": "{}", "errors": ["over-read-cap"], "events": [], "records": []} for p, c in zip(frame["path"], frame["content"])])

    return dealt(files.select("path", "content")).mapInPandas(task, PARSED)


def tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """instances, events, links, blocks, records, diagnostics and type_defs of parsed files."""
    event = parsed.select("path", F.posexplode("events").alias("pos", "e")).select("path", "pos", "e.*")
    return {
        "instances": parsed.where("kind in ('instance', 'note')").select("path", "claim", "fields"),
        "type_defs": parsed.where("kind = 'type-def'").select(F.col("claim")[0].alias("name"), "path", "fields"),
        "events": event,
        "links": event.where("kind = 'link'").select("path", "pos", "text", "start", "end", "section"),
        "blocks": event.where("block_id <> ''").select("path", "pos", "block_id", "kind", "start", "end"),
        "records": parsed.select("path", F.explode("records").alias("r")).select("path", "r.*"),
        "diagnostics": parsed.select("path", F.explode("errors").alias("code")).unionByName(event.where("kind = 'unterminated_fence'").select("path", F.lit("unterminated-fence").alias("code"))),
    }


def parse_texts(texts: DataFrame) -> DataFrame:
    """One parsed row for each (path, text)."""
    return parse(texts.select("path", F.col("text").cast("binary").alias("content")))


def field_values(instances: DataFrame) -> DataFrame:
    """(path, field, value): top-level fields of instances (path, fields), values as text or JSON."""
    return instances.select("path", F.explode(F.from_json("fields", "map<string,string>")).alias("field", "value"))


def type_vocabulary(defs: DataFrame) -> dict[str, DataFrame]:
    """types, parents, sealed and fields of type definitions, natively from their JSON."""
    one = F.from_json("fields", "extends string, sealed array<string>, abstract boolean, fields map<string,string>")
    d = defs.select("name", one.alias("d"), "fields")
    many = F.from_json(F.get_json_object("fields", "$.extends"), "array<string>")
    extends = F.coalesce(many, F.when(F.col("d.extends").isNotNull(), F.array("d.extends")))
    field = d.select("name", F.explode("d.fields").alias("f", "shape"))
    return {
        "types": d.select("name", F.coalesce("d.abstract", F.lit(False)).alias("is_abstract"), F.col("d.sealed").isNotNull().alias("is_sealed")),
        "parents": d.select(F.col("name").alias("child"), F.explode(extends).alias("parent")),
        "sealed": d.select(F.col("name").alias("parent"), F.explode("d.sealed").alias("member")),
        "fields": field.select(F.col("name").alias("type"), F.regexp_replace("f", r"\?$", "").alias("field"), "shape", F.col("f").endswith("?").alias("optional")),
    }
