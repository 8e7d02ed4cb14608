"""URL verdicts: host and path rules first, then a list of canonical URLs behind a blocked Bloom filter.

The filter has blocks of eight 64-bit words; a URL's hash picks the block and one bit in each word. The
list's length gives the number of blocks, ``BITS`` bits an entry, up to ``MOST_BLOCKS`` (about 19 MB); that
bound is why it may be broadcast. It is built with ``bit_or`` per block. Pages without all eight bits are
settled without a shuffle. Possible hits go to an exact join with the list on the canonical URL, which
removes false positives; a list too long for the filter only sends more pages there.

Canonical: the scheme, ``www.``, default ports, the fragment, tracking parameters, repeated or final
slashes and ``index.html`` are dropped, the host is lower-cased and the parameters are sorted.

A null URL or one without ``://`` has an empty host and path, fits no rule, isn't listed and is
allowed. Repeated pages each get their row; repeated list entries count once. Empty tables give no
rows. Among equally long rules the first in the alphabet wins. Very long URLs are taken whole. Of the pages only
``page_id`` and ``url`` are read, of the list ``url``; other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS, MOST_BLOCKS, WORDS = 16, 1 << 18, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
#: Families of bad hosts. On the list of :func:`op5_blocked_bloom` are those of their crawled URLs whose
#: canonical form has an MD5 that begins with one of ``LISTED``, so that a host alone tells no verdict; on
#: that of :func:`op5_blocked_bloom_all_hosts` are all.
LISTED = "0123456789ab"
BAD_HOSTS = r"(^|\.)((spam|casino|ads)-[^.]*|[^.]*-(bets|pills))\."


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(path_of(url), "/+", "/"), r"/index\.html?$", "/"), "/$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _rule(rules: list[tuple[str, str, str]], value) -> Column:
    out = F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.lit(value(host, path, verdict))).otherwise(out)
    return out


def blocks_for(entries: int) -> int:
    """Blocks of a filter over so many entries: a power of two."""
    need = max(1, entries * BITS // (64 * WORDS))
    return min(MOST_BLOCKS, 1 << (need - 1).bit_length())


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit("bits"))
    return [F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int") for k in range(WORDS)]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7) of a table with a column ``canonical``."""
    masks = [F.expr(f"shiftleft(1L, __b{k})").alias(f"m{k}") for k in range(WORDS)]
    bits = listed.select(_block(F.col("canonical"), blocks).alias("block"), *[b.alias(f"__b{k}") for k, b in enumerate(_bits(F.col("canonical")))])
    return bits.select("block", *masks).groupBy("block").agg(*[F.bit_or(f"m{k}").alias(f"w{k}") for k in range(WORDS)])


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for (page_id, url); ``listed`` has URLs to block, column ``url``."""
    entries = listed.select(canonical(F.col("url")).alias("canonical")).where("canonical <> ''").distinct()
    blocks = blocks_for(entries.count())
    url = F.col("url")
    seen = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical"))
    seen = seen.withColumn("rule", _rule(rules, lambda h, p, v: h + p)).withColumn("__ruled", _rule(rules, lambda h, p, v: v))
    seen = seen.withColumn("block", _block(F.col("canonical"), blocks))
    for k, b in enumerate(_bits(F.col("canonical"))):
        seen = seen.withColumn(f"__b{k}", b)
    probed = seen.join(F.broadcast(bloom(entries, blocks)), "block", "left")
    possible = F.coalesce(F.expr(" and ".join(f"shiftright(w{k}, __b{k}) & 1 = 1" for k in range(WORDS))), F.lit(False)) & F.col("__ruled").isNull()
    probed = probed.select("page_id", "host", "path", "rule", "__ruled", "canonical", possible.alias("__possible"))
    sure = probed.where("not __possible").withColumn("verdict", F.coalesce("__ruled", F.lit("allow")))
    hits = probed.where("__possible").join(entries.withColumn("__on", F.lit(True)), "canonical", "left")
    hits = hits.withColumn("verdict", F.when(F.col("__on"), "block").otherwise("allow"))
    columns = ["page_id", "host", "path", "rule", "verdict"]
    return sure.select(*columns).unionByName(hits.select(*columns))


def listed_urls(pages: DataFrame) -> DataFrame:
    """The list of :func:`op5_blocked_bloom`, cut from pages with a column ``url``."""
    bad = pages.where(host_of(F.col("url")).rlike(BAD_HOSTS))
    return bad.where(F.md5(canonical(F.col("url"))).rlike(f"^[{LISTED}]")).select("url")


def op5_blocked_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all pages; listed are crawled URLs of bad hosts, chosen by a hash of their canonical form."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, listed_urls(pages))


def op5_blocked_bloom_all_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all pages; listed is the canonical URL of every page of a bad host, whatever its family."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, pages.where(host_of(F.col("url")).rlike(BAD_HOSTS)).select("url"))


def oracle() -> str:
    """DuckDB SQL of op5's result."""
    return r"""
with p as (
  select page_id, coalesce(url, '') as u,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
q as (
  select *, list_sort(list_filter(string_split(regexp_extract(u, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) as a from p),
c as (
  select page_id, host, path, regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/index\.html?$', '/'), '/$', '')
    || case when len(a) > 0 then '?' || array_to_string(a, '&') else '' end as canonical from q),
listed as (select distinct canonical from c where regexp_matches(host, '""" + BAD_HOSTS + r"""') and canonical <> '' and regexp_matches(md5(canonical), '^[""" + LISTED + r"""]')),
r as (
  select page_id, host, path, canonical, case
    when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule from c)
select page_id, host, path, rule, case
  when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block'
  when canonical in (select canonical from listed) then 'block' else 'allow' end as verdict
from r"""


def oracle_all_hosts() -> str:
    """DuckDB SQL of the result with all families listed."""
    return oracle().replace(f" and regexp_matches(md5(canonical), '^[{LISTED}]')", "")
