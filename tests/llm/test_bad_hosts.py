"""Every family of bad hosts on the list of op5_blocked_bloom_all_hosts."""

import duckdb
import pytest

from tests.llm.test_operators import same
from typeloom.llm import registry, url_filter

#: host label of each family
BAD = ["spam-farm", "casino-win", "free-bets", "cheap-pills", "ads-track"]


@pytest.fixture
def tables(spark, tmp_path):
    urls = [f"https://{w}{h}.example.org/en/{k}" for k, h in enumerate(BAD) for w in ("", "www.", "m.")]
    urls += ["https://news.example.org/ads-track/1", "https://alphabets.example.org/1", "https://free-bets.example.com/en/1", None, "https://good.org/?u=spam-farm.example.org"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path), urls


def test_all_families_are_blocked(spark, tables):
    folder, urls = tables
    out = registry.queries()["op5_blocked_bloom_all_hosts"](spark, folder)
    assert {r.page_id for r in out.where("verdict = 'block' and rule is null").collect()} == set(range(3 * len(BAD)))
    con = duckdb.connect()
    con.register("pages", out.sparkSession.read.parquet(f"{folder}/pages.parquet").toPandas())
    same(out, url_filter.oracle_all_hosts(), con)
    assert url_filter.oracle_all_hosts() != url_filter.oracle()
