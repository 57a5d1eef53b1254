"""Queries against their SQL twins on given tables with changed rows."""

import os

import duckdb

from lakesearch import catalog
from tests.oracle import TABLES, compare, connect

SF = "/root/testdata/sf0.001"


def changed(path, **selects):
    """A folder with the given tables; those named are replaced by what their SELECT makes of them."""
    for name in TABLES:
        given, own = f"{SF}/{name}.parquet", f"{path}/{name}.parquet"
        if name in selects:
            duckdb.sql(f"COPY ({selects[name].format(given=given)}) TO '{own}' (FORMAT parquet)")
        else:
            os.symlink(given, own)
    return str(path)


def differs(spark, sf, name):
    return compare(spark, connect(sf), sf, catalog.QUERIES[name], catalog.SQL[name])


def test_reranked_pool_with_hits_that_have_no_chunk(spark, tmp_path):
    """Blank documents have vectors but no chunks: they leave no gaps among a scorer's positions."""
    sf = changed(tmp_path, documents="SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE text END AS text) FROM '{given}'")
    assert differs(spark, sf, "h03_reranker_hook") is None


def test_pages_whose_urls_differ_in_what_normalising_drops(spark, tmp_path):
    """Records are kept by the URL as it stands."""
    sf = changed(tmp_path, pages="SELECT * REPLACE (CASE page_id % 2 WHEN 0 THEN 'https://h.example/a' || page_id // 2 ELSE 'https://h.example/a' || page_id // 2 || '?utm_source=feed' END AS url) FROM '{given}'")
    assert differs(spark, sf, "p12_not_collected") is None
