"""Queries over documents of white space only, which the given small tables don't hold, against their SQL."""

import shutil

import duckdb
import pytest

from tests.oracle import TABLES, compare, connect

GIVEN = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def blanks(tmp_path_factory):
    """The given tables with every 23rd document blank; all languages and several sources have some."""
    sf = tmp_path_factory.mktemp("blanks")
    for name in TABLES:
        shutil.copy(f"{GIVEN}/{name}.parquet", sf)
    (sf / "documents.parquet").unlink()
    kinds = "['', ' ', chr(10), ' ' || chr(10) || '  '][((doc_id // 23) % 4 + 1)::INT]"
    duckdb.sql(f"COPY (SELECT doc_id, CASE WHEN doc_id % 23 = 0 THEN {kinds} ELSE text END AS text, lang, source, n_chars FROM '{GIVEN}/documents.parquet') TO '{sf}/documents.parquet'")
    return str(sf)


@pytest.mark.parametrize("name", ["x12_canonical_markdown", "s03_corpus_pages", "s03_corpus_paging", "s15_text_extraction"])
def test_query(spark, blanks, name):
    from lakesearch import catalog

    assert compare(spark, connect(blanks), blanks, catalog.QUERIES[name], catalog.SQL[name]) is None
