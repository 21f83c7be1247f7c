"""Blanks at the ends of texts, sentences and pages: SQL's trim takes off all space separators of Unicode."""

import duckdb
import pytest

from pagelattice import catalog

SPACES = " \u00a0\u1680\u2000\u2007\u200a\u202f\u205f\u3000"


@pytest.mark.parametrize("name", ["readability_b", "long_sentences_topk", "exact_dups"])
def test_documents(spark, tmp_path, name):
    texts = [*(f"One cake.{c}! Two pies ate it.{c}" for c in SPACES), *(c * 2 for c in SPACES), "One cake.\u200b! Two", "\t", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    want = con.sql(f"with documents as (select * from '{tmp_path}/documents.parquet/*.parquet') select * from ({catalog.ORACLES[name]})")
    got = catalog.QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert got and sorted(map(tuple, got)) == sorted(want.fetchall())


def test_pages(spark, tmp_path):
    pages = [(i, f"https://a.example/{i}", f"<p>{c}one two{c}</p>") for i, c in enumerate(SPACES)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    want = con.sql(f"with pages as (select * from '{tmp_path}/pages.parquet/*.parquet') select * from ({catalog.ORACLES['duplicate_pages']})")
    got = catalog.QUERIES["duplicate_pages"](spark, str(tmp_path)).select(*want.columns).collect()
    assert {r.exact_pages for r in got} == {len(SPACES)} and sorted(map(tuple, got)) == sorted(want.fetchall())
