"""Keywords of rows that share an id, or have none, against SQL; ids of their own are done without a shuffle of grams."""

import random

import duckdb

from pagelattice import catalog


def test_keywords_of_shared_ids(spark, tmp_path):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "alphabet", "the", "ab", "Delta", "x1", "naïve"]
    rows = [(i % 7 if i < 20 else None if i < 23 else i, rng.choice([None, "", " ".join(rng.choices(words, k=60))]) if i % 5 == 0 else " ".join(rng.choices(words, k=60))) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    want = con.sql(f"with documents as (select * from '{tmp_path}/documents.parquet/*.parquet') select doc_id, term, score, rank from ({catalog.ORACLES['keyword_ngrams'] })").fetchall()
    got = [tuple(r) for r in catalog.QUERIES["keyword_ngrams"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len({g[0] for g in got}) > 20


def test_grams_are_not_shuffled(spark):
    from pagelattice.operators import documents

    df = documents.keywords(spark.createDataFrame([(1, "one two"), (2, "one one one one")], "doc_id long, text string"))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in df.collect()] == [(2, "one one one", 10, 1)]
