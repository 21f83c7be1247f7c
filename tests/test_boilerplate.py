"""Boilerplate of sources against SQL: sources of one to thirty documents, of equal and mixed lengths, with texts without words and none."""

import random

import duckdb
import pytest

from pagelattice import catalog
from pagelattice.operators import documents


def test_boilerplate_of_small_sources(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefghij") * 3
    chrome, rows = [[word() for _ in range(9)] for _ in range(40)], []
    for s in range(40):
        n = s // 2 + 1 if s < 38 else 30
        for i in range(n):
            own = [word() for _ in range(rng.choice([0, 3, 30, 300]) if s % 2 else 20)]
            text = " ".join((chrome[s] if rng.random() < 0.9 else []) + own)
            rows.append((len(rows), None if s == 9 else f"s{s}", rng.choice([None, "1 2", text]) if rng.random() < 0.08 else text))
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    want = con.sql(f"with documents as (select * from '{tmp_path}/documents.parquet/*.parquet') select source, docs, common_shingles, mean_share from ({catalog.ORACLES['boilerplate_ratio']})").fetchall()
    got = [tuple(r) for r in catalog.QUERIES["boilerplate_ratio"](spark, str(tmp_path)).collect()]
    key = lambda r: (str(r[0]), r[1:3])
    assert sorted(map(key, got)) == sorted(map(key, want)) and sum(r[2] > 0 for r in got) > 10
    assert {r[0]: r[3] for r in got} == pytest.approx({r[0]: r[3] for r in want}, abs=1e-4)


def test_long_documents_are_not_shuffled(spark, monkeypatch):
    made = []
    real = documents._source_shingles
    monkeypatch.setattr(documents, "_source_shingles", lambda d, k: made.append(d) or real(d, k))
    own = lambda i, n: " ".join("".join(chr(97 + int(c)) for c in f"{i:03}{j:04}") for j in range(n))
    rows = [(i, "a", "one two three four five " + own(i, 10 if i < 40 else 3000)) for i in range(100)]
    got = documents.boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert [tuple(r)[:3] for r in got] == [("a", 100, 1)] and made[0].count() <= 40
