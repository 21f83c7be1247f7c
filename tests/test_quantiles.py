"""Quantiles by histograms against sorted values, with ties, hot groups and groups without values."""

import random

import numpy as np
import pytest

from pagelattice.plans import quantiles as Q


@pytest.mark.parametrize("q", [0.0, 0.5, 0.75, 0.9, 1.0])
def test_quantiles(spark, q, monkeypatch):
    monkeypatch.setattr(Q, "BINS", 8)
    monkeypatch.setattr(Q, "LEAF", 20)
    rng = random.Random(7)
    rows = [("hot", rng.gauss(0, 1) ** 5) for _ in range(3000)] + [("ties", float(rng.randrange(3))) for _ in range(500)] + [("same", 4.5)] * 100 + [(None, rng.random()) for _ in range(60)]
    rows += [("one", -1.0), ("two", 1.0), ("two", 2.0), ("void", None), ("far", 1e300), ("far", -1e300), ("far", 0.0)] + [("wide", 10.0 ** rng.randrange(-12, 12)) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: (r.n, r["quantile"]) for r in Q.quantiles(df, "g", "v", q).collect()}
    by = {}
    for g, v in rows:
        if v is not None:
            by.setdefault(g, []).append(v)
    assert {g: n for g, (n, _) in got.items()} == {g: len(v) for g, v in by.items()}
    for g, v in by.items():
        assert got[g][1] == pytest.approx(float(np.quantile(v, q)), rel=1e-12, abs=1e-12)


def test_no_values(spark):
    assert Q.quantiles(spark.createDataFrame([], "g string, v double"), "g", "v", 0.5).count() == 0
