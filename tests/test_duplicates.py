"""Components of graphs and groups of duplicate pages against brute force, with bands that many nodes share."""

import random

import numpy as np
import pytest

from pagelattice.operators import documents, duplicates
from pagelattice.plans.components import connected


def brute(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def test_connected(spark):
    rng = random.Random(1)
    links = [(f"n{i:03}", f"n{i + 1:03}") for i in range(100)] + [(f"m{rng.randrange(60):02}", f"m{rng.randrange(60):02}") for _ in range(40)] + [("hub", f"z{i}") for i in range(50)] + [("hub", "hub"), ("hub", "z1")]
    want = brute({x for e in links for x in e}, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.component for r in connected(spark.createDataFrame(links, "u string, v string")).collect()}
    assert got == {x: want[x] for x in linked}
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


def signatures():
    """Signatures by name: copies with few changes, chains, and a crowd that shares most bands but is too far apart to be linked."""
    rng = np.random.default_rng(3)
    out = {}
    for g in range(6):
        base = rng.integers(0, 2**31, 100)
        for i in range(12):
            x = base.copy()
            x[rng.choice(100, rng.integers(0, 14), replace=False)] = rng.integers(0, 2**31, 1)
            out[f"g{g}-{i:02}"] = x
    x = rng.integers(0, 2**31, 100)
    for i in range(10):  # a chain: neighbours differ in 14 places, others in more
        out[f"c{i:02}"] = x.copy()
        x[14 * i % 100 : 14 * i % 100 + 14] = rng.integers(0, 2**31, len(x[14 * i % 100 : 14 * i % 100 + 14]))
    crowd = rng.integers(0, 2**31, 100)
    for i in range(60):
        y = crowd.copy()
        y[80:] = rng.integers(0, 2**31, 20)
        out[f"d{i:02}"] = y
        if i % 5 == 0:  # two of the crowd that are near each other, not the least one
            z = y.copy()
            z[80:90] = rng.integers(0, 2**31, 10)
            out[f"e{i:02}"] = z
    return out


@pytest.mark.parametrize("block", [8, 512])
def test_near_components_lose_no_link(spark, block):
    sigs = signatures()
    names = sorted(sigs)
    links = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if (sigs[a] == sigs[b]).sum() >= 85]
    want = brute(names, links)
    df = spark.createDataFrame([(k, [int(x) for x in v]) for k, v in sigs.items()], "node string, sig array<long>")
    got = {r.node: r.component for r in duplicates.near_components(df, block=block).collect()}
    assert got == {x: want[x] for x in {y for e in links for y in e}}
    assert len(set(got.values())) > 15 and want["e05"] == "d05" and want["d05"] != want["d00"]


@pytest.mark.parametrize(("threshold", "bands"), [(0.85, 20), (0.81, 20), (0.95, 20), (0.9, 12)])
def test_keys_are_lossless(spark, threshold, bands):
    rng = np.random.default_rng(4)
    most = int((1 - threshold) * 100 + 1e-9)
    rows = []
    for i in range(60):
        x = rng.integers(0, 2**31, 100)
        y = x.copy()
        # the hardest case: every changed place is in another band
        r = 100 // bands
        at = [b * r + int(rng.integers(r)) for b in rng.permutation(bands)[:most]]
        y[at] += 1
        rows.append((i, x.tolist(), y.tolist()))
    df = spark.createDataFrame(rows, "i int, x array<long>, y array<long>")
    k = df.select(documents.band_keys(df["x"], threshold, 100, bands).alias("a"), documents.band_keys(df["y"], threshold, 100, bands).alias("b")).collect()
    assert all(set(r.a) & set(r.b) for r in k)


def test_too_few_bands_are_refused(spark):
    with pytest.raises(ValueError, match="bands"):
        documents.band_keys(spark.range(1)["id"], 0.8, 100, 20)


def test_report_of_pages(spark):
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}word" for i in range(200)]
    page = lambda t: f"<html><nav>menu</nav><body>{t}</body></html>"
    near = " ".join([*words[:-1], "other"])
    rows = [(5, page(" ".join(words))), (2, page(" ".join(words).upper())), (9, page(near)), (1, page("few words")), (3, page("few  words")), (4, None), (None, page("12 34")), (7, page("12 34")), (8, "")]
    df = spark.createDataFrame([(i, f"https://a.test/{i}", h, 1) for i, h in rows], "page_id long, url string, html string, exact int")
    got = {r.page_id: tuple(r)[1:] for r in duplicates.duplicate_report(df).collect()}
    assert got[5] == (200, "warning", 2, 2, 2, 3) == got[2] and got[9] == (200, "warning", 9, 1, 2, 3)
    assert got[1] == (2, "critical", 1, 2, 1, 2) == got[3] and got[4] == (0, "critical", None, None, None, None) == got[8] and got[7] == (2, "critical", 7, 2, 7, 2) == got[None]
    assert duplicates.duplicate_report(df.limit(0)).count() == 0


def test_near_pairs_of_rows_that_share_an_id(spark):
    words = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    other = " ".join(f"{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(60))
    rows = [("a", words), ("a", other), ("b", words + "."), ("c", None)]
    got = sorted(tuple(r) for r in documents.near_pairs(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert got == [("a", "b", 1.0)]
