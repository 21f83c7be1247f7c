"""Streams run to their end give what whole tables give: paced hosts and drop alerts, in several micro-batches and out of order."""

import random

import pytest
from pyspark.sql import functions as F

from pagelattice.operators import models
from pagelattice.streaming import finite


def brute_release(rows, delay, burst):
    """A bucket of tokens by hand: host -> list of (url, arrival, release)."""
    out, due, seen = [], {}, set()
    for at, host, url in sorted(rows):
        if (host, url) in seen:
            continue
        seen.add((host, url))
        go = max(at, due[host] - (burst - 1) * delay) if host in due else at
        due[host] = max(at, due.get(host, at)) + delay
        out.append((host, url, at, go))
    return sorted(out)


def pages(spark, path, files=5):
    rng = random.Random(2)
    rows = [(i, f"https://{rng.choice('aab')}.test/p{rng.randrange(40)}") for i in range(0, 9000, 60)] + [(4, None), (None, "https://a.test/x"), (8999, "https://late.test/"), (0, "https://a.test/p1"), (0, "https://a.test/p1/")]
    rng.shuffle(rows)
    spark.createDataFrame([(i, u, "x") for i, u in rows], "page_id long, url string, host string").repartition(files).write.parquet(path)
    return [(i, u.split("/")[2], u.rstrip("/")) for i, u in rows if u and i is not None]


@pytest.mark.parametrize(("delay", "burst", "files"), [(600, 2, None), (100, 1, 2), (300, 3, 1)])
def test_hosts_are_paced(spark, tmp_path, delay, burst, files):
    rows = pages(spark, str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in finite.frontier_of(spark, str(tmp_path / "pages.parquet"), delay, burst, files=files).collect())
    want = brute_release(rows, delay, burst)
    assert got == want
    for host in {r[0] for r in got}:  # in any stretch of time no more than the bucket's tokens
        t = sorted(r[3] for r in got if r[0] == host)
        assert all(t[i + burst] - t[i] >= delay for i in range(len(t) - burst))
    df = spark.createDataFrame([(h, u, a) for a, h, u in rows], "host string, url string, arrival long")
    assert sorted(tuple(r) for r in finite.paced(df, delay, burst).collect()) == want


def test_drop_alerts_of_a_stream(spark, tmp_path):
    rng = random.Random(3)
    days = [d for d in range(40) if d not in (25,)]
    rows = [(f"2024-02-{1 + d:02} {rng.randrange(24):02}:10:00" if d < 29 else f"2024-03-{d - 28:02} 05:00:00", d) for d in days for _ in range(rng.randrange(3, 30) if d < 30 else 3)]
    rng.shuffle(rows)
    e = spark.createDataFrame(rows, "ts string, user_id long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    e.repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    got = finite.drops_of(spark, str(tmp_path / "events.parquet"), late="60 days", files=1)
    want = models.traffic_drops(spark.read.parquet(str(tmp_path / "events.parquet")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and any(r.alert for r in want.collect()) and got.columns == want.columns


def test_streams_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    assert finite.frontier_of(spark, str(tmp_path / "pages.parquet")).count() == 0
