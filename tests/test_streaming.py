"""A stream over finite files gives what the batch gives."""

import os

import pytest

from pagelattice.sources.tables import load
from pagelattice.streaming import events as E

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not there")
@pytest.mark.parametrize("f", [E.windowed_counts, E.sliding_counts, E.session_counts])
def test_stream_is_batch(spark, f, tmp_path):
    batch = load(spark, SF, "events")
    batch.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = f(E.read_stream(spark, str(tmp_path / "in"), batch.schema))
    got = E.run_once(stream, f.__name__, "complete" if f is not E.session_counts else "complete").collect()
    assert sorted(map(str, got)) == sorted(map(str, f(batch).collect()))


def test_backoff(spark, tmp_path):
    rows = [("a", False), ("a", False), ("b", True), ("a", False), ("b", False)]
    spark.createDataFrame(rows, "host string, ok boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("host string, ok boolean").parquet(str(tmp_path / "in"))
    got = {r.host: (r.failures, r.wait_seconds) for r in E.run_once(E.backoff(stream), "backoff", "update").collect()}
    assert got == {"a": (3, 12), "b": (1, 3)}
