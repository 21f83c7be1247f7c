"""What keeps time and memory of large tables in bounds: minima by a kernel, merged batches, bounded Arrow batches, parts evaluated once."""

import numpy as np
import pyarrow as pa

from pagelattice.operators import documents, rollups
from pagelattice.plans.stage import BATCH_BYTES, in_batches


def test_minima_of_a_batch_of_sources_in_one_row_each():
    texts = ["a b c d e f g", "a b c d e", "q r", "a b c d e"]
    pairs = documents.coefficients(20)
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "x", None, "x"]), pa.array(texts)], names=["by", "t"])
    out = [r for b in rollups._merged(5, pairs)(iter([batch])) for r in b.to_pylist()]
    (one,) = list(documents._minima(5, pairs)(iter([batch])))
    sig = one.column(1).to_pylist()
    assert out == [{"by": "x", "docs": 3, "sig": [min(v) for v in zip(sig[0], sig[1], sig[3])]}, {"by": None, "docs": 1, "sig": sig[2]}]


def test_kernel_against_whole_numbers():
    p, rng = documents.PRIME, np.random.default_rng(5)
    pairs = [(p - 1, p - 1), (1, 0), (1, p - 1), (p - 1, 1), *documents.coefficients(9)]
    h = np.array([0, 1, 2, p - 2, p - 1, *rng.integers(0, p, 700)], dtype=np.int64)
    for part in (h, h[:1], h[3:5], h[:256], h[:257]):
        assert documents._kernel(pairs)(part).tolist() == [min((int(x) * a + b) % p for x in part) for a, b in pairs]


def test_batches_of_pages_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    df = spark.createDataFrame([(1, "https://a.test/x/1", "one two")], "page_id long, url string, html string")
    for make in (rollups.vocabulary_rollup, rollups.template_uniqueness, rollups.template_audit):
        spark.conf.unset(name)
        make(df)
        assert int(spark.conf.get(name)) <= BATCH_BYTES


def test_a_batch_has_a_megabyte(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["bytes", "rows"])

    rows = in_batches(spark.range(0, 3000, 1, 1).selectExpr("repeat('x', 1000) AS t"), sizes, "bytes long, rows long").collect()
    assert sum(r.rows for r in rows) == 3000 and max(r.bytes for r in rows) < 2 << 20


def test_parts_of_a_rewrite_are_evaluated_once(spark):
    df = documents.sentence_rewrites(spark.createDataFrame([(1, "x")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[,;:]$") == 1


def test_words_are_cut_once(spark):
    docs = spark.createDataFrame([(1, "s", "one two"), (2, "s", "12 34"), (3, "s", None)], "doc_id long, source string, text string")
    for df in (documents.signed(docs, docs["doc_id"]), rollups.merged_signatures(docs, docs["doc_id"]), documents._source_shingles(docs, 5)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
        assert df.count() == 1
    assert documents.signed(docs, docs["doc_id"], all_rows=True).where("sig is null").count() == 2


def test_keys_that_one_node_has_are_not_joined(spark):
    rows = [("a", 1), ("b", 1), ("a", 2), ("b", 2), ("c", 3), ("a", 4), ("c", 4), ("d", 5), ("d", 5)]
    got = documents.shared_keys(spark.createDataFrame(rows, "node string, key long")).select("key", "node").collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (1, "b"), (4, "a"), (4, "c"), (5, "d"), (5, "d")]
