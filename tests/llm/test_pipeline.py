"""The corpus pipeline's stages, one after the other, on a small folder and on edge cases."""

import os
import random

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402

from pagelattice.llm import bpe, queries  # noqa: E402


@pytest.fixture()
def folder(spark, tmp_path):
    rng = random.Random(1)
    text = lambda n: "\n".join(" ".join(f"w{rng.randrange(900)}" for _ in range(15)) + "." for _ in range(n))
    rows = [(i, text(rng.randrange(2, 8)), "en", rng.choice("abc"), 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "b", 0) for i in range(5)] + [(200 + i, " ".join("x###" for _ in range(80)), "en", "a", 0) for i in range(8)] + [(300, None, None, None, None), (301, "", "en", "a", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 200), 0) for i, *_ in rows if i < 300], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, folder)
        assert new.columns == docs.columns
        docs = spark.createDataFrame(new.toPandas().astype(object).where(lambda f: f.notna(), None), docs.schema)
        sizes.append(docs.count())
    assert sizes[1] <= sizes[0] - 8 and sizes[2] == sizes[1] and sizes[3] <= sizes[2]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder).toPandas()
    model = bpe.Bpe(queries.vocabulary())
    want = sorted(len(x) // 4 for x in model.encode([r.text for r in docs.collect()]))
    assert sorted(out.n_tokens) == want and len(out) == sizes[4]


def test_empty(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="tables are not there")
def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100
