"""From raw documents to token digests: classify, drop repeated lines, drop near copies, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, the next one's docs; all but the last return
the columns of ``docs``. Null and empty texts, repeated rows and empty tables pass through every stage as the
operators define it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.llm import bpe, line_dedup, minhash_dedup, mixing, rule_classifier
from pagelattice.llm.common import read, staged
from pagelattice.llm.queries import vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    return rule_classifier.accepted(docs, rule_classifier.train(docs, read(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-equal lines one stays; documents stay, n_chars follows the text."""
    d = line_dedup.deduplicated(docs).select(*docs.columns)
    return d.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else d


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minhash_dedup.deduplicated(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents as often as they are taken."""
    return mixing.mixed(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of ids and of the text they decode to, one row a taken document."""
    return bpe.round_trip(docs, bpe.Bpe(vocabulary()))


STAGES = [("quality classifier", quality_classifier), ("line dedup", line_dedup_stage), ("near dedup", near_dedup), ("source mixing", source_mixing), ("bpe encoding", bpe_encoding)]

#: The classifier and the fuzzy lines can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
