"""Registered queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, id_files, line_dedup, merkle, minhash_dedup, mixing, quality_rules, rule_classifier, token_histogram, toxicity, vector_codes, warc_index
from .common import read

#: File of the vocabulary; a parameter of the operators.
VOCABULARY = "byte_bpe_50k.json"
#: Id after each document in files of ids.
END_ID = 2


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_robust_outlier_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = quality_rules.scores(read(spark, sf_dir, "documents"))
    return s.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), bpe.Bpe(vocabulary()))


def op8_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op9_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_histogram.histogram(token_histogram.lengths(read(spark, sf_dir, "documents"), bpe.Bpe(vocabulary())))


def op5_rule_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return rule_classifier.scores(docs, rule_classifier.train(docs, read(spark, sf_dir, "labels")))


def op6_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.deduplicated(read(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_lines", "n_dropped", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_kept"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op7_warc_index_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = warc_index.archive_and_read(read(spark, sf_dir, "pages"))
    return r.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op11_id_file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(vocabulary(), encoding="utf-8") as f:
        spec = f.read()
    docs = read(spark, sf_dir, "documents")
    return id_files.read(id_files.stored(docs, spec, END_ID), docs.select("doc_id")).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_filtering_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compressed(read(spark, sf_dir, "embeddings"))
    return vector_codes.with_label_errors(codes).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proved(read(spark, sf_dir, "documents"), merkle.tampered(F.col("doc_id")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_robust_outlier_rules": op1_robust_outlier_rules,
    "op2_source_mixing": op2_source_mixing,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_rule_quality_classifier": op5_rule_quality_classifier,
    "op6_fuzzy_line_dedup": op6_fuzzy_line_dedup,
    "op7_warc_index_first": op7_warc_index_first,
    "op8_lexicon_toxicity": op8_lexicon_toxicity,
    "op9_token_histogram": op9_token_histogram,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_id_file_index": op11_id_file_index,
    "op12_filtering_lloyd_codes": op12_filtering_lloyd_codes,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES: dict[str, str] = {
    "op2_source_mixing": mixing.ORACLE,
    "op3_minhash_near_dedup": minhash_dedup.ORACLE,
    "op7_warc_index_first": warc_index.ORACLE,
    "op10_embedding_near_dedup": embedding_dedup.ORACLE,
    "op12_filtering_lloyd_codes": vector_codes.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
