"""Token counts from an exact histogram of encoded lengths.

Documents are aggregated by their number of tokens (partial sums before the shuffle); suffix sums over the
lengths then answer, for every context limit, how many documents and tokens there are, how many would be
cut, and what remains after truncation. Suffix sums are taken in blocks of lengths, so that no window holds
all lengths: totals of blocks first, then within each block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import Bpe, encode
from .common import staged

#: Lengths of one block of the suffix sums.
BLOCK = 1024


def lengths(docs: DataFrame, bpe: Bpe) -> DataFrame:
    """(doc_id, n_tokens) for every document; null and empty texts have 0 tokens."""
    return encode(docs, bpe).select("doc_id", F.expr("length(ids_le) div 4").cast("long").alias("n_tokens"))


def histogram(counts: DataFrame) -> DataFrame:
    """One row per length: n_tokens, n_docs, and the sums that answer every context limit.

    docs_longer and tokens_longer: of documents with more tokens than this; docs_upto: with at most as
    many, so the q-quantile of lengths is the first row with docs_upto >= q * (docs_upto + docs_longer);
    tokens_kept: tokens that remain if every document is cut to n_tokens; tokens_lost: what that cuts off.
    Null lengths are not counted; no documents: no rows.
    """
    h = staged(counts.where("n_tokens is not null").groupBy("n_tokens").agg(F.count("*").alias("n_docs")).withColumn("block", F.expr(f"n_tokens div {BLOCK}")))
    words = F.col("n_tokens") * F.col("n_docs")
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(words).alias("t"))
    after, before = W.orderBy(F.col("block").desc()).rowsBetween(W.unboundedPreceding, -1), W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    blocks = blocks.select("block", zero(F.sum("d").over(after)).alias("d_after"), zero(F.sum("t").over(after)).alias("t_after"), zero(F.sum("d").over(before)).alias("d_before"), zero(F.sum("t").over(before)).alias("t_before"))
    down, up = W.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(W.unboundedPreceding, -1), W.partitionBy("block").orderBy("n_tokens")
    h = h.join(blocks, "block").select(
        "n_tokens", "n_docs",
        (F.col("d_after") + zero(F.sum("n_docs").over(down))).alias("docs_longer"), (F.col("t_after") + zero(F.sum(words).over(down))).alias("tokens_longer"),
        (F.col("d_before") + F.sum("n_docs").over(up)).alias("docs_upto"), (F.col("t_before") + F.sum(words).over(up)).alias("tokens_upto"),
    )
    kept = F.col("tokens_upto") + F.col("n_tokens") * F.col("docs_longer")
    return h.withColumn("tokens_kept", kept).withColumn("tokens_lost", F.col("tokens_longer") - F.col("n_tokens") * F.col("docs_longer"))


def _bounds(hist: DataFrame) -> DataFrame:
    """Stretches [lo, hi) of context limits that one row of the histogram answers, with a row for limits below all lengths."""
    zero = F.lit(0).cast("long")
    # the row below the least length: every document is longer
    first = hist.agg(F.min("n_tokens").alias("hi"), F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens")).where("hi is not null")
    below = first.select(zero.alias("lo"), "hi", F.col("docs").alias("docs_longer"), zero.alias("tokens_upto"))
    ends = hist.select("n_tokens", F.col("docs_longer"), (F.col("tokens_kept") - F.col("n_tokens") * F.col("docs_longer")).alias("tokens_upto"), F.expr(f"n_tokens div {BLOCK}").alias("block"))
    # the next length: within a block, or the least of the next block
    least = ends.groupBy("block").agg(F.min("n_tokens").alias("least"))
    following = least.select("block", F.lead("least").over(W.orderBy("block")).alias("after"))
    inside = F.lead("n_tokens").over(W.partitionBy("block").orderBy("n_tokens"))
    rows = ends.withColumn("next", inside).join(following, "block").select(F.col("n_tokens").alias("lo"), F.coalesce("next", "after").alias("hi"), "docs_longer", "tokens_upto")
    return below.where("lo < hi").unionByName(rows)


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(max_tokens, docs_cut, tokens_kept) for given limits of at least 0, also such as no document has exactly; one row of the sums answers each.

    No documents: no rows.
    """
    holds = F.filter(F.array(*[F.lit(int(x)).cast("long") for x in sorted(set(limits))]), lambda x: (x >= F.col("lo")) & (F.col("hi").isNull() | (x < F.col("hi"))))
    rows = _bounds(hist).withColumn("asked", holds).where(F.size("asked") > 0).select(F.explode("asked").alias("max_tokens"), "docs_longer", "tokens_upto")
    return rows.select("max_tokens", F.col("docs_longer").alias("docs_cut"), (F.col("tokens_upto") + F.col("max_tokens") * F.col("docs_longer")).alias("tokens_kept"))


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length with at least that share of the documents at or below it. No documents: no rows."""
    before = F.col("docs_upto") - F.col("n_docs")
    total = F.col("docs_upto") + F.col("docs_longer")
    asked = F.array(*[F.lit(float(x)) for x in sorted(set(shares))])
    # a share belongs to the row whose documents its rank falls on; rank 1 at least
    rank = lambda x: F.greatest(F.lit(1.0), F.ceil(x * total - F.lit(1e-9)).cast("double"))
    rows = hist.withColumn("asked", F.filter(asked, lambda x: (rank(x) > before) & (rank(x) <= F.col("docs_upto"))))
    return rows.where(F.size("asked") > 0).select(F.explode("asked").alias("share"), "n_tokens")
