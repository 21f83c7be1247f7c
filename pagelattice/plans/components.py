"""Connected components of a graph by star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import staged


def _state(e: DataFrame) -> tuple:
    """A number that tells whether the links changed."""
    return tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link; component is the least node that is reachable.

    ``links`` has u and v of one type that can be ordered, in any direction, with repeats or loops. In a round every node
    hands its larger neighbours to the least one of all, and then its smaller ones: paths halve, so rounds grow with the logarithm of
    the longest one. Least neighbours are partial aggregates; a hub's side of a join may be split. Each round is a staged table.
    """
    e = staged(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = _state(e)
    while seen[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = staged(small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        now = _state(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
