"""Exact quantiles of groups with bounded state: the rank is looked for in histograms that get finer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stage import small, staged

#: Bins of a histogram, and values of a group that are put in order at last.
BINS, LEAF = 1024, 10_000


def quantiles(df: DataFrame, by: str, value: str, q: float) -> DataFrame:
    """by, n (values) and quantile, interpolated between the two values next to the rank q * (n - 1); null values don't count.

    Each round reads the values once and keeps, of every group, the bin that has the rank, from its least to its greatest value, until it holds LEAF
    values or a single one. A task holds at most BINS counts a group, and no step holds a group's values. Groups without values have none.
    """
    v = df.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null")
    s = v.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    s = staged(s.withColumns({"k": F.floor((F.col("n") - 1) * q), "before": F.lit(0).cast("long"), "held": F.col("n")}))
    open_ = (F.col("held") > LEAF) & (F.col("lo") < F.col("hi"))
    while not s.where(open_).isEmpty():
        inside = v.join(small(s.where(open_).withColumnRenamed("g", "h")), F.col("g").eqNullSafe(F.col("h"))).where("v between lo and hi")
        place = F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS))
        bins = inside.groupBy("g", place.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("z"), *(F.first(x).alias(x) for x in ("n", "k", "before")))
        bins = bins.withColumn("below", F.col("before") + F.coalesce(F.sum("c").over(W.partitionBy("g").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        one = bins.where((F.col("below") <= F.col("k")) & (F.col("k") < F.col("below") + F.col("c")))
        s = staged(s.where(~open_).unionByName(one.select("g", "n", F.col("a").alias("lo"), F.col("z").alias("hi"), "k", F.col("below").alias("before"), F.col("c").alias("held"))))
    j = v.join(small(s.withColumnRenamed("g", "h")), F.col("g").eqNullSafe(F.col("h")))
    above = j.where("v > hi").groupBy("g").agg(F.min("v").alias("next"))
    # a bin of one value needs no order; the others have at most LEAF values
    order = W.partitionBy("g").orderBy("v")
    few = j.where("lo < hi and v between lo and hi").select("g", "v", (F.row_number().over(order) - 1 + F.col("before")).alias("rank"), "k")
    two = few.where("rank between k and k + 1").groupBy("g").agg(F.min_by("v", "rank").alias("x"), F.max(F.when(F.col("rank") == F.col("k") + 1, F.col("v"))).alias("y"))
    r = s
    for side, names in ((above, ["next"]), (two, ["x", "y"])):
        r = r.join(side.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h")), "left").select(*r.columns, *names)
    x = F.coalesce("x", "lo")
    y = F.coalesce("y", F.when((F.col("lo") == F.col("hi")) & (F.col("k") + 1 < F.col("before") + F.col("held")), F.col("lo")), "next", x)
    part = (F.col("n") - 1) * F.lit(q) - F.col("k")
    return r.select(F.col("g").alias(by), "n", (x + (y - x) * part).alias("quantile"))
