"""Mixing sources to target weights by Pareto order sampling.

Targets: sources in code-point order (null last) take the weights in turn and share all words; a target
stops at ``max_copies`` times its source's words, and what is above is shared again by weight.

Within a source a document of ``size`` words wants m = min(max_copies, lambda * x) copies, where
x = 16 / (16 + floor(log2(size))) leans a little towards shorter documents and lambda makes the wanted
words meet the target. floor(m) copies are certain. The fraction pi = m - floor(m) is the inclusion
probability of one more copy: documents are ranked by [u / (1 - u)] / [pi / (1 - pi)], u a uniform number
derived from the document's id, and the order is taken up to the fixed size, which is the words that are
left of the target. The last place goes to the document whose size fits best what is still missing.

Nothing is ordered within a whole source: a histogram of the rank finds the slice in which the target is
met, and only that slice is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checked_broadcast, private, staged, word_count

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
#: Slices of the rank's histogram.
SLICES = 16384


def targets(units: DataFrame, weights: tuple = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from rows (source, size, n). One row a source."""
    s = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights)) + 1).cast("double"))
    fill = W.orderBy((F.lit(float(most)) * F.col("source_size") / F.col("w")), F.col("source").asc_nulls_last())
    before, everywhere = fill.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    s = s.withColumn("rest", (F.sum("source_size").over(everywhere) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))).cast("double"))
    s = s.withColumn("rest_w", F.sum("w").over(everywhere) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("full", F.lit(float(most)) * F.col("source_size") * F.col("rest_w") <= F.col("rest") * F.col("w"))
    first = F.min(F.when(~F.col("full"), F.struct((-F.col("rest_w")).alias("k"), (F.col("rest") / F.col("rest_w")).alias("x")))).over(everywhere)
    return s.select("source", "source_size", F.when(F.col("full"), F.lit(float(most)) * F.col("source_size")).otherwise(first["x"] * F.col("w")).alias("target"))


def _lean(size):
    """x of the module's text; exact division of small integers, so that every engine gets the same."""
    return F.lit(16.0) / (F.lit(15.0) + F.length(F.bin(size)).cast("double"))


def _uniform(doc_id):
    """A number in (0, 1) from the first 52 bits of a digest of the id."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4503599627370496.0)


def _wanted(df: DataFrame, most: int) -> DataFrame:
    """Adds m, whole, pi and q (null where pi is 0); needs size, lam and doc_id."""
    m = F.when(F.col("size") > 0, F.least(F.lit(float(most)), F.col("lam") * _lean(F.col("size")))).otherwise(F.lit(0.0))
    df = df.withColumn("m", m).withColumn("whole", F.floor("m").cast("long")).withColumn("pi", F.col("m") - F.floor("m")).withColumn("draw", _uniform(F.col("doc_id")))
    return df.withColumn("q", F.when(F.col("pi") > 0, (F.col("draw") / (F.lit(1.0) - F.col("draw"))) / (F.col("pi") / (F.lit(1.0) - F.col("pi"))))).drop("draw")


def plan(units: DataFrame, weights: tuple = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """One row a source with all that decides on its documents: source_size, target, lam, and the last (q, doc_id) of the order that is taken (end_q, end_id), and the best fitting one (fit_id, fit_size).

    ``units`` has source, doc_id, size and n (how many equal rows). Equal rows share one decision.
    """
    t = targets(units, weights, most)
    level = units.where("size > 0").withColumn("x", _lean(F.col("size"))).groupBy("source", "x").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    level = level.alias("l").join(t.alias("t"), F.col("l.source").eqNullSafe(F.col("t.source"))).select("t.source", "x", "words", "target")
    by = W.partitionBy("source").orderBy(F.col("x").desc())
    done = F.coalesce(F.sum("words").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum(F.col("words") * F.col("x")).over(W.partitionBy("source").orderBy(F.col("x").asc()))
    level = level.withColumn("lam", (F.col("target") - most * done) / open_)
    # the first level, from the largest x, that isn't full; where all are full, any lambda that fills the last one
    lam = level.groupBy("source").agg(F.max(F.when(F.col("lam") * F.col("x") < most, F.struct("x", "lam"))).alias("open"), F.max(F.lit(float(most)) / F.col("x")).alias("all_full"))
    lam = lam.select("source", F.coalesce(F.col("open.lam"), F.col("all_full")).alias("lam"))
    t = t.alias("t").join(lam.alias("a"), F.col("t.source").eqNullSafe(F.col("a.source")), "left").select("t.*", F.coalesce("a.lam", F.lit(0.0)).alias("lam"))
    t = staged(t)
    u = units.alias("u").join(checked_broadcast(t.select(F.col("source").alias("s"), "lam"), 20_000), F.col("u.source").eqNullSafe(F.col("s"))).drop("s")
    u = _wanted(u, most).withColumn("words", F.col("size") * F.col("n")).withColumn("slice", F.floor(F.lit(float(SLICES)) * (F.col("q") / (F.lit(1.0) + F.col("q")))))
    u = staged(u.select("source", "doc_id", "size", "words", "whole", "q", "slice"))
    sums = u.groupBy("source", "slice").agg(F.sum("words").alias("words"), F.sum(F.col("words") * F.col("whole")).alias("certain"))
    sums = sums.alias("s").join(checked_broadcast(t, 20_000).alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.*", "target")
    sums = sums.withColumn("left", F.col("target") - F.sum("certain").over(W.partitionBy("source"))).where("slice is not null")
    sums = sums.withColumn("upto", F.sum("words").over(W.partitionBy("source").orderBy("slice")))
    # the slice in which the words that are left are met
    met = sums.where(F.col("upto") > F.col("left")).groupBy("source").agg(F.min(F.struct("slice", (F.col("left") - (F.col("upto") - F.col("words"))).alias("left"))).alias("m"))
    met = staged(met.select(F.col("source").alias("s"), F.col("m.slice").alias("at"), F.col("m.left").alias("left")))
    small_met = checked_broadcast(met, 20_000)
    inside = u.join(small_met, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("at")))
    inside = inside.withColumn("run", F.sum("words").over(W.partitionBy("source").orderBy("q", F.col("doc_id").asc_nulls_first())))
    end = inside.where(F.col("run") <= F.col("left")).groupBy("source").agg(F.max(F.struct("q", "doc_id", "run")).alias("e"))
    end = met.join(end, F.col("source").eqNullSafe(F.col("s")), "left").select("s", "at", F.col("e.q").alias("end_q"), F.col("e.doc_id").alias("end_id"), (F.col("left") - F.coalesce("e.run", F.lit(0))).alias("left"))
    end = staged(end)
    rest = u.join(checked_broadcast(end, 20_000), F.col("source").eqNullSafe(F.col("s"))).where(F.col("q").isNotNull() & ~_before_end())
    fit = rest.withColumn("miss", F.abs(F.col("words") - F.col("left"))).where(F.col("miss") < F.col("left"))
    fit = fit.groupBy("source").agg(F.min(F.struct("miss", "q", "doc_id", "size")).alias("f")).select(F.col("source").alias("fs"), F.col("f.doc_id").alias("fit_id"), F.col("f.size").alias("fit_size"))
    out = t.join(end.drop("left"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return out.join(fit, F.col("source").eqNullSafe(F.col("fs")), "left").drop("fs")


def _before_end():
    """Whether (q, slice, doc_id) is within the part of its source's order that is taken."""
    same = (F.col("slice") == F.col("at")) & F.col("end_q").isNotNull() & ((F.col("q") < F.col("end_q")) | ((F.col("q") == F.col("end_q")) & (F.col("doc_id").isNull() | F.coalesce(F.col("doc_id") <= F.col("end_id"), F.lit(False)))))
    return F.col("at").isNull() | (F.col("slice") < F.col("at")) | same


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (words) added.

    Null or empty texts have size 0 and 0 copies; a null source is a source of its own, last in order;
    rows with equal id, source and size share one decision; an empty table gives an empty one; columns of
    the input that have one of the added names are replaced. Decisions depend on ids and sizes alone, so
    reruns agree.
    """
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    sized = docs.select(*kept).withColumn("size", word_count(F.col("text")))
    units = staged(sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n")))
    p = staged(plan(units, weights, most))
    p = p.select(F.col("source").alias("_s"), F.col("source_size").alias("_ss"), F.col("target").alias("_t"), "lam", "at", "end_q", "end_id", "fit_id", "fit_size")
    d, names = private(docs.select(*kept), "doc_id", "source", "text")
    d = d.withColumn("size", word_count(F.col("text"))).join(checked_broadcast(p, 20_000), F.col("source").eqNullSafe(F.col("_s")))
    d = _wanted(d, most).withColumn("slice", F.floor(F.lit(float(SLICES)) * (F.col("q") / (F.lit(1.0) + F.col("q")))))
    fits = F.col("fit_size").isNotNull() & (F.col("size") == F.col("fit_size")) & F.col("doc_id").eqNullSafe(F.col("fit_id"))
    more = F.coalesce(F.col("q").isNotNull() & (_before_end() | fits), F.lit(False))
    copies = F.col("whole") + F.when(more, 1).otherwise(0)
    back = [F.col(names[c]).alias(c) for c in kept]
    return d.select(*back, "size", F.col("_ss").alias("source_size"), F.col("_t").alias("target"), copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with the columns of ``docs``."""
    m = mix(docs, weights, most)
    # the outer form, filtered above: a filter on copies would be pushed down and count the words once more
    rows = m.select(*docs.columns, F.explode_outer(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_copy_"))
    return rows.where(F.col("_copy_").isNotNull()).select(*docs.columns)


#: The same plan in plain SQL, with whole windows where the operator uses a histogram.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0))::DOUBLE AS rest, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS rest_w
       FROM s1 WINDOW b AS (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, 3.0::DOUBLE * source_size * rest_w <= rest * w AS is_full FROM s2),
t AS (SELECT source, source_size, CASE WHEN is_full THEN 3.0::DOUBLE * source_size
        ELSE (SELECT arg_max(rest / rest_w, rest_w) FROM s3 WHERE NOT is_full) * w END AS target FROM s3),
dx AS (SELECT d.*, 16.0::DOUBLE / (15.0::DOUBLE + length(bin(size))::DOUBLE) AS x FROM d),
lv AS (SELECT source, x, sum(size)::DOUBLE AS words FROM dx WHERE size > 0 GROUP BY source, x),
l1 AS (SELECT lv.source, x, (target - 3 * coalesce(sum(words) OVER (PARTITION BY lv.source ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(words * x) OVER (PARTITION BY lv.source ORDER BY x) AS lam FROM lv JOIN t ON lv.source IS NOT DISTINCT FROM t.source),
l2 AS (SELECT source, coalesce(arg_max(lam, x) FILTER (WHERE lam * x < 3), max(3.0::DOUBLE / x)) AS lam FROM l1 GROUP BY source),
u0 AS (SELECT dx.*, target, source_size, CASE WHEN size > 0 THEN least(3.0::DOUBLE, coalesce(lam, 0.0) * x) ELSE 0.0::DOUBLE END AS m,
          (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS draw
       FROM dx JOIN t ON dx.source IS NOT DISTINCT FROM t.source LEFT JOIN l2 ON dx.source IS NOT DISTINCT FROM l2.source),
u1 AS (SELECT *, floor(m)::BIGINT AS whole, m - floor(m) AS pi FROM u0),
u2 AS (SELECT *, CASE WHEN pi > 0 THEN (draw / (1.0::DOUBLE - draw)) / (pi / (1.0::DOUBLE - pi)) END AS q, target - sum(size * whole) OVER (PARTITION BY source) AS rest FROM u1),
u3 AS (SELECT *, CASE WHEN q IS NOT NULL THEN sum(size) FILTER (WHERE q IS NOT NULL) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id NULLS FIRST) END AS run FROM u2),
u4 AS (SELECT *, coalesce(run <= rest, false) AS took, rest - coalesce(max(run) FILTER (WHERE run <= rest) OVER (PARTITION BY source), 0) AS missing FROM u3),
f AS (SELECT source, arg_min(doc_id, (abs(size - missing), q, doc_id)) AS fit_id FROM u4 WHERE q IS NOT NULL AND NOT took AND abs(size - missing) < missing GROUP BY source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN took OR coalesce(doc_id = fit_id AND q IS NOT NULL, false) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM u4 LEFT JOIN f ON u4.source IS NOT DISTINCT FROM f.source
"""
