"""Quality rules with robust multivariate outliers: minimum covariance determinants by language and source.

Five statistics of a text are transformed to a vector. For each language and source the vectors are put in units
of their median absolute deviation, and the share of them whose covariance has the least determinant is searched:
from four deterministic starts, concentration steps (estimate, rank all by Mahalanobis distance, keep the
closest share) are taken until the determinant falls no more, and the least one wins. Its estimate is reweighted
once, and a document is rejected if its squared distance passes the cut.

Texts of one kind often agree in a statistic: most have no symbol and no repeated line. Their covariance is
singular. Only such a matrix is regularised, as in the minimum regularised covariance determinant: a part of the
identity is mixed in, as small as a condition number of CONDITION allows.

Everything is a DataFrame or SQL function: moments and the histogram of distances that finds the share's edge are
partial aggregates, so a group of any size is never gathered in one task, and matrices are factored by column
expressions over one row a group and start.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, checked_broadcast, staged

WINDOW = 8
SHARE = 0.75
#: Concentration steps at most; a handful is the rule.
STEPS = 60
#: Probability that the vector of a clean document is beyond the cut, if vectors were normal.
TAIL = 1e-3
#: Words of the usual length of the group that are added to a text before its mean word length is taken, as that of few words varies.
USUAL = 100
#: Median absolute deviations up to this are taken for zero; the statistic is then left in its own unit, the step of a logarithm or the whole of a share.
JITTER = 1e-6
#: Condition number of a regularised matrix, and ratio of the trace to the least pivot beyond which a matrix is regularised.
CONDITION, SINGULAR = 50.0, 1000.0
D = 5
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
#: Bins of the logarithm of a squared distance.
FINE = 1024


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    fraction = 0.0
    for m in range(400, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        fraction = even / (1 + odd / (1 + fraction))
    return front / (1 - (a + b) * x / (a + 1) / (1 + fraction))


def chi2_cdf(x: float, k: int) -> float:
    a, x = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= x / (a + n)
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def _quantile(cdf, p: float, hi: float) -> float:
    lo = 0.0
    while cdf(hi) < p:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def chi2_quantile(p: float, k: int) -> float:
    return _quantile(lambda x: chi2_cdf(x, k) if x > 0 else 0.0, p, 100.0)


def f_cdf(x: float, k: int, n: int) -> float:
    return _incomplete_beta(k / 2, n / 2, k * x / (k * x + n))


#: Make the covariance of the closest share, and of those within the reweighting distance, consistent for normal vectors.
CONSISTENCY = SHARE / chi2_cdf(chi2_quantile(SHARE, D), D + 2)
WITHIN = chi2_quantile(0.975, D)
WITHIN_CONSISTENCY = 0.975 / chi2_cdf(WITHIN, D + 2)
CUT = chi2_quantile(1 - TAIL, D)
#: Rows of a group up to which the cut allows for the estimate's own error.
SMALL = 400


def cut(n: int) -> float:
    """Squared distance beyond which a document of a group of n rows is rejected: a scaled F quantile, near the chi-square one for many rows.

    Up to D + 1 rows no estimate has a meaning, and nothing is rejected.
    """
    if n <= D + 1:
        return math.inf
    return CUT if n > SMALL else D * (n * n - 1) / (n * (n - D)) * _quantile(lambda x: f_cdf(x, D, n - D), 1 - TAIL, 10.0)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words; null texts have no words.

    n_repeat_words counts the words that lie in a window of eight words that is found twice or more in the
    text; windows are compared by 64-bit hashes of their words' 64-bit hashes.
    """
    d = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("_t"))
    d = d.withColumn("_w", F.filter(F.split("_t", SPACE), lambda x: x != ""))
    d = d.withColumn("_l", F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.select(
        "doc_id", "lang", "source", F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
    )
    window = ", ".join(f"get(_h, i + {k})" for k in range(WINDOW))
    d = d.withColumn("_v", F.expr(f"if(size(_h) >= {WINDOW}, transform(sequence(0, size(_h) - {WINDOW}), i -> xxhash64({window})), array())"))
    d = d.withColumn("_s", F.expr("if(size(array_distinct(_v)) < size(_v), array_sort(transform(_v, (h, i) -> struct(h, i))), array())"))
    d = d.withColumn("_p", F.expr("array_sort(transform(filter(_s, (x, i) -> x.h <=> get(_s, i - 1).h or x.h <=> get(_s, i + 1).h), x -> x.i))"))
    d = d.withColumn("n_repeat_words", F.expr(f"aggregate(sequence(1, size(_p)), 0L, (n, i) -> n + least({WINDOW}, coalesce(get(_p, i) - get(_p, i - 1), {WINDOW})))"))
    d = d.withColumn("n_repeat_words", F.when(F.size("_p") > 0, F.col("n_repeat_words")).otherwise(F.lit(0)).cast("long"))
    return d.drop("_h", "_v", "_s", "_p")


def _group() -> Column:
    """Language and source as one string, in which null differs from any name."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return F.concat(name("lang"), F.lit("\x1f"), name("source"))


def _median(c) -> Column:
    return F.percentile_approx(c, 0.5, 10_000)


def _transformed(stats: DataFrame, usual: DataFrame) -> DataFrame:
    """Adds z0 ... z4: log words, log mean word length (USUAL usual words added), log symbol share, roots of the shares of repeated lines and words."""
    s = stats.join(checked_broadcast(usual), "g")
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    z = (
        F.log1p(F.col("n_words").cast("double")),
        F.log((F.col("word_chars") + USUAL * F.col("length")) / (F.col("n_words") + F.lit(float(USUAL)))),
        F.log1p(F.lit(100.0) * F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double")),
        F.sqrt(F.col("n_repeat_words") / n),
    )
    return s.withColumns({f"z{i}": x for i, x in enumerate(z)}).drop("length")


def _units(z: DataFrame) -> DataFrame:
    """Of each group the rows n, medians c0 ... c4 and units s0 ... s4."""
    mid = staged(z.groupBy("g").agg(F.count("*").alias("n"), *(_median(f"z{i}").alias(f"c{i}") for i in range(D))))
    j = z.join(checked_broadcast(mid), "g")
    mad = j.groupBy("g").agg(*(F.first(x).alias(x) for x in ("n", *(f"c{i}" for i in range(D)))), *(_median(F.abs(F.col(f"z{i}") - F.col(f"c{i}"))).alias(f"a{i}") for i in range(D)))
    return staged(mad.select("g", "n", *(f"c{i}" for i in range(D)), *(F.when(F.col(f"a{i}") > JITTER, F.col(f"a{i}") * F.lit(1.4826)).otherwise(F.lit(1.0)).alias(f"s{i}") for i in range(D))))


def _scaled(z: DataFrame, units: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep``, n and the vectors u0 ... u4 in units of their group."""
    return z.join(checked_broadcast(units), "g").select(*keep, "n", *(((F.col(f"z{i}") - F.col(f"c{i}")) / F.col(f"s{i}")).alias(f"u{i}") for i in range(D)))


def _sums(x: list[Column], inside: Column | None = None) -> list[Column]:
    """Aggregates of a vector: k rows, b (sums) and q (sums of products)."""
    only = (lambda c: c) if inside is None else (lambda c: F.when(inside, c))
    return [F.count(only(F.lit(1))).alias("k"), *(F.sum(only(x[i])).alias(f"b{i}") for i in range(D)), *(F.sum(only(x[i] * x[j])).alias(f"q{i}{j}") for i, j in PAIRS)]


def _moments(sums: DataFrame, keep: list[str], factor: float) -> DataFrame:
    """Means m and covariances v, times ``factor``, from sums."""
    m = sums.select(*keep, "k", *((F.col(f"b{i}") / F.col("k")).alias(f"m{i}") for i in range(D)), *(f"q{i}{j}" for i, j in PAIRS))
    return m.select(*keep, *(f"m{i}" for i in range(D)), *(((F.col(f"q{i}{j}") / F.col("k") - F.col(f"m{i}") * F.col(f"m{j}")) * F.lit(factor)).alias(f"v{i}{j}") for i, j in PAIRS))


def _factored(m: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l of v; pivots that vanish are taken as tiny."""
    for j in range(D):
        for i in range(j, D):
            rest = F.col(f"v{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            m = m.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-30))) if i == j else rest / F.col(f"l{j}{j}"))
    return m


def _model(m: DataFrame, keep: list[str]) -> DataFrame:
    """keep, means m, inverse p and determinant det of the covariance v, regularised where it is singular; rho is the share of the identity."""
    m = _factored(m).withColumn("trace", sum((F.col(f"v{i}{i}") for i in range(1, D)), F.col("v00")))
    least = F.least(*(F.col(f"l{i}{i}") * F.col(f"l{i}{i}") for i in range(D)))
    rho = F.when(F.col("trace") <= 1e-12, F.lit(1.0)).when(least * F.lit(SINGULAR) > F.col("trace"), F.lit(0.0)).otherwise(F.col("trace") / (F.lit(CONDITION - 1) + F.col("trace")))
    m = m.withColumn("rho", rho)
    mixed = lambda i, j: (F.lit(1.0) - F.col("rho")) * F.col(f"v{i}{j}") + (F.col("rho") if i == j else F.lit(0.0))
    m = _factored(m.select(*keep, "rho", *(f"m{i}" for i in range(D)), *(mixed(i, j).alias(f"v{i}{j}") for i, j in PAIRS)))
    for j in range(D):  # k: the inverse of l
        for i in range(j, D):
            if i == j:
                m = m.withColumn(f"k{i}{i}", F.lit(1.0) / F.col(f"l{i}{i}"))
            else:
                total = F.lit(0.0)
                for k in range(j, i):
                    total = total - F.col(f"l{i}{k}") * F.col(f"k{k}{j}")
                m = m.withColumn(f"k{i}{j}", total / F.col(f"l{i}{i}"))
    for i, j in PAIRS:
        total = F.lit(0.0)
        for k in range(i, D):
            total = total + F.col(f"k{k}{i}") * F.col(f"k{k}{j}")
        m = m.withColumn(f"p{i}{j}", total)
    det = F.col("l00") * F.col("l00")
    for i in range(1, D):
        det = det * F.col(f"l{i}{i}") * F.col(f"l{i}{i}")
    return staged(m.select(*keep, "rho", det.alias("det"), *(f"m{i}" for i in range(D)), *(f"p{i}{j}" for i, j in PAIRS)))


def _distances(rows: DataFrame, model: DataFrame, *keep: str) -> DataFrame:
    """keep, u and d2, the squared Mahalanobis distance, of every row to every model of its group."""
    j = rows.join(checked_broadcast(model), "g")
    total = F.lit(0.0)
    for a, b in PAIRS:
        term = (F.col(f"u{a}") - F.col(f"m{a}")) * (F.col(f"u{b}") - F.col(f"m{b}")) * F.col(f"p{a}{b}")
        total = total + (term if a == b else F.lit(2.0) * term)
    return j.select(*keep, *(f"u{i}" for i in range(D)), total.alias("d2"))


def _starts(u: DataFrame) -> DataFrame:
    """Four models (g, s) of every group: all rows as they are, the units alone, and the covariances of damped vectors and of directions."""
    x = [F.col(f"u{i}") for i in range(D)]
    r = F.greatest(F.sqrt(sum((c * c for c in x[1:]), x[0] * x[0])), F.lit(1e-12))
    plain = _moments(u.groupBy("g").agg(*_sums(x)), ["g"], 1.0).withColumn("s", F.lit(0))
    at_zero = lambda m: m.select("g", *(F.lit(0.0).alias(f"m{i}") for i in range(D)), *(f"v{i}{j}" for i, j in PAIRS))
    unit = u.select("g").distinct().select("g", *(F.lit(0.0).alias(f"m{i}") for i in range(D)), *(F.lit(float(i == j)).alias(f"v{i}{j}") for i, j in PAIRS)).withColumn("s", F.lit(1))
    damped = at_zero(_moments(u.groupBy("g").agg(*_sums([F.tanh(c) for c in x])), ["g"], 1.0)).withColumn("s", F.lit(2))
    turned = at_zero(_moments(u.groupBy("g").agg(*_sums([c / r for c in x])), ["g"], 1.0)).withColumn("s", F.lit(3))
    return _model(plain.unionByName(unit).unionByName(damped).unionByName(turned), ["g", "s"])


def _step(u: DataFrame, models: DataFrame) -> DataFrame:
    """A concentration step of every model: that of the closest share of the rows; rows in one bin of the histogram stay together."""
    bin_ = F.floor(F.log(F.greatest("d2", F.lit(1e-9))) * FINE)
    d = _distances(u, models, "g", "s").withColumn("bin", bin_)
    bins = d.groupBy("g", "s", "bin").agg(F.count("*").alias("n"))
    of = W.partitionBy("g", "s")
    edge = bins.withColumn("upto", F.sum("n").over(of.orderBy("bin"))).withColumn("all", F.sum("n").over(of)).where(F.col("upto") >= SHARE * F.col("all")).groupBy("g", "s").agg(F.min("bin").alias("edge"))
    near = d.join(checked_broadcast(staged(edge)), ["g", "s"]).where("bin <= edge")
    return _model(_moments(near.groupBy("g", "s").agg(*_sums([F.col(f"u{i}") for i in range(D)])), ["g", "s"], CONSISTENCY), ["g", "s"])


def least_determinants(u: DataFrame) -> DataFrame:
    """(g, s, rho, det, m, p): of each group the model with the least determinant that any start comes to; u: staged g and u0 ... u4."""
    now = _step(u, _starts(u))
    done = now.limit(0)
    for _ in range(STEPS):
        new = _step(u, now)
        old = now.select("g", "s", F.col("det").alias("before"))
        # models whose determinant no longer falls are done and keep the lesser one
        moved = staged(new.join(old, ["g", "s"]).withColumn("falls", F.col("det") < F.col("before") * (1 - 1e-9)))
        still = moved.where("not falls").select("g", "s")
        done = done.unionByName(now.join(still, ["g", "s"], "left_semi"))
        now = moved.where("falls").drop("falls", "before")
        if now.isEmpty():
            break
    best = done.unionByName(now)
    return staged(best.withColumn("rank", F.row_number().over(W.partitionBy("g").orderBy("det", "s"))).where("rank = 1").drop("rank"))


def _reweighted(u: DataFrame, model: DataFrame) -> DataFrame:
    near = _distances(u, model, "g").where(F.col("d2") <= WITHIN)
    return _model(_moments(near.groupBy("g").agg(*_sums([F.col(f"u{i}") for i in range(D)])), ["g"], WITHIN_CONSISTENCY), ["g"])


def _cut() -> Column:
    few = F.element_at(F.array(*(F.lit(cut(n)) for n in range(1, SMALL + 1))), F.least("n", F.lit(SMALL)).cast("int"))
    return F.when(F.col("n") <= SMALL, few).otherwise(F.lit(CUT))


def scores(docs: DataFrame, base_failed=None) -> DataFrame:
    """Statistics, base_failed, d2 and kept for every row of ``docs``.

    Every language and source has its own estimate, however few rows it has; the fewer, the wider the cut, and
    up to six rows reject nothing. Null languages and sources are groups of their own; null or empty texts have
    no words and fail the base rule; repeated rows count as often as they are there; an empty table gives no
    rows; other columns are not read. Rows that fail the base rule take no part in the estimates.
    """
    failed = base_failed if base_failed is not None else (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))
    s = staged(statistics(docs).withColumn("base_failed", failed).withColumn("g", _group()))
    keep = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    good = s.where("not base_failed")
    usual = staged(good.groupBy("g").agg(_median((F.col("word_chars") + 1) / F.greatest("n_words", F.lit(1))).alias("length")))
    z = staged(_transformed(good, usual).select("g", *keep, *(f"z{i}" for i in range(D))))
    units = _units(z)
    u = staged(_scaled(z, units, "g"))
    model = _reweighted(u, least_determinants(u))
    d = _distances(_scaled(z, units, "g", *keep), model, "n", *keep)
    passed = d.select(*keep, "d2", (F.col("d2") <= _cut()).alias("kept"))
    return passed.unionByName(s.where("base_failed").select(*keep, F.lit(None).cast("double").alias("d2"), F.lit(False).alias("kept")))
