"""Quality classifier: a sparse rule ensemble over text statistics, compiled to Spark column expressions.

Shallow boosted trees are grown on statistics of a bounded sample of labelled documents. Every path from a
root to a node is a rule, a conjunction of comparisons; a lasso logistic regression gives most rules a weight
of zero. What is left is one column expression, so that scoring is a scan with no join, model file or Python.
Labels, language, source and id are never statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, held_out, private

#: Labelled rows that a model is fitted on at most: those whose ids come first by hash.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE = 40, 3, 32, 0.3
#: Penalties that are tried, as shares of the least one that gives no rules.
PENALTIES = (0.1, 0.03, 0.01, 0.003)
THRESHOLD = 0.3
STATISTICS = (
    "words", "word_length", "longest_word", "distinct_share", "repeat_share", "symbol_share", "bang_share", "bar_share", "upper_share", "digit_share",
    "stop_share", "comma_share", "other_share", "lines", "line_words", "dup_line_share",
)


def statistics(docs: DataFrame, keep: tuple = ()) -> DataFrame:
    """doc_id, the columns ``keep``, and one double for each of STATISTICS; all are finite, also for null and empty texts."""
    d = docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("_t"))
    d = d.withColumn("_w", F.filter(F.split("_t", SPACE), lambda x: x != "")).withColumn("_l", F.filter(F.split("_t", "\n", -1), lambda x: F.trim(x) != ""))
    n, chars = F.greatest(F.size("_w"), F.lit(1)).cast("double"), F.greatest(F.length("_t"), F.lit(1)).cast("double")
    lines = F.greatest(F.size("_l"), F.lit(1)).cast("double")
    count = lambda pattern: F.regexp_count("_t", F.lit(pattern)).cast("double")
    d = d.withColumns({"_again": F.expr("if(size(_w) > 1, size(filter(_w, (x, i) -> x = get(_w, i - 1))), 0)"), "_longest": F.coalesce(F.array_max(F.transform("_w", lambda x: F.length(x))), F.lit(0))})
    values = {
        "words": F.log1p(F.size("_w").cast("double")),
        "word_length": F.length(F.array_join("_w", "")) / n,
        "longest_word": F.log1p(F.col("_longest").cast("double")),
        "distinct_share": F.size(F.array_distinct("_w")) / n,
        "repeat_share": F.col("_again") / n,
        "symbol_share": count(r"[#*$%&<>]") / n,
        "bang_share": count("!") / n,
        "bar_share": count(r"\|") / n,
        "upper_share": count(r"\p{Lu}") / chars,
        "digit_share": count(r"\p{Nd}") / chars,
        "stop_share": count(r"\.") / n,
        "comma_share": count(",") / n,
        "other_share": count(r"[^\p{L}\p{Nd}\s.,]") / chars,
        "lines": F.log1p(F.size("_l").cast("double")),
        "line_words": F.log1p(F.size("_w") / lines),
        "dup_line_share": (F.size("_l") - F.size(F.array_distinct("_l"))) / lines,
    }
    return d.select("doc_id", *keep, *(values[s].alias(s) for s in STATISTICS))


#: A rule: (statistic, whether at most, value), all of which hold.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class Ensemble:
    """Rules with their weights; the score is the logistic function of bias plus the weights of the rules that hold."""

    rules: list[Rule]
    weights: list[float]
    bias: float

    def score(self) -> Column:
        total = F.lit(float(self.bias))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = None
            for s, at_most, value in rule:
                c = F.col(STATISTICS[s])
                test = c <= F.lit(float(value)) if at_most else c > F.lit(float(value))
                holds = test if holds is None else holds & test
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def apply(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            z += weight * holds(rule, x)
        return 1 / (1 + np.exp(-z))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for s, at_most, value in rule:
        out &= x[:, s] <= value if at_most else x[:, s] > value
    return out


def _edges(x: np.ndarray) -> list[np.ndarray]:
    """Candidate cuts of each statistic: midpoints between neighbouring values, at most BINS of them by quantile."""
    out = []
    for column in x.T:
        v = np.unique(column)
        mid = (v[:-1] + v[1:]) / 2
        out.append(mid if len(mid) <= BINS else np.unique(mid[np.searchsorted(mid, np.quantile(column, np.linspace(0.01, 0.99, BINS))).clip(0, len(mid) - 1)]))
    return out


def _grow(binned: np.ndarray, edges: list, rows: np.ndarray, gradient: np.ndarray, weight: np.ndarray, features: np.ndarray, depth: int, path: Rule, found: list) -> list:
    """Leaves (rows, value) of one tree on second-order gains; adds the path to each node to ``found``."""
    g, h = gradient[rows], weight[rows]
    value = -g.sum() / (h.sum() + 1.0)
    if path:
        found.append(path)
    best = None
    if depth and len(rows) >= 8:
        base = g.sum() ** 2 / (h.sum() + 1.0)
        for f in features:
            if not len(edges[f]):
                continue
            b, size = binned[rows, f], len(edges[f]) + 1
            gl, hl, nl = np.cumsum(np.bincount(b, g, size))[:-1], np.cumsum(np.bincount(b, h, size))[:-1], np.cumsum(np.bincount(b, minlength=size))[:-1]
            gain = gl**2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0) - base
            gain[(nl < 4) | (len(rows) - nl < 4)] = -1
            k = int(gain.argmax())
            if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                best = (gain[k], int(f), k)
    if best is None:
        return [(rows, value)]
    _, f, k = best
    left = binned[rows, f] <= k
    cut = float(edges[f][k])
    return _grow(binned, edges, rows[left], gradient, weight, features, depth - 1, (*path, (f, True, cut)), found) + _grow(binned, edges, rows[~left], gradient, weight, features, depth - 1, (*path, (f, False, cut)), found)


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray, steps: int = 300) -> np.ndarray:
    """Logistic regression with an L1 penalty on all but the first weight, by accelerated proximal steps."""
    v = np.ones(r.shape[1], r.dtype)
    for _ in range(50):  # the largest curvature, by power iteration over all rows
        v = r.T @ (r @ v)
        v /= np.linalg.norm(v) + 1e-30
    lipschitz = 0.25 * float(np.linalg.norm(r @ v)) ** 2 / len(r) * 1.1 + 1e-9
    w, z, t = start.copy(), start.copy(), 1.0
    for _ in range(steps):
        grad = r.T @ (1 / (1 + np.exp(-(r @ z).clip(-30, 30))) - y) / len(y)
        new = z - grad / lipschitz
        new[1:] = np.sign(new[1:]) * np.maximum(0, np.abs(new[1:]) - penalty / lipschitz)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Ensemble:
    """Rules and weights from statistics and 0/1 labels; the penalty is chosen on a quarter of the rows.

    No rows, or one class only: no rules and a bias that answers with the share of 1 (0.5 without rows).
    """
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return Ensemble([], [], float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    edges = _edges(x)
    binned = np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)], axis=1)
    margin, found = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        rows = np.sort(rng.choice(len(y), max(16, len(y) // 2), replace=len(y) < 32))
        features = rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False)
        tree: list = []
        leaves = _grow(binned, edges, rows, p - y, p * (1 - p) + 1e-6, features, DEPTH, (), tree)
        found += tree
        for leaf, value in leaves:
            margin[leaf] += RATE * value
    unique: dict[bytes, Rule] = {}
    for rule in dict.fromkeys(found):
        mask = holds(rule, x)
        if 0 < mask.sum() < len(y):
            unique.setdefault(np.packbits(mask).tobytes(), rule)
    rules = list(unique.values())
    r = np.stack([np.ones(len(y)), *(holds(rule, x) for rule in rules)], axis=1).astype(np.float32)
    check = rng.random(len(y)) < 0.25
    highest = float(np.abs(r[:, 1:].T @ (y.mean() - y)).max() / len(y)) or 1.0
    base = np.zeros(r.shape[1], np.float32)
    base[0] = np.log(y.mean() / (1 - y.mean()))
    best, loss = PENALTIES[1], np.inf
    if check.any() and not check.all() and 0 < y[~check].mean() < 1:
        w = base
        for share in PENALTIES:
            w = _lasso(r[~check], y[~check], share * highest, w)
            p = 1 / (1 + np.exp(-(r[check] @ w).clip(-30, 30)))
            now = -np.mean(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p))
            if now < loss * 0.99:
                best, loss = share, now
    w = _lasso(r, y, best * highest, base, 600)
    used = np.flatnonzero(np.abs(w[1:]) > 1e-4)
    return Ensemble([rules[i] for i in used], [float(w[1 + i]) for i in used], float(w[0]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Ensemble:
    """Fit on at most ``sample`` labelled documents that are not held out; nothing else of ``labels`` is read."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).cast("double").alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"), ("_y",))
    # rows that share an id are one example, the least of them, so that no more than ``sample`` come to the driver
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("_y", *STATISTICS)).alias("r")).select("r.*").toPandas()
    rows = rows.sort_values(list(rows.columns), ignore_index=True)
    return fit(rows[list(STATISTICS)].to_numpy(float), rows["_y"].to_numpy(float))


def scores(docs: DataFrame, model: Ensemble, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null and empty texts are scored by their statistics (all zero).

    Repeated rows get equal scores; a null doc_id is not held out; an empty table gives no rows.
    """
    s = statistics(docs).select("doc_id", model.score().alias("score"))
    return s.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Ensemble, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with their columns.

    Null and empty texts, null ids and repeated rows are kept or rejected by their score, as in ``scores``;
    columns of any name are passed on; an empty table gives an empty one.
    """
    d, names = private(docs, "doc_id", "text")
    keep = [x for x in names.values() if x != "doc_id"]
    s = statistics(d, tuple(keep))
    # the score is a generator's output: a filter on a plain column would be pushed below the statistics, whose
    # expressions would then be evaluated again in every comparison of every rule
    s = s.select("doc_id", *keep, F.explode_outer(F.array(model.score())).alias("_score")).where(F.col("_score") >= threshold)
    return s.select(*(F.col(names[c]).alias(c) for c in docs.columns))
