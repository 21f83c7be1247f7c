"""Signatures and vocabularies of groups of pages or documents, rolled up from parts that merge."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions import urls as U
from ..plans.stage import in_batches, small, staged
from .documents import _halves, _hashed, _joined, _kernel, _worded, coefficients
from .page_audit import parsed


def _merged(k: int, pairs: list[tuple[int, int]]):
    """Of each batch of (by, t): by, rows and the minimum of every hash over the shingles of all its texts, a shingle of a group hashed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = _kernel(pairs)
        for batch in map(_worded, batches):
            texts = defaultdict(list)
            for g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts[g].append(t)
            sig = [least(np.unique(np.concatenate([_hashed(t, k) for t in set(x)]))) for x in texts.values()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.column(0).type), pa.array(list(map(len, texts.values())), pa.int64()), pa.array(sig, pa.list_(pa.int64()))], names=["by", "docs", "sig"])

    return run


def merged_signatures(docs: DataFrame, by: Column, k: int = 5, n: int = 256) -> DataFrame:
    """by (a plain value), docs (rows with words) and sig: the signature of all texts of a group as one set of shingles.

    A minimum over a group is the least of its parts' minima, so signatures are made of a batch's texts of the group at a time and merge in n partial minima, whatever the
    group's size. Null is a group of its own; rows without words are in none.
    """
    d = _joined(docs, by.alias("by"))
    s = in_batches(d, _merged(k, coefficients(n)), f"by {d.schema['by'].dataType.simpleString()}, docs long, sig array<long>")
    g = s.groupBy("by").agg(F.sum("docs").alias("docs"), *(F.min(F.get("sig", F.lit(i))).alias(f"m{i}") for i in range(n)))
    return g.select("by", "docs", F.array(*(f"m{i}" for i in range(n))).alias("sig"))


def group_similarity(docs: DataFrame, by: Column, k: int = 5, n: int = 256, least: float = 0.0) -> DataFrame:
    """a, b (a < b) and similarity of groups that have a minimum in common, from merged signatures; at least ``least``.

    The estimate of a Jaccard similarity J has a deviation of sqrt(J (1 - J) / n): with 256 places it is within 0.125 of J but for one pair in
    10,000. Groups meet by an equi join on place and minimum: there are n rows a group, whatever its texts.
    """
    s = merged_signatures(docs, by, k, n).where("by is not null").select("by", F.posexplode("sig").alias("i", "v"))
    x, y = s.select(F.col("by").alias("a"), "i", "v"), s.select(F.col("by").alias("b"), "i", "v")
    g = x.join(y, ["i", "v"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("c"))
    return g.select("a", "b", (F.col("c") / F.lit(float(n))).alias("similarity")).where(F.col("similarity") >= least)


def pattern(url: Column) -> Column:
    """Site and URL template of a page."""
    return F.concat(U.host(url), U.template(url))


def _shingles(pages: DataFrame, k: int) -> DataFrame:
    """site, pattern, row (a number of the page, good within this frame), n (distinct shingles of the page), x and y (halves of a shingle's digest), a row a shingle."""
    t = pages.select(U.host(F.col("url")).alias("site"), pattern(F.col("url")).alias("pattern"), H.visible(F.coalesce("html", F.lit(""))).alias("text"), F.monotonically_increasing_id().alias("row"))
    # what names a page travels as one column of text
    s = in_batches(_joined(t, F.to_json(F.struct("site", "pattern", "row")).alias("source")), _halves(k), "source string, x array<long>, y array<long>")
    s = s.select(F.from_json("source", "site string, pattern string, row long").alias("g"), F.size("x").alias("n"), F.arrays_zip("x", "y").alias("h"))
    return s.select("g.site", "g.pattern", "g.row", "n", F.explode("h").alias("h")).select("site", "pattern", "row", "n", "h.x", "h.y")


#: Gates of template groups: share of unique text below which a group is stopped or warned of, words, and pages of a large group.
STOP, WARN, WORDS, LARGE, HUGE = 0.30, 0.40, 300, 100, 500


def template_uniqueness(pages: DataFrame, least: int = 3, k: int = 5) -> DataFrame:
    """pattern, pages, avg_words, shingles, unique_shingles, uniqueness and gate of URL templates with ``least`` pages.

    uniqueness: mean over pages with words of the share of their shingles that no other page of the template has. Every shingle of
    document frequency one brings one over the number of its page's shingles, so one shuffle by template and shingle is enough; counts are partial.
    gate: stop below STOP or with HUGE pages below WARN, warn below WARN or WORDS on average or with LARGE pages, else pass.
    """
    df = _shingles(pages, k).groupBy("pattern", "x", "y").agg(F.count("*").alias("df"), F.min("n").alias("n"))
    s = df.groupBy("pattern").agg(F.count("*").alias("shingles"), F.count_if(F.col("df") == 1).alias("unique_shingles"), F.sum(F.when(F.col("df") == 1, F.lit(1.0) / F.col("n"))).alias("parts"))
    w = pages.select(pattern(F.col("url")).alias("pattern"), F.size(T.words(H.visible(F.coalesce("html", F.lit(""))))).alias("words"), F.size(T.ascii_words(H.visible(F.coalesce("html", F.lit(""))))).alias("letters"))
    g = w.groupBy("pattern").agg(F.count("*").alias("pages"), T.rounded(F.avg("words"), 1).alias("avg_words"), F.count_if(F.col("letters") > 0).alias("worded")).where(F.col("pages") >= least)
    u = T.rounded(F.coalesce(F.col("parts"), F.lit(0.0)) / F.greatest("worded", F.lit(1)), 4)
    j = g.join(s, "pattern", "left").select("pattern", "pages", "avg_words", F.coalesce("shingles", F.lit(0)).alias("shingles"), F.coalesce("unique_shingles", F.lit(0)).alias("unique_shingles"), u.alias("uniqueness"))
    stop = (F.col("uniqueness") < STOP) | ((F.col("pages") >= HUGE) & (F.col("uniqueness") < WARN))
    return j.withColumn("gate", F.when(stop, "stop").when((F.col("uniqueness") < WARN) | (F.col("avg_words") < WORDS) | (F.col("pages") >= LARGE), "warn").otherwise("pass"))


def vocabulary_rollup(pages: DataFrame, k: int = 5, lg_k: int = 12) -> DataFrame:
    """site, pattern (null: the whole site), shingles in all and distinct ones, estimated by theta sketches over both levels at once.

    A sketch has 2 ** lg_k hashes, whatever it has seen, and merges; estimates are within 5 % (about three deviations of 1 / sqrt(4096)), exact for less.
    """
    s = _shingles(pages, k).select("site", "pattern", F.xxhash64("x", "y").alias("h"))
    g = s.groupingSets([["site", "pattern"], ["site"]], "site", "pattern").agg(F.count("*").alias("shingles"), F.theta_sketch_estimate(F.theta_sketch_agg("h", lg_k)).alias("distinct_shingles"))
    return g.select("site", "pattern", "shingles", "distinct_shingles")


def _unique_pages(pages: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """pattern, hard_stop and warned: pages of a group (pattern, pages) by the percentage of their shingles that are no boilerplate of the group."""
    # a shingle of a template is two numbers, the template is in the first; the template's pages travel with it, and no text is shuffled
    s = _shingles(pages, k).join(small(groups), "pattern").select("pattern", "row", "n", "pages", F.xxhash64("pattern", "x").alias("x"), "y")
    df = s.groupBy("x", "y").agg(F.count("*").alias("df"), F.min("pages").alias("pages"))
    common = staged(df.where(F.col("df") >= F.greatest(F.lit(2.0), F.lit(0.8) * F.col("pages"))).select("x", "y", F.lit(1).alias("common")))
    per = s.join(small(common, 1_000_000), ["x", "y"], "left").groupBy("pattern", "row").agg(F.count("common").alias("c"), F.first("n").alias("n"))
    unique = F.round(F.lit(100.0) - F.lit(100.0) * F.col("c") / F.col("n"), 6)
    return per.groupBy("pattern").agg(F.count("*").alias("worded"), F.count_if(unique < 100 * STOP).alias("stopped"), F.count_if((unique >= 100 * STOP) & (unique < 100 * WARN)).alias("warned"))


def template_audit(pages: DataFrame, least: int = 3, k: int = 5) -> DataFrame:
    """Counts, critical findings, warnings and risk of every URL template with ``least`` pages: the audit of generated pages.

    Critical: most pages are thin, pages with under 30 % text that isn't boilerplate (a page without words has none), under 80 % distinct titles. Warnings: some thin
    pages, pages with 30 to 40 %, repeated titles, missing or repeated descriptions and first headings, missing canonicals, most pages without a link to another page of the template.
    risk: high with a critical finding, medium with more than two warnings, else low. Facts are one scan; shingles are shuffled by template and digest.
    """
    p = parsed(pages)
    f = p.select(
        "site", pattern(F.col("url")).alias("pattern"), U.normal_b(F.col("url")).alias("norm"), "words", F.coalesce("title", F.lit("")).alias("title"), "meta_description", F.col("first_h1").alias("h1"), (F.size("canonicals") == 0).alias("bare"), F.array_distinct("targets").alias("targets"),
        F.monotonically_increasing_id().alias("row"),
    )
    f = staged(f)
    g = f.groupBy("site", "pattern").agg(
        F.count("*").alias("pages"), F.count_if(F.col("words") < WORDS).alias("thin"), F.count_distinct("title").alias("titles"), F.count_distinct("meta_description").alias("descriptions"), F.count("meta_description").alias("described"),
        F.count_distinct("h1").alias("h1s"), F.count("h1").alias("headed"), F.count_if("bare").alias("without_canonical"),
    ).where(F.col("pages") >= least)
    g = staged(g)
    own = f.select("pattern", F.col("norm").alias("target")).distinct()
    linked = f.select("pattern", "row", "norm", F.explode("targets").alias("target")).where("target <> norm").join(own, ["pattern", "target"]).select("pattern", "row").distinct().groupBy("pattern").agg(F.count("*").alias("cross_linked"))
    j = g.join(_unique_pages(pages, g.select("pattern", "pages"), k), "pattern", "left").join(linked, "pattern", "left").na.fill(0, ["worded", "stopped", "warned", "cross_linked"])
    j = j.withColumn("hard_stop", F.col("stopped") + F.col("pages") - F.col("worded"))
    one = lambda c: F.when(c, 1).otherwise(0)
    n = F.col("pages")
    critical = one(F.col("thin") * 2 > n) + one(F.col("hard_stop") > 0) + one(F.col("titles") * 10 < n * 8)
    warnings = (
        one((F.col("thin") > 0) & (F.col("thin") * 2 <= n)) + one(F.col("warned") > 0) + one((F.col("titles") < n) & (F.col("titles") * 10 >= n * 8)) + one(F.col("described") < n) + one(F.col("descriptions") < F.col("described")) + one(F.col("headed") < n)
        + one(F.col("h1s") < F.col("headed")) + one(F.col("without_canonical") > 0) + one((n - F.col("cross_linked")) * 2 > n)
    )
    j = j.select("site", "pattern", "pages", "thin", "titles", "hard_stop", "warned", "described", "headed", "without_canonical", "cross_linked", critical.alias("critical"), warnings.alias("warnings"))
    return j.withColumn("risk", F.when(F.col("critical") > 0, "high").when(F.col("warnings") > 2, "medium").otherwise("low"))


def site_audit(pages: DataFrame, least: int = 3) -> DataFrame:
    """site, its template groups, critical findings, warnings and risk: high with a critical one, medium above three warnings."""
    g = template_audit(pages, least).groupBy("site").agg(F.count("*").alias("groups"), F.sum("pages").alias("pages"), F.sum("critical").alias("critical"), F.sum("warnings").alias("warnings"))
    return g.withColumn("risk", F.when(F.col("critical") > 0, "high").when(F.col("warnings") > 3, "medium").otherwise("low"))
