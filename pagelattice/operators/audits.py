"""Audits: all detectors over one set of pages, fixes by platform, and the rule tables that rate sites, passages and reviews.

The audit itself is one pass over pages, in page_audit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions import urls as U
from ..plans import dims
from . import pages as P
from .page_audit import audit_findings  # noqa: F401  the audit of whole pages
from .scoring import _clamp

def site_risk(groups: DataFrame) -> DataFrame:
    """site, critical and warnings over its template groups, and risk: high with a critical one, medium above 3 warnings."""
    g = groups.groupBy("site").agg(F.sum("critical").alias("critical"), F.sum("warnings").alias("warnings"))
    return g.withColumn("risk", F.when(F.col("critical") > 0, "high").when(F.col("warnings") > 3, "medium").otherwise("low"))


def thin_pages_first(pages: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` pages with fewest words (a report's top list): page_id, words."""
    return P.thin_content(pages).select("page_id", "words").orderBy("words", "page_id").limit(k)


def largest_groups(groups: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` largest template groups (a report's top list): pattern, pages."""
    return groups.select("pattern", "pages").orderBy(F.col("pages").desc(), "pattern").limit(k)


def self_canonical_pairs(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """Near-duplicate pairs (url_a, url_b, similarity) of which both pages name themselves canonical. Two equi joins."""
    own = pages.where(U.normal_d(F.get(F.split("canonicals", r"\|"), F.lit(0))) == U.normal_d(F.col("url"))).select("url").distinct()
    kept = pairs.join(own.withColumnRenamed("url", "url_a"), "url_a", "left_semi").join(own.withColumnRenamed("url", "url_b"), "url_b", "left_semi")
    return kept.select("url_a", "url_b", "similarity", F.lit("high").alias("severity"))


def with_canonical(onpage: DataFrame, audited: DataFrame) -> DataFrame:
    """url and canonical of on-page facts, filled from the canonical audit's header where the page names none."""
    filled = audited.groupBy("url").agg(F.min("header_canonical").alias("h"))
    return onpage.join(filled, "url", "left").select("url", F.coalesce(F.get(F.split("canonicals", r"\|"), F.lit(0)), "h").alias("canonical"))


def _hint(platform: Column, area: str) -> Column:
    own = F.create_map(*(F.lit(x) for p, h in dims.FIX_PLACES.items() if area in h for x in (p, h[area])))
    return F.coalesce(own[platform], F.lit(dims.FIX_PLACES["other"][area]))


def environment_fixes(m: DataFrame) -> DataFrame:
    """site, place, severity, fix and where to make it on the site's platform, the most severe first; 'none' if nothing is to be fixed.

    ``m`` has one row a site: platform, title, description, h1s, headers_missing, has_llms, and counts; a null count is none.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    size = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit(""))))
    grave = lambda c, k: F.when(n(c) >= k, "critical").otherwise("warning")
    one = lambda s: F.lit(s)
    checks = [
        ("add_h1", one("critical"), n("h1s") == 0, "heading"), ("description_length", one("warning"), ~size("description").between(110, 170), "metadata"),
        ("title_length", one("warning"), ~size("title").between(30, 65), "metadata"), ("add_headers", grave("headers_missing", 4), n("headers_missing") > 0, "headers"),
        ("add_llms", one("warning"), ~F.coalesce("has_llms", F.lit(False)), "llms"), ("repair_links", grave("broken", 5), n("broken") > 0, "links"),
        ("answer_404", one("warning"), n("soft_404") > 0, "links"), ("sitemap_404", one("critical"), n("sitemap_404") > 0, "links"),
        ("sitemap_soft_404", one("warning"), n("sitemap_soft_404") > 0, "links"),
        ("sitemap_patterns", F.when(n("sitemap_templates") > 0, "critical").otherwise("warning"), (n("sitemap_templates") > 0) | (n("sitemap_searches") > 0), "links"),
        ("canonical_errors", one("critical"), n("canonical_critical") > 0, "metadata"),
        ("add_canonical", one("warning"), (n("canonical_critical") == 0) & F.col("canonical").isNull(), "metadata"),
        ("link_to_final_urls", grave("redirected", 5), n("redirected") > 0, "links"), ("template_errors", one("critical"), n("template_critical") > 0, "metadata"),
        ("template_warnings", one("warning"), (n("template_critical") == 0) & (n("template_warnings") > 2), "metadata"),
        ("alternate_pages", grave("alternates", 10), n("alternates") > 0, "metadata"), ("broken_pages", one("critical"), n("broken_pages") > 0, "links"),
        ("soft_404_pages", one("warning"), n("soft_404_pages") > 0, "links"), ("card_tags", one("warning"), n("card_tags_missing") > 0, "metadata"),
        ("measure_speed", one("info"), F.coalesce("speed_failed", F.lit(False)), "performance"),
        ("shorten_sentences", one("warning"), (F.coalesce("reading_ease", F.lit(100.0)) < 40) | (F.coalesce("sentence_length", F.lit(0.0)) > 25), "metadata"),
    ]
    fix = lambda sev, code, area: F.struct(
        F.when(sev == "critical", 0).when(sev == "warning", 1).when(sev == "info", 2).otherwise(3).alias("rank"),
        sev.alias("severity"), F.lit(code).alias("fix"), (_hint(F.col("platform"), area) if area else F.lit("")).alias("where"))
    # ties of severity keep the order of the checks
    each = F.filter(F.array(*(F.when(c, F.struct(fix(s, k, a)["rank"].alias("rank"), F.lit(i).alias("i"), fix(s, k, a).alias("f"))) for i, (k, s, c, a) in enumerate(checks))), lambda x: x.isNotNull())
    none = F.array(F.struct(F.lit(3).alias("rank"), F.lit(0).alias("i"), fix(F.lit("pass"), "none", None).alias("f")))
    d = m.select("site", F.sort_array(F.when(F.size(each) > 0, each).otherwise(none)).alias("x"))
    return d.select("site", F.posexplode("x").alias("place", "x")).select("site", F.col("place").cast("long").alias("place"), "x.f.severity", "x.f.fix", "x.f.where")


def raw_html_notice(sites: DataFrame) -> DataFrame:
    """site and whether its head may be written by scripts, so that facts of raw HTML need a caveat."""
    p = F.coalesce("platform", F.lit(""))
    return sites.select("site", (p.isin("Next.js", "Nuxt") | F.coalesce("runtime", F.lit("")).contains("JavaScript")).alias("caveat"))


def masked_keys(keys: DataFrame) -> DataFrame:
    """site and its key with all but four characters at either end left out; short keys are hidden."""
    k = F.col("key")
    return keys.select("site", F.when(F.length(k) > 8, F.concat(F.left(k, F.lit(4)), F.lit("..."), F.right(k, F.lit(4)))).otherwise("***").alias("key"))


def sitemap_candidates(robots: DataFrame) -> DataFrame:
    """host and url of sitemaps to try: those of robots.txt where it was found, and the well-known paths."""
    named = robots.where(F.col("status") == 200).select("host", F.explode(F.regexp_extract_all("body", F.lit(r"(?im)^[ \t]*sitemap:[ \t]*([^\r\n]*)"), F.lit(1))).alias("url"))
    guesses = robots.select("host", F.explode(F.array(*map(F.lit, dims.SITEMAP_PATHS))).alias("path")).select("host", F.concat(F.lit("https://"), "host", "path").alias("url"))
    return named.select("host", F.trim("url").alias("url")).where("url <> ''").unionByName(guesses).distinct()


def sitemap_languages(sitemaps: DataFrame) -> DataFrame:
    """host, the language codes of alternates in its sitemap (sorted), and whether it declares their name space."""
    codes = F.array_sort(F.array_distinct(F.regexp_extract_all("xml", F.lit('hreflang="([^"]+)"'), F.lit(1))))
    return sitemaps.select("host", "url", F.array_join(codes, ",").alias("languages"), F.col("xml").contains("xmlns:xhtml").alias("declared"))


def soft_404_by_wide_title(responses: DataFrame) -> DataFrame:
    """url of answers with status 200 whose title has one of the signals of link checks."""
    t = F.lower(F.coalesce("title", F.lit("")))
    return responses.where((F.col("status") == 200) & reduce(lambda a, b: a | b, (t.contains(s) for s in dims.SOFT_404_OF_LINKS))).select("url")


def domain_index(ratings: DataFrame) -> DataFrame:
    """domain, raw and capped score, band: dimension scores by the weights of the domain's kind; a failed veto item caps at 39."""
    w = lambda dim: F.create_map(*(F.lit(x) for k, v in dims.DOMAIN_WEIGHTS.items() for x in (k, v[dim])))[F.col("kind")]
    parts = [(F.col(c), F.when(F.col(c).isNotNull(), w(i))) for i, c in enumerate(("citation", "identity", "trust", "eminence"))]
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    total, weight = (reduce(lambda a, b: a + b, x) for x in ([zero(v * k) for v, k in parts], [zero(k) for _, k in parts]))
    r = ratings.select("domain", F.round(F.when(weight > 0, total / weight), 2).alias("raw"), "vetoed")
    r = r.select("domain", "raw", F.when(F.col("vetoed"), F.least("raw", F.lit(39.0))).otherwise(F.col("raw")).alias("score"))
    return r.withColumn("band", _band(F.col("score"), (90, "excellent"), (75, "good"), (60, "medium"), (40, "low"), (0, "poor")))


def _band(x: Column, *limits: tuple) -> Column:
    return reduce(lambda c, b: c.when(x >= b[0], b[1]), limits[1:], F.when(x >= limits[0][0], limits[0][1]))


def item_priorities(grades: DataFrame, weights: dict[str, float], k: int = 5) -> DataFrame:
    """The ``k`` items of each page that would gain most (points lost by weight of the dimension): page, item, gain, place."""
    lost = F.when(F.col("grade") == "F", 10).when(F.col("grade") == "A", 5).otherwise(0)
    w = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("dim")]
    g = grades.select("page", "item", F.round(lost * w, 4).alias("gain")).where("gain > 0")
    best = g.groupBy("page").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("gain")).alias("g"), "item"))), 1, k).alias("x"))
    return best.select("page", F.posexplode("x").alias("place", "x")).select("page", "x.item", (-F.col("x.g")).alias("gain"), (F.col("place") + 1).cast("long").alias("place"))


def recognition(answers: DataFrame) -> DataFrame:
    """entity, sum of the 0 to 3 points of questions asked of systems, and its band of 48."""
    g = answers.groupBy("entity").agg(F.sum(F.least(F.lit(3), F.greatest(F.lit(0), "points"))).cast("long").alias("points"))
    return g.withColumn("band", _band(F.col("points"), (36, "strong"), (24, "moderate"), (12, "weak"), (0, "none")))


def review_bands(sites: DataFrame) -> DataFrame:
    """site and the band of its stars, number, recency and answers of reviews: good, fair or poor."""
    up = lambda c, good, poor: F.when(F.col(c) >= good, "good").when(F.col(c) < poor, "poor").otherwise("fair")
    age = F.when(F.col("days_since") <= 30, "good").when(F.col("days_since") > 90, "poor").otherwise("fair")
    answered = F.when(F.col("answered") > 0.8, "good").when(F.col("answered") < 0.5, "poor").otherwise("fair")
    return sites.select("site", up("stars", 4.3, 4.0).alias("stars"), up("reviews", 50, 20).alias("number"), age.alias("recency"), answered.alias("answers"))


def business_kinds(pages: DataFrame) -> DataFrame:
    """site, kind of business by most pages with one of its signs, and these pages; ties by the order of kinds. One shuffle by site."""
    text = F.lower(F.concat_ws(" ", "url", "html"))
    p = pages.select(U.host(F.col("url")).alias("site"), text.alias("t"))
    g = p.groupBy("site").agg(*(F.count_if(F.col("t").rlike(sign)).alias(kind) for kind, sign in dims.BUSINESS_SIGNS))
    best = F.array_max(F.array(*(F.struct(F.col(k).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, _) in enumerate(dims.BUSINESS_SIGNS))))
    g = g.select("site", best.alias("b"))
    return g.select("site", F.when(F.col("b.n") > 0, F.col("b.k")).otherwise("unknown").alias("kind"), F.col("b.n").alias("pages"))


def content_pages(pages: DataFrame) -> DataFrame:
    """Thin pages but for those that only serve a task (sign in, cart and such): page_id, words."""
    thin = P.thin_content(pages).select("page_id", "words")
    task = pages.where(F.lower("url").rlike(dims.TASK_PATHS)).select("page_id")
    return thin.join(task, "page_id", "left_anti")


def passage_blocks(docs: DataFrame, low: int = 100, high: int = 200) -> DataFrame:
    """Blocks (lines) of ``low`` to ``high`` words that don't open with a pronoun: doc_id, pos, words, and whether the line before asks."""
    d = docs.select("doc_id", F.split("text", "\n").alias("p"))
    e = d.select("doc_id", F.posexplode(F.zip_with("p", F.concat(F.array(F.lit("")), "p"), lambda a, b: F.struct(a.alias("p"), b.alias("before")))).alias("pos", "x"))
    b = e.select("doc_id", F.col("pos").cast("long").alias("pos"), "x.p", "x.before").where(F.col("p").isNotNull()).withColumn("words", F.size(T.words(F.col("p"))).cast("long"))
    fits = F.col("words").between(low, high) & ~F.lower("p").rlike(r"^[ \t]*(it|this|that|these|those|they)\b")
    return b.where(fits).select("doc_id", "pos", "words", H.squeeze(F.col("before")).endswith("?").alias("asked"))


def link_health(sites: DataFrame) -> DataFrame:
    """site, score of continuous factors and rating: domains against the third quartile of the site's kind, quality, toxicity, anchors, places, velocity, follow."""
    p = lambda i: F.create_map(*(F.lit(x) for k, v in dims.DOMAIN_QUARTILES.items() for x in (k, float(v[i]))))[F.col("kind")]
    d = F.col("domains").cast("double")
    per_domain = lambda c: F.coalesce(F.try_divide(F.col(c) * F.lit(100.0), d), F.lit(0.0))
    follow = F.col("follow_share") * 100
    off = F.greatest(F.lit(0.0), 70 - follow, follow - 85)
    factors = {
        "domains": d * 100 / p(2), "quality": per_domain("strong_domains"), "toxic": 100 - F.col("toxic_share") * 100 * 100 / 15, "anchors": F.col("anchor_score"),
        "places": F.col("target_share") * 100, "velocity": (F.lit(1.5) - F.col("variation")) / F.lit(1.2) * 100, "follow": 100 - 10 * off / 5,
    }
    score = reduce(lambda a, b: a + b, (_clamp(v) * F.lit(dims.LINK_HEALTH_WEIGHTS[k]) for k, v in factors.items()))
    s = sites.select("site", F.round(score, 1).alias("score"))
    return s.withColumn("rating", _band(F.col("score"), (80, "healthy"), (60, "moderate"), (40, "at_risk"), (0, "critical")))
