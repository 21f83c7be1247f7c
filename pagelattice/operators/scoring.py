"""Scores and rule tables: section scores of an audit, weighted indexes, gates, bands and priorities.

Every operator is a projection of given metrics (one row in, one row out), or such a projection of an explode of
few literals; no operator shuffles but the roll-ups that say so. A metric that is null was not measured.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..plans import dims


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), x)).cast("double")


def section_scores(metrics: DataFrame) -> DataFrame:
    """(site, section, score) of the sections that are scored from counts; null where a section doesn't apply.

    A section whose key metric is null was not audited: 0, but null for hreflang, templates and page speed.
    """
    ease = _zero("reading_ease")
    links = F.lit(70) + F.when(F.col("links_per_page") >= 5, 15).when(F.col("links_per_page") >= 3, 5).otherwise(-15)
    links = links - F.least(F.lit(30), 5 * _zero("orphans")) - F.least(F.lit(20), 3 * _zero("dead_ends"))
    sections = {
        "internal_links": _clamp(100 - 10 * _zero("link_issues") - 15 * _zero("broken_pages") - 10 * _zero("soft_404_pages") - 5 * _zero("redirected_pages")),
        "redirects": _clamp(100 - 25 * _zero("redirect_issues")),
        "llms_txt": _zero("llms_score").cast("double"),
        "pagespeed": F.col("speed_score").cast("double"),
        "readability": F.when(ease >= 60, 100.0).when(ease >= 30, 50 + F.floor((ease - 30) * 5 / 3)).otherwise(F.greatest(F.lit(0), F.floor(ease * 5 / 3))).cast("double"),
        "link_profile": F.when(F.col("links_per_page").isNotNull(), _clamp(links)).otherwise(0.0),
        "hreflang": F.when(F.col("hreflang_tags") > 0, _clamp(100 - 30 * _zero("hreflang_critical") - 15 * _zero("hreflang_high") - 5 * _zero("hreflang_medium"))),
        "duplicate_content": F.when(F.col("near_pairs").isNotNull(), _clamp(100 - 20 * _zero("near_pairs") - 10 * _zero("thin_pages"))).otherwise(0.0),
        "programmatic_seo": F.when(F.col("template_groups") > 0, _clamp(100 - 25 * _zero("template_critical") - 8 * _zero("template_warnings"))),
        "canonical": F.coalesce(F.floor("canonical_score").cast("double"), F.lit(50.0)),
        "local_signals": F.when(F.col("local_business"), F.floor(_zero("local_score")).cast("double")),
    }
    each = F.array(*(F.struct(F.lit(k).alias("section"), v.alias("score")) for k, v in sections.items()))
    return metrics.select("site", F.explode(each).alias("s")).select("site", "s.section", "s.score")


def sitemap_scores(s: DataFrame) -> DataFrame:
    """host and score: 30, more for robots and sitemap answers and URLs, a tier by the share of healthy URLs, less for template and search URLs."""
    share = F.col("healthy") / F.col("checked")
    tier = F.when(F.coalesce("checked", F.lit(0)) <= 0, 0).when(share >= 0.95, 25).when(share >= 0.8, 15).when(share >= 0.6, 5).otherwise(-10)
    add = lambda c, n: F.when(c, n).otherwise(0)
    score = F.lit(30) + add((F.col("robots_status") == 200) & (F.col("sitemaps") > 0), 20) + add(F.col("sitemap_status") == 200, 15) + add(F.col("urls") > 0, 10) + tier
    return s.select("host", _clamp(score - F.least(F.lit(20), 10 * _zero("pattern_urls"))).cast("long").alias("score"))


def header_alternates(responses: DataFrame) -> DataFrame:
    """Language alternates of HTTP Link headers: url, lang (lower case), raw_lang, href."""
    parts = responses.select("url", F.explode(F.split("link", ",")).alias("p"))
    got = lambda p: F.regexp_extract("p", p, 1)
    fits = (got("<([^>]+)>") != "") & (got('hreflang="([^"]+)"') != "") & got('rel="([^"]+)"').contains("alternate")
    return parts.where(fits).select("url", F.lower(got('hreflang="([^"]+)"')).alias("lang"), got('hreflang="([^"]+)"').alias("raw_lang"), got("<([^>]+)>").alias("href"))


def weighted_index(parts: DataFrame, weights: dict[str, float]) -> DataFrame:
    """By subject: the sum of part scores by weight, weights of parts without a score shared among the others. One shuffle by subject."""
    w = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("part")]
    p = parts.withColumn("w", F.when(F.col("score").isNotNull(), w))
    g = p.groupBy("subject").agg(F.count("w").alias("parts"), F.sum("w").alias("weight"), F.sum(F.col("score") * F.col("w")).alias("x"))
    return g.select("subject", "parts", F.round(F.col("x") / F.col("weight"), 2).alias("score"))


def site_health(signals: DataFrame) -> DataFrame:
    """Of each site the share of positive signals by category weight, less 15 a critical and 5 a warning finding. One shuffle by site."""
    w = F.create_map(*(F.lit(x) for kv in dims.CATEGORY_WEIGHTS.items() for x in kv))[F.col("category")]
    base = F.try_divide(F.lit(100.0) * F.col("positive"), F.col("positive") + F.col("deficit"))
    s = signals.withColumn("base", base).withColumn("w", F.when(F.col("base").isNotNull(), w))
    g = s.groupBy("site").agg(F.sum(F.col("base") * F.col("w")).alias("x"), F.sum("w").alias("weight"), F.sum("critical").alias("critical"), F.sum("warnings").alias("warnings"))
    return g.select("site", F.round(F.greatest(F.lit(0.0), F.col("x") / F.col("weight") - 15 * F.col("critical") - 5 * F.col("warnings")), 2).alias("score"))


def word_floors(pages: DataFrame) -> DataFrame:
    """Pages whose words are below the floor of their type: page, kind, words, floor, missing."""
    floor = F.create_map(*(F.lit(x) for kv in dims.WORD_FLOORS.items() for x in kv))[F.col("kind")]
    return pages.withColumn("floor", floor).where(F.col("words") < F.col("floor")).select("page", "kind", "words", "floor", (F.col("floor") - F.col("words")).alias("missing"))


def freshness(pages: DataFrame) -> DataFrame:
    """page, kind, age_days and whether it is fresh, due (between the limits of its kind) or stale."""
    limit = lambda i: F.create_map(*(F.lit(x) for k, v in dims.FRESHNESS_DAYS.items() for x in (k, v[i])))[F.col("kind")]
    state = F.when(limit(0).isNull(), "unknown").when(F.col("age_days") > limit(1), "stale").when(F.col("age_days") > limit(0), "due").otherwise("fresh")
    return pages.select("page", "kind", "age_days", state.alias("state"))


def content_actions(pages: DataFrame) -> DataFrame:
    """page and its bucket: consolidate (a topic of several pages), prune, refresh or keep. One shuffle by topic."""
    topics = pages.groupBy("topic").agg(F.count("*").alias("sharing"))
    p = pages.join(topics, "topic")
    prune = (F.col("impressions_year") < 10) & (F.col("backlinks") == 0) & F.col("outdated")
    refresh = (F.col("impressions_before") > 0) & (F.col("clicks") < F.col("clicks_before")) & ~F.col("outdated")
    return p.select("page", F.when(F.col("sharing") > 1, "consolidate").when(prune, "prune").when(refresh, "refresh").otherwise("keep").alias("bucket"))


def traffic_diagnosis(pages: DataFrame, percent: int = 10) -> DataFrame:
    """page and why its traffic fell: ranking (impressions fell), result_page (impressions stable, clicks fell), none."""
    fell = lambda now, before: F.lit(100) * (F.col(before) - F.col(now)) > F.lit(percent) * F.col(before)
    return pages.select("page", F.when(fell("impressions", "impressions_before"), "ranking").when(fell("clicks", "clicks_before"), "result_page").otherwise("none").alias("cause"))


def return_on_search(t: DataFrame) -> DataFrame:
    """channel, revenue (sessions by rate by order value, or conversions by lead value) and return in percent of the investment."""
    revenue = F.coalesce(F.col("sessions") * F.col("rate") * F.col("order_value"), F.col("conversions") * F.col("lead_value"))
    return t.select("channel", F.round(revenue, 2).alias("revenue"), F.round(F.when(F.col("investment") > 0, (revenue - F.col("investment")) / F.col("investment") * 100), 2).alias("roi_percent"))


def indexation(sites: DataFrame) -> DataFrame:
    """site, ratio of indexed to submitted URLs, and its band."""
    ratio = F.when(F.col("submitted") > 0, F.col("indexed") / F.col("submitted"))
    return sites.select("site", F.round(ratio, 4).alias("ratio"), F.when(ratio.isNull(), "unknown").when(ratio > 0.9, "healthy").when(ratio >= 0.7, "acceptable").when(ratio >= 0.5, "problem").otherwise("significant").alias("band"))


def missing_url_fixes(urls: DataFrame) -> DataFrame:
    """url, category of a URL that answers 404, and the priority of its fix."""
    u = F.lower("url")
    search, facet = u.rlike(r"\{[^}]*\}|/search([/?]|$)|[?&](q|s|query|search)="), u.contains("?")
    kind = F.when(search, "search").when(facet, "facet").when(F.col("wanted"), "restore").when(F.col("moved"), "moved").when(F.col("external_only"), "typo").otherwise("deleted")
    return urls.select("url", kind.alias("category")).withColumn("priority", F.when(F.col("category").isin("search", "restore", "moved"), "critical").when(F.col("category").isin("facet", "deleted"), "high").otherwise("medium"))


def crawl_waste(pages: DataFrame) -> DataFrame:
    """Number of URLs of each class of crawl waste; a URL counts in the first class that fits. One shuffle by class."""
    u = F.lower("url")
    kind = reduce(lambda c, r: c.when(u.rlike(r[1]), r[0]), dims.CRAWL_WASTE[1:], F.when(u.rlike(dims.CRAWL_WASTE[0][1]), dims.CRAWL_WASTE[0][0])).otherwise("none")
    return pages.groupBy(kind.alias("class")).agg(F.count("*").alias("urls"))


def gap_scores(domains: DataFrame) -> DataFrame:
    """domain, opportunity (signals of 0 to 100 by weight) and tier."""
    score = reduce(lambda a, b: a + b, (F.col(k) * F.lit(w) for k, w in dims.GAP_WEIGHTS.items()))
    return domains.select("domain", F.round(score, 2).alias("opportunity")).withColumn("tier", F.when(F.col("opportunity") >= 70, "tier1").when(F.col("opportunity") >= 40, "tier2").otherwise("tier3"))


def redirect_tiers(urls: DataFrame) -> DataFrame:
    """old_url and how much its redirect matters."""
    tier = F.when((F.col("visits") > 100) | (F.col("backlinks") > 5), "P1").when((F.col("visits") > 0) | (F.col("backlinks") > 0), "P2").otherwise("P3")
    return urls.select("old_url", tier.alias("tier"))


def image_weights(images: DataFrame) -> DataFrame:
    """src, kind, kilobytes and the band of its size: target, acceptable, warning, oversized, stop."""
    limit = lambda i: F.create_map(*(F.lit(x) for k, v in dims.IMAGE_KILOBYTES.items() for x in (k, v[i])))[F.col("kind")]
    kb = F.col("kilobytes")
    band = F.when(limit(0).isNull(), "unknown").when(kb < limit(0), "target").when(kb <= limit(1), "acceptable").when(kb <= limit(2), "warning").otherwise("stop")
    return images.select("src", "kind", "kilobytes", band.alias("band"))


def image_index(site: DataFrame) -> DataFrame:
    """site and the score of its images: shares of images without a fault by the points of each dimension."""
    part = lambda bad, n: F.lit(float(n)) * (F.col("images") - F.col(bad)) / F.col("images")
    score = reduce(lambda a, b: a + b, (part(k, n) for k, n in dims.IMAGE_POINTS.items()))
    return site.select("site", F.round(F.when(F.col("images") > 0, score), 2).alias("score"))


def programmatic_gates(plans: DataFrame) -> DataFrame:
    """plan and the gate of generated pages: stop, warning, thin or pass."""
    gate = F.when((F.col("pages") > 500) | (F.col("unique_share") < 0.3), "stop").when(F.col("unique_share") < 0.4, "thin").when((F.col("pages") > 100) | ~F.col("reviewed"), "warning").otherwise("pass")
    return plans.select("plan", gate.alias("gate"))


def location_gates(sites: DataFrame) -> DataFrame:
    """site, number of location pages and their gate."""
    n = F.col("location_pages")
    return sites.select("site", "location_pages", F.when(n >= 50, "stop").when(n > 30, "warning").otherwise("pass").alias("gate"))


def roadmap(tasks: DataFrame) -> DataFrame:
    """task, priority (business by ranking impact over effort) and the phase of its week."""
    phase = F.when(F.col("week") <= 4, "foundation").when(F.col("week") <= 12, "expansion").when(F.col("week") <= 24, "scale").otherwise("authority")
    return tasks.select("task", F.round(F.col("impact") * F.col("ranking") / F.greatest("effort", F.lit(1)), 2).alias("priority"), phase.alias("phase"))


def audit_confidence(audits: DataFrame) -> DataFrame:
    """site and the confidence of an audit by pages fetched and access to analytics."""
    n = F.col("pages_fetched")
    return audits.select("site", F.when((n >= 8) & F.col("analytics"), "high").when(n >= 4, "medium").when(n >= 1, "low").otherwise("none").alias("confidence"))


def answer_shapes(blocks: DataFrame) -> DataFrame:
    """block and whether it has the shape of a featured answer: a paragraph of 40 to 60 words, a list of 5 to 9 short items, a table of at most 4 columns."""
    fits = F.when(F.col("shape") == "paragraph", F.col("words").between(40, 60)).when(F.col("shape") == "list", F.col("items").between(5, 9) & (F.col("longest_item") < 15)).when(F.col("shape") == "table", F.col("columns") <= 4)
    return blocks.select("block", "shape", F.coalesce(fits, F.lit(False)).alias("fits"))


def sitemap_sample(pages: DataFrame, k: int = 20) -> DataFrame:
    """``k`` URLs that stand for all, the same in every run: those that come first by digest. A top-k, not a sort of all."""
    return pages.select("url").distinct().orderBy(F.md5("url"), "url").limit(k)


def ungrouped(pages: DataFrame, groups: DataFrame) -> DataFrame:
    """Pages whose URL pattern is none of ``groups`` (pattern): page_id, pattern."""
    p = pages.select("page_id", F.concat(U.host(F.col("url")), U.template(F.col("url"))).alias("pattern"))
    return p.join(groups.select("pattern"), "pattern", "left_anti").select("page_id", "pattern")


def modal_target(links: DataFrame) -> DataFrame:
    """The target that most links have; of equals the first by code point."""
    return links.groupBy("target_url").agg(F.count("*").alias("links")).orderBy(F.col("links").desc(), "target_url").limit(1)


def canonical_summary(pages: DataFrame) -> DataFrame:
    """Counts over a site's pages (url, canonicals, header_canonical, robots): one row."""
    c = F.coalesce(F.get(F.split("canonicals", r"\|"), F.lit(0)), F.col("header_canonical"))
    n = F.size(F.split("canonicals", r"\|"))
    bare = lambda x: F.regexp_replace(x, r"^(https?://)www\.", "$1")
    p = pages.select("url", c.alias("c"), F.when(F.col("canonicals").isNull(), 0).otherwise(n).alias("n"), F.coalesce("robots", F.lit("")).alias("robots"))
    own = U.normal_b(F.col("c")) == U.normal_b(F.col("url"))
    return p.agg(
        F.count("*").alias("pages"), F.count_if(F.col("c").isNull()).alias("missing"), F.count_if(F.col("n") > 1).alias("multiple"),
        F.count_if(F.col("c").isNotNull() & F.col("robots").contains("noindex")).alias("noindex_conflict"),
        F.count_if((U.host(F.col("c")) != U.host(F.col("url"))) & (U.host(bare(F.col("c"))) == U.host(bare(F.col("url"))))).alias("www_mismatch"),
        F.count_if(own).alias("own"), F.count_if(~own).alias("alternate"),
    )


def soft_404_by_title_and_body(responses: DataFrame) -> DataFrame:
    """url of answers with status 200 that say in title and body that nothing is there."""
    says = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).rlike("|".join(dims.SOFT_404))
    return responses.where((F.col("status") == 200) & says("title") & says("body")).select("url")


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraphs (parted by blank lines) and how many of them have more than 8 words."""
    p = docs.select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), r"\n[ \t\r\f]*\n"), lambda x: F.trim(F.translate(x, "\n\t\r\f", "    ")) != "").alias("p"))
    words = lambda x: F.regexp_count(x, F.lit(r"[^ \t\n\r\f]+"))
    return p.select("doc_id", F.size("p").cast("long").alias("paragraphs"), F.size(F.filter("p", lambda x: words(x) > 8)).cast("long").alias("long_ones"))
