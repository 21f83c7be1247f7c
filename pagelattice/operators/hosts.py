"""Files and responses of a host: robots.txt, sitemaps, llms.txt, security headers, redirects, canonicals, hreflang, vitals, entities, index pings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import urls as U
from ..plans import dims
from .pages import rules


def robots_rules(robots: DataFrame) -> DataFrame:
    """(host, line_no, agent, directive, value) of robots.txt bodies with status 200; the agent is carried forward by a window."""
    r = robots.where("status = 200").select("host", F.posexplode(F.split("body", "\r?\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    r = r.where((F.col("line") != "") & ~F.col("line").startswith("#") & F.col("line").contains(":"))
    r = r.select("host", "line_no", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("directive"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value"))
    agent = F.last(F.when(F.col("directive") == "user-agent", F.col("value")), True).over(W.partitionBy("host").orderBy("line_no"))
    return r.select("host", F.col("line_no").cast("long").alias("line_no"), agent.alias("agent"), "directive", "value")


def ai_crawler_status(robots: DataFrame) -> DataFrame:
    """(host, crawler, status) for all crawlers of the dimension, with the rules of * where a crawler isn't named."""
    rules_ = robots_rules(robots).where("agent is not null")
    g = rules_.groupBy("host", "agent").agg(F.count_if((F.col("directive") == "disallow") & (F.col("value") != "")).alias("dis"), F.count_if((F.col("directive") == "disallow") & (F.col("value") == "/")).alias("all"), F.count_if(F.col("directive") == "allow").alias("alw"))
    hosts = robots.where("status in (200, 404)").select("host", "status", F.explode(F.array(*map(F.lit, dims.AI_CRAWLERS))).alias("crawler"))
    own = g.select("host", F.col("agent").alias("crawler"), "dis", "all", "alw", F.lit(True).alias("named"))
    star = g.where("agent = '*'").select("host", F.col("all").alias("star_all"), F.lit(True).alias("star"))
    j = hosts.join(own, ["host", "crawler"], "left").join(star, "host", "left")
    status = (
        F.when(F.col("status") == 404, "no_robots").when(F.col("named") & (F.col("all") > 0), "blocked").when(F.col("named") & (F.col("dis") > 0), "partly_blocked").when(F.col("named") & (F.col("alw") > 0), "allowed").when(F.col("named"), "no_rules")
        .when(F.col("star") & (F.col("star_all") > 0), "blocked_by_star").when(F.col("star"), "inherits_star").otherwise("unmanaged")
    )
    return j.select("host", "crawler", status.alias("crawler_status"))


def robots_scores(robots: DataFrame) -> DataFrame:
    """200: 60, 20 for a sitemap, 2 for each managed crawler up to 20; 404: 20; else 0."""
    managed = ai_crawler_status(robots).groupBy("host").agg(F.count_if(~F.col("crawler_status").isin("unmanaged", "inherits_star", "no_robots")).alias("managed"))
    maps = robots_rules(robots).where("directive = 'sitemap'").groupBy("host").agg(F.count("*").alias("sitemaps"))
    j = robots.select("host", "status").join(managed, "host", "left").join(maps, "host", "left").na.fill(0, ["managed", "sitemaps"])
    score = F.when(F.col("status") == 200, F.lit(60) + F.when(F.col("sitemaps") > 0, 20).otherwise(0) + F.least(F.lit(20), 2 * F.col("managed"))).when(F.col("status") == 404, 20).otherwise(0)
    return j.select("host", "sitemaps", "managed", score.cast("long").alias("score"))


def crawl_delays(robots: DataFrame) -> DataFrame:
    return robots_rules(robots).where("directive = 'crawl-delay'").select("host", "agent", F.expr("try_cast(value as double)").alias("seconds"))


def sitemap_locs(sitemaps: DataFrame) -> DataFrame:
    """(host, sitemap, loc, is_index)."""
    s = sitemaps.select("host", F.col("url").alias("sitemap"), F.col("body").rlike("(?i)<sitemapindex").alias("is_index"), F.explode(F.regexp_extract_all("body", F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("loc"))
    return s.select("host", "sitemap", "loc", "is_index")


def sitemap_pages(sitemaps: DataFrame) -> DataFrame:
    """Page URLs of all sitemaps that an index leads to, and of those without an index: distinct (host, loc)."""
    s = sitemap_locs(sitemaps)
    child = s.where("is_index").select("host", F.col("loc").alias("sitemap")).distinct()
    listed = s.where("not is_index").join(child, ["host", "sitemap"], "left_semi")
    alone = s.where("not is_index").join(s.where("is_index").select("host").distinct(), "host", "left_anti")
    return listed.unionByName(alone).select("host", "loc").distinct()


def sitemap_hygiene(sitemaps: DataFrame) -> DataFrame:
    return sitemap_pages(sitemaps).groupBy("host", U.hygiene(F.col("loc")).alias("class")).agg(F.count("*").alias("urls"))


def sitemap_gaps(sitemaps: DataFrame, crawled: DataFrame) -> DataFrame:
    """URLs (normal form A) of sitemap and crawl: in both, sitemap_only or crawl_only."""
    a = sitemap_pages(sitemaps).select(U.normal_a(F.col("loc")).alias("url")).distinct().withColumn("s", F.lit(True))
    b = crawled.select(U.normal_a(F.col("url")).alias("url")).distinct().withColumn("c", F.lit(True))
    j = a.join(b, "url", "full")
    return j.groupBy(F.when(F.col("s").isNull(), "crawl_only").when(F.col("c").isNull(), "sitemap_only").otherwise("both").alias("side")).agg(F.count("*").alias("urls"))


def url_health(status: DataFrame) -> DataFrame:
    """Class of every fetched URL."""
    c = F.when(F.col("error") == "timeout", "timeout").when(F.col("error").isNotNull(), "error").when(F.col("status").between(400, 499), "not_found").when(F.col("status") >= 500, "server_error").when(F.col("soft_404"), "soft_404").when(F.col("redirect_to").isNotNull(), "redirected").otherwise("healthy")
    return status.select("url", c.alias("class"))


def url_health_summary(status: DataFrame) -> DataFrame:
    return url_health(status).groupBy("class").agg(F.count("*").alias("urls"))


def broken_link_score(status: DataFrame) -> DataFrame:
    """checked, broken, soft_404, and 100 less three times the share of both, at least 0."""
    g = url_health(status).agg(F.count("*").alias("checked"), F.count_if(F.col("class").isin("not_found", "server_error", "timeout", "error")).alias("broken"), F.count_if(F.col("class") == "soft_404").alias("soft"))
    return g.withColumn("score", F.greatest(F.lit(0), F.lit(100) - F.floor((F.col("broken") + F.col("soft")) * 300 / F.greatest("checked", F.lit(1)))).cast("long"))


SOFT_404 = ("page not found", "404", "not found", "no longer available", "does not exist", "page doesn't exist", "page has been removed")


def soft_404(titles: DataFrame) -> DataFrame:
    """Pages (page_id, title) whose title says that nothing is there."""
    t = F.lower(F.coalesce("title", F.lit("")))
    return titles.where(reduce(lambda a, b: a | b, (t.contains(s) for s in SOFT_404))).select("page_id", "title")


def llms_items(llms: DataFrame) -> DataFrame:
    """Links of llms.txt bodies with their section, carried forward by a window: host, line_no, section, title, url, description."""
    l_ = llms.select("host", F.posexplode(F.split(F.trim("body"), "\r?\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    section = F.last(F.when(F.col("line").startswith("## "), F.trim(F.substring("line", F.lit(4), F.length("line")))), True).over(W.partitionBy("host").orderBy("line_no"))
    l_ = l_.withColumn("section", section)
    pat = r"^-\s*\[([^\]]+)\]\(([^)]+)\)(?::\s*(.*))?"
    hit = l_.where(F.col("line").startswith("- [") & F.col("line").rlike(pat))
    return hit.select("host", F.col("line_no").cast("long").alias("line_no"), "section", *(F.regexp_extract("line", pat, i).alias(n) for i, n in ((1, "title"), (2, "url"), (3, "description"))))


def llms_scores(llms: DataFrame) -> DataFrame:
    """host, sections, links, description_length and the score of an llms.txt."""
    lines = F.transform(F.split(F.trim("body"), "\r?\n"), lambda x: F.trim(x))
    later = F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))
    desc = F.array_join(F.transform(F.filter(later, lambda x: x.startswith("> ")), lambda x: F.trim(F.substring(x, F.lit(3), F.length(x)))), " ")
    d = llms.select("host", F.get(lines, 0).startswith("# ").alias("title"), F.length(desc).alias("description_length"), F.size(F.filter(later, lambda x: x.startswith("## "))).alias("sections"), F.size(F.filter(later, lambda x: x.rlike(r"^- ?\[[^\]]+\]\([^)]+\)"))).alias("links"), F.length("body").alias("n"))
    add = lambda c, n: F.when(c, n).otherwise(0)
    score = (
        add(F.col("title"), 20) + add(F.col("description_length") > 0, 20) + add(F.col("description_length") > 50, 5) + add(F.col("sections") > 0, 15) + add(F.col("sections") >= 3, 5) + add(F.col("links") > 0, 20) + add(F.col("links") >= 5, 5)
        + add(F.col("links") >= 10, 5) + add(F.col("n") > 200, 5)
    )
    return d.select("host", F.col("sections").cast("long").alias("sections"), F.col("links").cast("long").alias("links"), F.col("description_length").cast("long").alias("description_length"), F.least(F.lit(100), score).cast("long").alias("score"))


def security_scores(resp: DataFrame) -> DataFrame:
    """url, present, missing and the score: 25 for HTTPS and the weights of the headers that are there; hsts_weak: under a year or without subdomains."""
    present = reduce(lambda a, b: a + b, (F.when(F.col(h).isNotNull(), 1).otherwise(0) for h in dims.SECURITY_HEADERS))
    weight = reduce(lambda a, b: a + b, (F.when(F.col(h).isNotNull(), w).otherwise(0) for h, w in dims.SECURITY_HEADERS.items()))
    age = F.expr("try_cast(nullif(regexp_extract(lower(hsts), 'max-age=([0-9]+)', 1), '') as bigint)")
    weak = F.col("hsts").isNotNull() & (F.coalesce(age < 31536000, F.lit(False)) | ~F.lower("hsts").contains("includesubdomains"))
    return resp.select("url", present.cast("long").alias("present"), (F.lit(len(dims.SECURITY_HEADERS)) - present).cast("long").alias("missing"), F.coalesce(weak, F.lit(False)).alias("hsts_weak"), F.least(F.lit(100), F.when(F.col("https"), 25).otherwise(0) + weight).cast("long").alias("score"))


def redirect_findings(resp: DataFrame) -> DataFrame:
    return rules(resp, ["url"], [("long_chain", "warning", F.col("hops") > 2), ("chain", "info", F.col("hops") == 2), ("mixed_protocol", "warning", F.col("mixed")), ("temporary", "info", F.col("temporary")), ("client_error", "critical", F.col("status").between(400, 499)), ("server_error", "critical", F.col("status") >= 500)])


def redirect_map_check(m: DataFrame) -> DataFrame:
    """Expected against actual final URLs, but for a trailing slash."""
    same = F.coalesce(F.regexp_replace("expected", "/+$", "") == F.regexp_replace("actual", "/+$", ""), F.lit(False))
    return m.select("old_url", F.when((F.col("status") >= 400) | F.col("actual").isNull(), "broken").when(~same, "wrong_target").when(F.col("status") != 301, "not_permanent").otherwise("ok").alias("verdict"))


def canonical_audit(pages: DataFrame, resp: DataFrame) -> DataFrame:
    """Findings on canonicals from (page_id, url, canonicals joined by |, header_canonical, robots): page_id, code, severity.

    Chains and dead targets come from joins with the pages' own canonicals and with responses.
    """
    c = F.split("canonicals", r"\|")
    p = pages.select("page_id", "url", "robots", "header_canonical", F.coalesce(F.size(F.when(F.col("canonicals").isNotNull(), c)), F.lit(0)).alias("n"), F.coalesce(F.when(F.col("canonicals").isNotNull(), F.get(c, 0)), F.col("header_canonical")).alias("raw"))
    p = p.withColumn("abs", U.resolve(F.col("url"), F.col("raw"))).withColumn("norm", U.normal_a(F.col("abs"))).withColumn("self", F.col("norm") == U.normal_a(F.col("url")))
    target = p.select(U.normal_a(F.col("url")).alias("norm"), F.col("norm").alias("next"))
    target = target.groupBy("norm").agg(F.min("next").alias("next"))
    status = resp.select(U.normal_a(F.col("url")).alias("norm"), F.col("status").alias("target_status")).groupBy("norm").agg(F.min("target_status").alias("target_status"))
    j = p.join(target, "norm", "left").join(status, "norm", "left")
    slash = lambda u: U.path(u).endswith("/") & (F.length(U.path(u)) > 1)
    noindex = F.coalesce(F.lower("robots").contains("noindex"), F.lit(False))
    has = F.col("raw").isNotNull()
    return rules(j, ["page_id"], [
        ("several", "critical", F.col("n") > 1), ("missing", "high", ~has), ("header_only", "info", (F.col("n") == 0) & has), ("relative", "high", has & ~F.col("raw").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://")),
        ("http_on_https", "high", (U.scheme(F.col("abs")) == "http") & (U.scheme(F.col("url")) == "https")), ("www_mismatch", "high", U.host(F.col("abs")).startswith("www.") != U.host(F.col("url")).startswith("www.")), ("not_self", "info", ~F.col("self")),
        ("slash_mismatch", "warning", F.col("self") & (slash(F.col("abs")) != slash(F.col("url")))), ("noindex_conflict", "critical", noindex & ~F.col("self")), ("header_conflict", "critical", has & (U.normal_a(F.col("header_canonical")) != F.col("norm"))),
        ("target_error", "critical", F.col("target_status") >= 400), ("chain", "critical", ~F.col("self") & F.col("next").isNotNull() & (F.col("next") != F.col("norm"))),
    ])


def canonical_scores(pages: DataFrame, resp: DataFrame) -> DataFrame:
    a = canonical_audit(pages, resp).groupBy("page_id").agg(F.sum(F.when(F.col("severity") == "critical", 30).when(F.col("severity") == "high", 20).when(F.col("severity") == "warning", 10).otherwise(0)).alias("off"))
    return pages.select("page_id").join(a, "page_id", "left").select("page_id", F.greatest(F.lit(0), F.lit(100) - F.coalesce("off", F.lit(0))).cast("long").alias("score"))


def canonical_groups(pages: DataFrame) -> DataFrame:
    """Canonical targets that two or more pages name, one of them at least not itself."""
    c = pages.where("canonicals is not null").select(U.normal_a(F.col("url")).alias("own"), U.normal_a(U.resolve(F.col("url"), F.get(F.split("canonicals", r"\|"), 0))).alias("canonical"))
    return c.groupBy("canonical").agg(F.count("*").alias("pages"), F.count_if(F.col("own") != F.col("canonical")).alias("not_self")).where("pages > 1 and not_self > 0")


def hreflang_tags(tags: DataFrame) -> DataFrame:
    """Tags of the best source a page has (html, then header, then sitemap), with language and region."""
    rank = F.when(F.col("source") == "html", 0).when(F.col("source") == "header", 1).otherwise(2)
    t = tags.withColumn("r", rank).withColumn("best", F.min("r").over(W.partitionBy("page"))).where("r = best")
    parts = F.split("raw_lang", "-", 2)
    return t.select("page", "raw_lang", "url", F.lower(F.get(parts, 0)).alias("lang"), F.upper(F.get(parts, 1)).alias("region"))


def hreflang_codes(tags: DataFrame) -> DataFrame:
    """Findings on language and region codes: page, raw_lang, code, hint."""
    t = hreflang_tags(tags).where(F.lower("raw_lang") != "x-default")
    hint = F.create_map(*(F.lit(x) for kv in dims.LANGUAGE_MISTAKES.items() for x in kv))[F.col("lang")]
    fix = F.create_map(*(F.lit(x) for kv in dims.REGION_MISTAKES.items() if kv[1] for x in kv))[F.col("region")]
    three, unknown = F.length("lang") == 3, ~F.col("lang").isin(*dims.LANGUAGES)
    each = F.array(
        F.when(three, F.struct(F.lit("three_letters").alias("code"), hint.alias("hint"))), F.when(~three & unknown, F.struct(F.lit("unknown_language").alias("code"), hint.alias("hint"))),
        F.when((F.col("lang") == "zh") & F.col("region").isNull(), F.struct(F.lit("ambiguous_chinese").alias("code"), F.lit(None).cast("string").alias("hint"))),
        F.when(F.col("region").isin(*dims.REGION_MISTAKES), F.struct(F.lit("region_mistake").alias("code"), fix.alias("hint"))),
        F.when(F.col("region").isNotNull() & ~F.col("region").isin(*dims.REGION_MISTAKES, *dims.REGIONS, "HANS", "HANT"), F.struct(F.lit("unknown_region").alias("code"), F.lit(None).cast("string").alias("hint"))),
    )
    return t.select("page", "raw_lang", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("page", "raw_lang", "x.code", "x.hint")


def hreflang_return_tags(tags: DataFrame) -> DataFrame:
    """Whether an alternate names the page in return: page, url, passed (null where the alternate has no tags here)."""
    t = hreflang_tags(tags).select(F.regexp_replace("page", "/+$", "").alias("page"), F.regexp_replace("url", "/+$", "").alias("url"), "raw_lang")
    a = t.where((F.col("page") != F.col("url")) & (F.lower("raw_lang") != "x-default")).select("page", "url").distinct()
    back = t.select(F.col("page").alias("url"), F.col("url").alias("page"), F.lit(True).alias("back")).distinct()
    known = t.select(F.col("page").alias("url"), F.lit(True).alias("known")).distinct()
    return a.join(back, ["page", "url"], "left").join(known, "url", "left").select("page", "url", F.when(F.col("known"), F.coalesce("back", F.lit(False))).alias("passed"))


def hreflang_pages(tags: DataFrame) -> DataFrame:
    """By page: tags, self reference, x-default count, protocols, failed codes and returns, and the score."""
    t = hreflang_tags(tags)
    trim = lambda c: F.regexp_replace(c, "/+$", "")
    g = t.groupBy("page").agg(F.count("*").alias("tags"), F.max(trim("page") == trim("url")).alias("self_reference"), F.count_if(F.lower("raw_lang") == "x-default").alias("x_default"), F.countDistinct(U.scheme(F.col("url"))).alias("protocols"))
    codes = hreflang_codes(tags).groupBy("page").agg(F.count("*").alias("bad_codes"))
    ret = hreflang_return_tags(tags).groupBy("page").agg(F.count_if(~F.col("passed")).alias("missing_returns")).withColumnRenamed("page", "p")
    j = g.join(codes, "page", "left").join(ret, trim("page") == F.col("p"), "left").drop("p").na.fill(0, ["bad_codes", "missing_returns"])
    off = F.when(~F.col("self_reference"), 30).otherwise(0) + 30 * F.col("missing_returns") + F.when(F.col("x_default") != 1, 15).otherwise(0) + 15 * F.col("bad_codes") + F.when(F.col("protocols") > 1, 5).otherwise(0)
    return j.withColumn("score", F.greatest(F.lit(0), F.lit(100) - off).cast("long"))


def vitals_p75(v: DataFrame) -> DataFrame:
    """Rating of the 75th percentile of a metric by page: good, needs_improvement or poor."""
    p = v.groupBy("page", "metric").agg(F.round(F.expr("percentile(value, 0.75)"), 6).alias("p75"))
    lim = F.create_map(*(x for k, (g, b) in dims.VITALS.items() for x in (F.lit(k), F.struct(F.lit(g).alias("good"), F.lit(b).alias("poor")))))[F.col("metric")]
    return p.select("page", "metric", "p75", F.when(F.col("p75") <= lim["good"], "good").when(F.col("p75") <= lim["poor"], "needs_improvement").otherwise("poor").alias("rating"))


def psi_facts(psi: DataFrame) -> DataFrame:
    """Performance score, LCP and number of worthwhile savings from JSON reports; broken reports give nulls."""
    v = psi.withColumn("v", F.try_parse_json("body"))
    num = lambda p: F.try_variant_get("v", p, "double")
    big = F.when(num("$.lighthouseResult.audits.unused.details.overallSavingsMs") > 100, 1).otherwise(0) + F.when(num("$.lighthouseResult.audits.tiny.details.overallSavingsMs") > 100, 1).otherwise(0)
    return v.select("url", F.round(num("$.lighthouseResult.categories.performance.score") * 100).cast("long").alias("performance"), num("$.lighthouseResult.audits.lcp.numericValue").alias("lcp_ms"), big.cast("long").alias("savings"))


def same_as(entities: DataFrame) -> DataFrame:
    """sameAs links by platform: page_id, platform, priority; the first platform whose name the link has."""
    links = entities.select("page_id", F.explode(F.filter(F.split(F.coalesce("same_as", F.lit("")), r"\|"), lambda x: x != "")).alias("link"))
    hit = reduce(lambda c, p: c.when(F.lower("link").contains(p[1]), F.struct(F.lit(p[0]).alias("platform"), F.lit(p[2]).alias("priority"))), dims.PLATFORMS[1:], F.when(F.lower("link").contains(dims.PLATFORMS[0][1]), F.struct(F.lit(dims.PLATFORMS[0][0]).alias("platform"), F.lit(dims.PLATFORMS[0][2]).alias("priority"))))
    return links.select("page_id", hit.alias("h")).where("h is not null").select("page_id", "h.platform", "h.priority").distinct()


def entity_scores(entities: DataFrame) -> DataFrame:
    """Found and missing platforms, knowledge-base hits by exact name, and the score: 15 a profile, 25 a base, at most 100, less 10 for each missing critical or high platform."""
    found = same_as(entities)
    g = found.groupBy("page_id").agg(F.count("*").alias("found"))
    want = entities.select("page_id", F.explode(F.array(*(F.lit(p) for p, _, pr in dims.PLATFORMS if pr in ("critical", "high")))).alias("platform"))
    miss = want.join(found.select("page_id", "platform"), ["page_id", "platform"], "left_anti").groupBy("page_id").agg(F.count("*").alias("missing"))
    hit = lambda c: F.coalesce(F.lower(c) == F.lower("name"), F.lit(False))
    j = entities.select("page_id", hit("wikidata").alias("wikidata_hit"), hit("wikipedia").alias("wikipedia_hit")).join(g, "page_id", "left").join(miss, "page_id", "left").na.fill(0, ["found", "missing"])
    raw = F.least(F.lit(100), 15 * F.col("found") + F.when(F.col("wikidata_hit"), 25).otherwise(0) + F.when(F.col("wikipedia_hit"), 25).otherwise(0))
    return j.withColumn("score", F.greatest(F.lit(0), raw - 10 * F.col("missing")).cast("long"))


def indexnow_scores(probes: DataFrame) -> DataFrame:
    """40 for a key file, 20 for a key in the head, 30 for a reachable endpoint, 10 if robots allow it; unknown probes count as failed."""
    add = lambda c, n: F.when(F.coalesce(F.col(c), F.lit(False)), n).otherwise(0)
    return probes.select("host", (add("key_ok", 40) + add("meta_key", 20) + add("endpoint_ok", 30) + add("robots_ok", 10)).cast("long").alias("score"))
