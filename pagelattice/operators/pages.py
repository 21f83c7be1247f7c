"""Facts of pages: head fields, headings, images, structured data, social tags, local signals, platform; and the rules on them.

Every operator takes a table with page_id, url and html (html may be null) and is one narrow projection, or an
explode of a page's own arrays: no shuffle is needed before a roll-up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions import urls as U
from ..plans import dims


def word_stats(pages: DataFrame) -> DataFrame:
    """page_id, host, words of the visible text."""
    return pages.select("page_id", U.host(F.col("url")).alias("host"), F.size(T.words(H.visible(F.coalesce("html", F.lit(""))))).cast("long").alias("words"))


def thin_content(pages: DataFrame, floor: int = 300, critical: int = 100) -> DataFrame:
    w = word_stats(pages).where(F.col("words") < floor)
    return w.select("page_id", "host", "words", F.when(F.col("words") < critical, "critical").otherwise("warning").alias("severity"))


def host_word_stats(pages: DataFrame, floor: int = 300) -> DataFrame:
    g = word_stats(pages).groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("words") < floor).alias("thin_pages"), T.rounded(F.avg("words"), 2).alias("avg_words"), F.min("words").alias("min_words"), F.max("words").alias("max_words"))
    return g.withColumn("score", F.greatest(F.lit(0), F.lit(100) - F.lit(10) * F.col("thin_pages")).cast("long"))


def metas(html: Column) -> Column:
    """Meta tags as structs of key (property or name, lower case) and content."""
    return F.transform(H.tags(html, "meta"), lambda t: F.struct(F.lower(F.coalesce(H.attr(t, "property"), H.attr(t, "name"), F.lit(""))).alias("k"), F.coalesce(H.attr(t, "content"), F.lit("")).alias("v")))


def meta_first(m: Column, key: str) -> Column:
    """First content of a key that isn't blank; null if there is none."""
    return F.get(F.filter(m, lambda x: (x["k"] == key) & (F.trim(x["v"]) != "")), 0)["v"]


def canonicals(html: Column) -> Column:
    """hrefs of link tags whose rel has the token canonical, blank ones left out."""
    links = F.transform(H.tags(html, "link"), lambda t: F.struct(F.split(F.lower(F.coalesce(H.attr(t, "rel"), F.lit(""))), r"\s+").alias("rel"), F.trim(F.coalesce(H.attr(t, "href"), F.lit(""))).alias("href")))
    return F.transform(F.filter(links, lambda x: F.array_contains(x["rel"], "canonical") & (x["href"] != "")), lambda x: x["href"])


def facts(pages: DataFrame) -> DataFrame:
    """page_id, title, n_titles, meta_description, meta_source, meta_robots, canonical, n_canonicals, n_h1, first_h1, n_h2, n_h3, lang."""
    h = F.coalesce("html", F.lit(""))
    p = pages.select("page_id", h.alias("h")).withColumn("m", metas(F.col("h")))
    p = p.withColumns({"t": H.elements(F.col("h"), "title"), "h1": H.elements(F.col("h"), "h1"), "h2": H.elements(F.col("h"), "h2"), "h3": H.elements(F.col("h"), "h3"), "c": canonicals(F.col("h")), "d": meta_first(F.col("m"), "description"), "og": meta_first(F.col("m"), "og:description")})
    robots = F.filter("m", lambda x: x["k"] == "robots")
    return p.select(
        "page_id", F.get("t", 0).alias("title"), F.size("t").cast("long").alias("n_titles"), F.coalesce("d", "og").alias("meta_description"), F.when(F.col("d").isNotNull(), "meta").when(F.col("og").isNotNull(), "og").alias("meta_source"),
        F.when(F.size(robots) > 0, F.element_at(robots, -1)["v"]).alias("meta_robots"), F.get("c", 0).alias("canonical"), F.size("c").cast("long").alias("n_canonicals"),
        F.size("h1").cast("long").alias("n_h1"), F.get("h1", 0).alias("first_h1"), F.size("h2").cast("long").alias("n_h2"), F.size("h3").cast("long").alias("n_h3"), F.lower(H.attr(F.get(H.tags(F.col("h"), "html"), 0), "lang")).alias("lang"),
    )


def rules(df: DataFrame, keep: list[str], checks: list[tuple[str, str, Column]]) -> DataFrame:
    """One row for each check that holds: ``keep``, code, severity."""
    each = F.filter(F.array(*(F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"))) for code, sev, cond in checks)), lambda x: x.isNotNull())
    return df.select(*keep, F.explode(each).alias("r")).select(*keep, "r.code", "r.severity")


def length_checks(f: DataFrame) -> list[tuple[str, str, Column]]:
    t, m = F.coalesce(F.length("title"), F.lit(0)), F.coalesce(F.length("meta_description"), F.lit(0))
    return [
        ("title_missing", "critical", t == 0), ("title_short", "warning", (t > 0) & (t < 30)), ("title_long", "warning", t > 60), ("title_repeated", "warning", F.col("n_titles") > 1), ("description_missing", "high", m == 0), ("description_short", "info", (m > 0) & (m < 120)),
        ("description_long", "warning", m > 160), ("h1_missing", "high", F.col("n_h1") == 0), ("h1_repeated", "warning", F.col("n_h1") > 1),
    ]


def length_findings(pages: DataFrame) -> DataFrame:
    f = facts(pages)
    return rules(f, ["page_id"], length_checks(f))


def length_scores(pages: DataFrame) -> DataFrame:
    """page_id and the score of its worst length finding; 100 without any."""
    f = facts(pages)
    worst = [F.when(cond, {"critical": 40, "high": 60, "warning": 80, "info": 90}[sev]).otherwise(100) for code, sev, cond in length_checks(f) if code != "title_repeated"]
    return f.select("page_id", F.least(*worst).cast("long").alias("score"))


def onpage_scores(pages: DataFrame) -> DataFrame:
    f = facts(pages)
    points = lambda c, n: F.when(c, n).otherwise(0)
    return f.select("page_id", (F.lit(50) + points(F.col("title").isNotNull(), 15) + points(F.col("meta_description").isNotNull(), 15) + points(F.col("n_h1") > 0, 10) + points(F.col("canonical").isNotNull(), 10)).cast("long").alias("score"))


def images(pages: DataFrame) -> DataFrame:
    """One row an image: page_id, pos, src, alt (null if absent, '' if empty), loading, fetchpriority, extension, and what is there."""
    p = pages.select("page_id", F.posexplode(H.tags(F.coalesce("html", F.lit("")), "img")).alias("pos", "t"))
    a = lambda n: H.attr(F.col("t"), n)
    filled = lambda n: F.coalesce(a(n) != "", F.lit(False))
    ext = F.lower(F.regexp_extract(F.coalesce(a("src"), F.lit("")), r"^[^?#]*(\.[^.?#]*)(?:[?#].*)?$", 1))
    return p.select("page_id", "pos", a("src").alias("src"), a("alt").alias("alt"), F.lower(F.coalesce(a("loading"), F.lit(""))).alias("loading"), F.lower(F.coalesce(a("fetchpriority"), F.lit(""))).alias("fetchpriority"), ext.alias("extension"), filled("srcset").alias("has_srcset"), filled("sizes").alias("has_sizes"), (filled("width") & filled("height")).alias("has_dimensions"))


def image_scores(pages: DataFrame) -> DataFrame:
    """Counts by page and the score: 70 without images, else 100 less deductions."""
    i = images(pages)
    g = i.groupBy("page_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("alt").isNull()).alias("missing_alt"), F.count_if(F.trim("alt") == "").alias("empty_alt"), F.count_if(~F.col("has_srcset")).alias("missing_srcset"), F.count_if(F.col("has_srcset") & ~F.col("has_sizes")).alias("missing_sizes"),
        F.count_if(~F.col("has_dimensions")).alias("missing_dimensions"), F.count_if(F.col("extension").isin(".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff")).alias("raster"), F.min_by(F.col("loading") == "lazy", "pos").alias("lazy_first"),
    )
    zero = [c for c in g.columns if c not in ("page_id", "lazy_first")]
    g = pages.select("page_id").join(g, "page_id", "left").select("page_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in zero), F.coalesce("lazy_first", F.lit(False)).alias("lazy_first"))
    pct = T.rounded(F.lit(100.0) * F.col("missing_alt") / F.greatest("total", F.lit(1)), 1)
    off = F.when(pct > 25, 30).when(pct > 10, 15).when(pct > 0, 5).otherwise(0) + F.when(F.col("lazy_first"), 20).otherwise(0) + F.when(F.col("missing_dimensions") > F.floor(F.col("total") / 2), 10).otherwise(0) + F.when(F.col("raster") > 0, 5).otherwise(0)
    return g.withColumn("score", F.when(F.col("total") == 0, 70).otherwise(F.greatest(F.lit(0), F.lit(100) - off)).cast("long"))


def social_checks(pages: DataFrame) -> DataFrame:
    """page_id, tag, required, present, ok for all tags of the social dimension; the last content of a tag counts."""
    p = pages.select("page_id", metas(F.coalesce("html", F.lit(""))).alias("m"))
    tags = F.array(*(F.struct(F.lit(t).alias("tag"), F.lit(r).alias("required"), F.lit(lo).cast("int").alias("lo"), F.lit(hi).cast("int").alias("hi"), F.lit(v).cast("string").alias("allowed")) for t, r, lo, hi, v in dims.SOCIAL_TAGS))
    p = p.select("page_id", "m", F.explode(tags).alias("d")).select("page_id", "d.*", F.get(F.reverse(F.filter("m", lambda x: x["k"] == F.col("d.tag"))), 0)["v"].alias("value"))
    n, present = F.length("value"), F.coalesce(F.col("value") != "", F.lit(False))
    absolute = ~F.col("tag").isin("og:image", "og:url") | F.col("value").rlike("^https?://")
    fits = (F.col("lo").isNull() | (n >= F.col("lo"))) & (F.col("hi").isNull() | (n <= F.col("hi"))) & (F.col("allowed").isNull() | F.array_contains(F.split("allowed", r"\|"), F.col("value"))) & absolute
    return p.select("page_id", "tag", "required", present.alias("present"), (present & F.coalesce(fits, F.lit(False))).alias("ok"))


def social_scores(pages: DataFrame) -> DataFrame:
    c = social_checks(pages).groupBy("page_id").agg(F.count_if("present").alias("present"), F.count_if(F.col("required") & ~F.col("present")).alias("missing_required"), F.count_if(F.col("present") & ~F.col("ok")).alias("out_of_bounds"))
    return c.withColumn("score", F.round(F.lit(100.0) * F.col("present") / len(dims.SOCIAL_TAGS)).cast("long"))


def social_previews(pages: DataFrame) -> DataFrame:
    """Title and description a card would show, by fallback: og, twitter, page."""
    f = pages.select("page_id", F.coalesce("html", F.lit("")).alias("h")).withColumn("m", metas(F.col("h")))
    m = F.col("m")
    return f.select("page_id", F.coalesce(meta_first(m, "og:title"), meta_first(m, "twitter:title"), F.get(H.elements(F.col("h"), "title"), 0)).alias("title"), F.coalesce(meta_first(m, "og:description"), meta_first(m, "twitter:description"), meta_first(m, "description")).alias("description"), F.coalesce(meta_first(m, "og:image"), meta_first(m, "twitter:image")).alias("image"))


def json_ld(pages: DataFrame) -> DataFrame:
    """One row an object of a JSON-LD block (@graph members are objects): page_id, block, item, type, context, valid, raw.

    Blocks that are no JSON give one row with valid false. Lists and @graph are fanned out; members of a
    @graph inherit its context.
    """
    p = pages.select("page_id", F.posexplode(H.json_blocks(F.coalesce("html", F.lit("")))).alias("block", "raw"))
    p = p.withColumn("v", F.try_parse_json(F.trim("raw")))
    text = lambda path: F.try_variant_get("v", path, "string")
    top = p.select("page_id", "block", "raw", F.col("v").isNotNull().alias("valid"), text("$['@type']").alias("type"), text("$['@context']").alias("context"), F.coalesce(F.from_json(F.when(F.trim("raw").startswith("["), F.trim("raw")).otherwise(F.get_json_object("raw", "$['@graph']")), "array<string>"), F.array(F.lit(None).cast("string"))).alias("members"))
    one = top.select("page_id", "block", "valid", "context", "type", "raw", F.posexplode("members").alias("item", "member"))
    return one.select("page_id", "block", "item", "valid", F.coalesce(F.get_json_object("member", "$['@type']"), F.when(F.col("member").isNull(), F.col("type"))).alias("type"), F.coalesce(F.get_json_object("member", "$['@context']"), F.col("context")).alias("context"), F.coalesce("member", "raw").alias("raw"))


def schema_findings(pages: DataFrame) -> DataFrame:
    """page_id, block, item, code, severity for structured-data objects."""
    j = json_ld(pages)
    low = F.lower("raw")
    status = F.create_map(*(F.lit(x) for kv in dims.SCHEMA_STATUS.items() for x in kv))[F.col("type")]
    holds = reduce(lambda a, b: a | b, (low.contains(x.lower()) for x in dims.PLACEHOLDERS))
    return rules(j.withColumn("status", status), ["page_id", "block", "item"], [
        ("invalid_json", "warning", ~F.col("valid")), ("context_missing", "warning", F.col("valid") & F.col("context").isNull()), ("context_unknown", "warning", F.col("context").isNotNull() & ~F.col("context").isin("https://schema.org", "http://schema.org")),
        ("type_missing", "warning", F.col("valid") & F.col("type").isNull()), ("placeholder", "critical", F.col("valid") & holds), ("type_retired", "critical", F.col("status") == "retired"), ("type_no_rich_result", "info", F.col("status") == "no_rich_result"), ("type_restricted", "warning", F.col("status") == "restricted"),
    ])


def schema_scores(pages: DataFrame) -> DataFrame:
    """page_id, blocks, errors, critical and the score: 100 (55 without blocks) less 8 an error and 12 more a critical one."""
    f = schema_findings(pages).groupBy("page_id").agg(F.count("*").alias("errors"), F.count_if(F.col("severity") == "critical").alias("critical"))
    p = pages.select("page_id", F.size(H.json_blocks(F.coalesce("html", F.lit("")))).cast("long").alias("blocks")).join(f, "page_id", "left").na.fill(0, ["errors", "critical"])
    return p.withColumn("score", F.greatest(F.lit(0), F.when(F.col("blocks") == 0, 55).otherwise(100) - 8 * F.col("errors") - 12 * F.col("critical")).cast("long"))


def local_scores(pages: DataFrame) -> DataFrame:
    """Signals of a local business and the score; null where the page is none."""
    h = F.coalesce("html", F.lit(""))
    typed = lambda t: h.rlike(f'(?i)"@type"\\s*:\\s*"{t}"')
    p = pages.select("page_id", typed("LocalBusiness").alias("local_business"), typed("Organization").alias("organization"), F.regexp_count(h, F.lit("(?i)href=[\"']tel:")).cast("long").alias("tel_links"), F.regexp_count(h, F.lit("(?i)href=[\"']mailto:")).cast("long").alias("mail_links"), h.rlike(r'(?i)(streetAddress|postalCode|addressLocality|Address")').alias("address"), h.rlike(r"(?i)google\.com/maps|maps\.app\.goo\.gl").alias("map"))
    hint = (F.col("tel_links") > 0) | F.col("address") | F.col("map")
    add = lambda c, n: F.when(c, n).otherwise(0)
    score = F.lit(40) + add(F.col("local_business"), 35) + add(F.col("organization") & ~F.col("local_business"), 10) + add(F.col("tel_links") > 0, 10) + add(F.col("address"), 5) + add(F.col("map"), 5)
    return p.withColumn("score", F.when(hint | F.col("local_business"), F.least(F.lit(100), score)).cast("long"))


def platforms(pages: DataFrame) -> DataFrame:
    """page_id, platform with the most points, points, runner_up, confidence; 'generic' without evidence. Ties go by name."""
    h = F.lower(F.coalesce("html", F.lit("")))
    names = sorted({p for p, _, _ in dims.PLATFORM_SIGNALS})
    points = {n: reduce(lambda a, b: a + b, (F.when(h.contains(s), x).otherwise(0) for p, s, x in dims.PLATFORM_SIGNALS if p == n)) for n in names}
    ranked = F.array_sort(F.array(*(F.struct((-points[n]).alias("p"), F.lit(n).alias("n")) for n in names)))
    r = pages.select("page_id", F.filter(ranked, lambda x: x["p"] < 0).alias("r"))
    top = F.coalesce(-F.get("r", 0)["p"], F.lit(0))
    return r.select("page_id", F.coalesce(F.get("r", 0)["n"], F.lit("generic")).alias("platform"), top.cast("long").alias("points"), F.get("r", 1)["n"].alias("runner_up"), F.when(top >= 6, "high").when(top >= 3, "medium").when(top > 0, "low").otherwise("none").alias("confidence"))


def uniqueness(pages: DataFrame, fact: str) -> DataFrame:
    """Values of one fact that several pages of a host share: host, value, pages."""
    f = facts(pages).join(pages.select("page_id", U.host(F.col("url")).alias("host")), "page_id")
    return f.where(F.col(fact).isNotNull()).groupBy("host", F.lower(fact).alias("value")).agg(F.count("*").alias("pages")).where("pages > 1")


def template_groups(pages: DataFrame, least: int = 3) -> DataFrame:
    """URL templates with at least ``least`` pages: counts, word statistics, distinct titles and h1, risk."""
    p = pages.select("page_id", F.concat(U.host(F.col("url")), U.template(F.col("url"))).alias("pattern")).join(facts(pages).select("page_id", F.lower("title").alias("title"), F.lower("first_h1").alias("h1")), "page_id").join(word_stats(pages).select("page_id", "words"), "page_id")
    g = p.groupBy("pattern").agg(F.count("*").alias("pages"), T.rounded(F.avg("words"), 1).alias("avg_words"), F.min("words").alias("min_words"), F.max("words").alias("max_words"), F.count_if(F.col("words") < 300).alias("thin_pages"), F.countDistinct("title").alias("titles"), F.countDistinct("h1").alias("h1s"))
    g = g.where(F.col("pages") >= least)
    warnings = sum((F.when(c, 1).otherwise(0) for c in (F.col("titles") < F.col("pages"), F.col("h1s") < F.col("pages"), F.col("thin_pages") > 0)), F.lit(0))
    return g.withColumn("risk", F.when(F.col("thin_pages") * 2 > F.col("pages"), "high").when(warnings > 2, "medium").otherwise("low"))
