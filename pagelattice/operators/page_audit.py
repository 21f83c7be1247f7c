"""An audit of pages in one pass: the html is read and cut once, and the facts feed the detectors of every section.

``parsed`` is a chain of narrow projections. A detector is a list of (code, severity, condition) over its columns, so that all
detectors are one array of a row: no page is scanned twice and nothing is joined. What is counted by site is shuffled after partial counts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions import urls as U
from ..plans import dims
from . import pages as P
from .hosts import SOFT_404
from .links import SKIP

Check = tuple[str, Column | str, Column]
#: Words of ASCII letters alone, each found where it stands: counting them in a text needs no list of all words.
LETTERS = r"(?<![\p{L}\p{N}_])[a-zA-Z]+(?![\p{L}\p{N}_])"


def _objects(blocks: Column) -> Column:
    """Objects of the JSON-LD blocks, lists and @graph fanned out, as structs of valid, type, context, raw; a block that is no JSON is one that isn't valid."""
    member = lambda raw, k: F.get_json_object(raw, f"$['@{k}']")

    def of(raw: Column) -> Column:
        valid = F.try_parse_json(raw).isNotNull()
        listed = F.from_json(F.when(valid & raw.startswith("["), raw).when(valid, member(raw, "graph")), "array<string>")
        return F.transform(F.coalesce(listed, F.array(F.lit(None).cast("string"))), lambda m: F.struct(
            valid.alias("valid"), F.coalesce(member(m, "type"), F.when(m.isNull() & valid, member(raw, "type"))).alias("type"),
            F.coalesce(member(m, "context"), F.when(valid, member(raw, "context"))).alias("context"), F.coalesce(m, raw).alias("raw")))

    return F.flatten(F.transform(blocks, lambda b: of(F.trim(b))))


def _last(m: Column, tag: str) -> Column:
    """The last content of a social tag, null if it is absent or empty."""
    v = F.get(F.reverse(F.filter(m, lambda x: x["k"] == tag)), 0)["v"]
    return F.when(v != "", v)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, site and the facts of a page that detectors read. Null html is an empty page; other columns aren't read."""
    h = F.col("h")
    p = pages.select("page_id", "url", U.base_parts(F.col("url")).alias("base"), U.host(F.col("url")).alias("site"), F.coalesce("html", F.lit("")).alias("h"))
    cut = lambda x: F.struct(F.regexp_extract(x, "^([^>]*)>", 1).alias("t"), F.regexp_extract(x, r"(?is)^[^>]*>(.*?)(?:</a|\z)", 1).alias("inner"))
    # a plain search for a literal spares the pages without it the patterns
    p = p.withColumn("low", F.lower(h))
    has = lambda *literals: reduce(lambda x, y: x | y, (F.col("low").contains(x) for x in literals))
    if_has = lambda literal, found: F.when(has(literal), found).otherwise(F.array().cast("array<string>"))
    p = p.select(
        "page_id", "url", "base", "site", P.metas(h).alias("m"), H.elements(h, "title").alias("titles"), if_has("<h1", H.elements(h, "h1")).alias("h1"), if_has("<link", P.canonicals(h)).alias("canonicals"), if_has("<img", H.tags(h, "img")).alias("img"), if_has("<link", H.tags(h, "link")).alias("link"),
        if_has("ld+json", H.json_blocks(h)).alias("blocks"), H.visible(h).alias("text"), F.transform(F.filter(F.slice(F.split(h, r"(?i)<a\s", -1), 2, 1 << 30), lambda x: x.contains(">")), cut).alias("a"), has("google.com/maps").alias("map"),
        (has("tel:") & h.rlike("(?i)href=[\"']tel:")).alias("tel"), has("streetaddress", "postalcode", "addresslocality", 'address"').alias("address"), (has("localbusiness") & h.rlike('(?i)"@type"\\s*:\\s*"LocalBusiness"')).alias("local_business"),
    )
    rel = lambda t: F.split(F.lower(F.coalesce(H.attr(t, "rel"), F.lit(""))), r"\s+")
    filled = lambda t, n: F.coalesce(H.attr(t, n) != "", F.lit(False))
    low = lambda t, n: F.lower(F.coalesce(H.attr(t, n), F.lit("")))
    image = lambda t: F.struct(
        H.attr(t, "alt").isNull().alias("no_alt"), low(t, "loading").alias("loading"), low(t, "fetchpriority").alias("priority"), filled(t, "srcset").alias("srcset"), filled(t, "sizes").alias("sizes"), (filled(t, "width") & filled(t, "height")).alias("sized"),
        F.lower(F.regexp_extract(F.coalesce(H.attr(t, "src"), F.lit("")), r"^[^?#]*(\.[^.?#]*)(?:[?#].*)?$", 1)).isin(*RASTER).alias("raster"))
    link = lambda x: F.struct(F.trim(H.attr(x["t"], "href")).alias("href"), F.array_contains(rel(x["t"]), "nofollow").alias("nofollow"), (H.squeeze(H.decode(F.regexp_replace(x["inner"], "<[^>]*>", " "))) == "").alias("bare"))
    p = p.withColumns({
        "img": F.transform("img", image), "a": F.transform("a", link), "objects": _objects(F.col("blocks")), "letters": F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0)), "sentences": T.sentences(F.col("text")),
        "alternates": F.transform(F.filter("link", lambda t: F.array_contains(rel(t), "alternate") & filled(t, "hreflang") & filled(t, "href")), lambda t: F.struct(F.trim(H.attr(t, "hreflang")).alias("lang"), F.trim(H.attr(t, "href")).alias("href"))),
    })
    kept = F.filter("a", lambda x: x["href"].isNotNull() & (x["href"] != "") & ~x["href"].rlike(SKIP))
    p = p.withColumn("links", F.transform(kept, lambda x: F.struct(U.resolve_from(F.col("base"), x["href"]).alias("target"), x["nofollow"].alias("nofollow"), x["bare"].alias("bare"))))
    p = p.withColumn("own", F.filter("links", lambda x: U.scheme(x["target"]).isin("http", "https") & (U.host(x["target"]) == F.col("site"))))
    prose = F.filter("sentences", lambda s: F.regexp_count(s, F.lit(LETTERS)) >= 4)
    # words of three letters and more in one string, each without a final e and with a blank after it
    p = p.withColumn("stems", F.regexp_replace(F.concat(F.array_join(F.filter(F.transform("letters", lambda w: F.lower(w)), lambda w: F.length(w) > 2), " "), F.lit(" ")), "e ", " "))
    short = F.size(F.filter("letters", lambda w: F.length(w) <= 2))
    d = P.meta_first(F.col("m"), "description")
    return p.select(
        "page_id", "url", "site", "m", "canonicals", "objects", "img", "alternates", "own", "map", "tel", "address", "local_business", F.get("titles", 0).alias("title"), F.size("titles").alias("n_titles"), F.size("h1").alias("n_h1"), F.get("h1", 0).alias("first_h1"), F.size("blocks").alias("n_blocks"),
        F.coalesce(d, P.meta_first(F.col("m"), "og:description")).alias("meta_description"), F.regexp_count("text", F.lit(T.WORD)).alias("words"), F.size("letters").alias("n_letters"),
        (short + F.regexp_count("stems", F.lit("[aeiouy]+")) + F.regexp_count("stems", F.lit("(?<![^ ])[^aeiouy ]+(?= )"))).alias("syllables"), F.greatest(F.lit(1), F.size(prose)).alias("n_sentences"),
        F.transform("own", lambda x: U.normal_b(x["target"])).alias("targets"), U.resolve_from(F.col("base"), F.get("canonicals", 0)).alias("canonical"), F.transform("alternates", lambda x: F.struct(F.lower(x["lang"]).alias("lang"), U.resolve_from(F.col("base"), x["href"]).alias("url"))).alias("tags"),
    )


#: Extensions of raster images.
RASTER = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff")


def onpage(p: DataFrame) -> list[Check]:
    return P.length_checks(p)


def content(p: DataFrame) -> list[Check]:
    return [("thin_content", F.when(F.col("words") < 100, "critical").otherwise("warning"), F.col("words") < 300)]


def soft_404(p: DataFrame) -> list[Check]:
    t = F.lower(F.coalesce("title", F.lit("")))
    return [("soft_404_title", "critical", reduce(lambda a, b: a | b, (t.contains(s) for s in SOFT_404)))]


def address(p: DataFrame) -> list[Check]:
    """The page's own URL."""
    u, kind = F.col("url"), U.hygiene(F.col("url"))
    return [
        ("url_template", "critical", kind == "template"), ("url_search", "warning", kind == "search"), ("url_facet", "warning", kind == "faceted"), ("url_parameter", "info", kind == "parameter"), ("url_upper_case", "info", U.path(u).rlike("[A-Z]")),
        ("url_underscore", "info", U.path(u).contains("_")), ("url_too_long", "warning", F.length(u) > 100), ("no_https", "critical", U.scheme(u) == "http"),
    ]


def canonical(p: DataFrame) -> list[Check]:
    u, c, n, raw = F.col("url"), F.col("canonical"), F.size("canonicals"), F.get("canonicals", 0)
    own = U.normal_a(c) == U.normal_a(u)
    slash = lambda x: U.path(x).endswith("/") & (F.length(U.path(x)) > 1)
    noindex = F.coalesce(F.get(F.reverse(F.filter("m", lambda x: x["k"] == "robots")), 0)["v"].contains("noindex"), F.lit(False))
    return [
        ("canonical_several", "critical", n > 1), ("canonical_missing", "high", n == 0), ("canonical_relative", "high", ~raw.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://")), ("canonical_http_on_https", "high", (U.scheme(c) == "http") & (U.scheme(u) == "https")),
        ("canonical_www_mismatch", "high", U.host(c).startswith("www.") != U.host(u).startswith("www.")), ("canonical_slash_mismatch", "warning", own & (slash(c) != slash(u))), ("canonical_other_page", "info", ~own), ("canonical_noindex_conflict", "critical", noindex & ~own),
    ]


def hreflang(p: DataFrame) -> list[Check]:
    """Alternates of the page's link tags, where it has some."""
    trim = lambda x: F.regexp_replace(x, "/+$", "")
    some, default = F.size("tags") > 0, F.size(F.filter("tags", lambda x: x["lang"] == "x-default"))
    lang = lambda x: F.get(F.split(x["lang"], "-"), 0)
    region = lambda x: F.upper(F.get(F.split(x["lang"], "-", 2), 1))
    known = [*dims.REGIONS, "HANS", "HANT"]
    bad = lambda x: (x["lang"] != "x-default") & (~lang(x).isin(*dims.LANGUAGES) | ((lang(x) == "zh") & region(x).isNull()) | F.coalesce(~region(x).isin(*known) | region(x).isin(*dims.REGION_MISTAKES), F.lit(False)))
    return [
        ("alternates_without_self", "critical", some & ~F.exists("tags", lambda x: trim(x["url"]) == trim(F.col("url")))), ("alternates_without_default", "high", some & (default == 0)), ("alternates_several_defaults", "high", default > 1),
        ("alternates_mixed_protocols", "warning", F.size(F.array_distinct(F.transform("tags", lambda x: U.scheme(x["url"])))) > 1), ("alternates_bad_code", "high", F.exists("tags", bad)),
    ]


def internal_links(p: DataFrame) -> list[Check]:
    n = F.size(F.array_distinct("targets"))
    return [
        ("links_none", "high", n == 0), ("links_few", "warning", n < 3), ("links_many", "warning", n > 100), ("links_nofollow", "warning", F.exists("own", lambda x: x["nofollow"])), ("links_without_text", "warning", F.exists("own", lambda x: x["bare"])),
    ]


def readability(p: DataFrame) -> list[Check]:
    n, s = F.col("n_letters").cast("double"), F.col("n_sentences").cast("double")
    return [("hard_to_read", "warning", (n > 0) & (T.reading_ease(n, s, F.col("syllables").cast("double")) < 40)), ("long_sentences", "warning", n / s > 25)]


def schema_validation(p: DataFrame) -> list[Check]:
    status = F.create_map(*(F.lit(x) for kv in dims.SCHEMA_STATUS.items() for x in kv))
    held = lambda f: F.exists("objects", f)
    is_ = lambda s: held(lambda o: F.coalesce(F.try_element_at(status, o["type"]) == s, F.lit(False)))
    return [
        ("invalid_json", "warning", held(lambda o: ~o["valid"])), ("context_missing", "warning", held(lambda o: o["valid"] & o["context"].isNull())), ("context_unknown", "warning", held(lambda o: F.coalesce(~o["context"].isin("https://schema.org", "http://schema.org"), F.lit(False)))),
        ("type_missing", "warning", held(lambda o: o["valid"] & o["type"].isNull())), ("placeholder", "critical", held(lambda o: o["valid"] & reduce(lambda a, b: a | b, (F.lower(o["raw"]).contains(x.lower()) for x in dims.PLACEHOLDERS)))),
        ("type_retired", "critical", is_("retired")), ("type_no_rich_result", "info", is_("no_rich_result")), ("type_restricted", "warning", is_("restricted")),
    ]


def entity(p: DataFrame) -> list[Check]:
    some = F.exists("objects", lambda o: F.coalesce(o["type"].isin(*dims.ENTITY_TYPES), F.lit(False)))
    named = F.exists("objects", lambda o: F.coalesce(o["type"].isin(*dims.ENTITY_TYPES), F.lit(False)) & o["raw"].contains('"sameAs"'))
    return [("entity_missing", "critical", ~some), ("same_as_missing", "critical", some & ~named)]


def social(p: DataFrame) -> list[Check]:
    absent = lambda prefix: reduce(lambda a, b: a | b, (_last(F.col("m"), t).isNull() for t, required, *_ in dims.SOCIAL_TAGS if required and t.startswith(prefix)))
    return [("open_graph_incomplete", "warning", absent("og:")), ("card_incomplete", "warning", absent("twitter:"))]


def image_seo(p: DataFrame) -> list[Check]:
    n, first = F.size("img"), F.get("img", 0)
    count = lambda f: F.size(F.filter("img", f))
    bare, plain, unsized = count(lambda x: x["no_alt"]), count(lambda x: ~x["srcset"]), count(lambda x: ~x["sized"])
    return [
        ("no_images", "info", n == 0), ("alt_missing", F.when(bare * 4 > n, "high").otherwise("warning"), bare > 0), ("first_image_lazy", "critical", first["loading"] == "lazy"), ("first_image_without_priority", "warning", first["priority"] != "high"),
        ("first_image_without_srcset", "warning", ~first["srcset"]), ("srcset_missing", "warning", (n > 1) & (plain > F.floor(n / 2))), ("sizes_missing", "info", F.exists("img", lambda x: x["srcset"] & ~x["sizes"])),
        ("dimensions_missing", F.when(unsized > F.floor(n / 2), "warning").otherwise("info"), unsized > 0), ("raster_images", "info", F.exists("img", lambda x: x["raster"])),
    ]


def local_signals(p: DataFrame) -> list[Check]:
    hint = F.col("tel") | F.col("address") | F.col("map")
    return [("local_business_missing", "high", hint & ~F.col("local_business")), ("phone_link_missing", "medium", hint & ~F.col("local_business") & ~F.col("tel"))]


#: section -> detector over the columns of ``parsed``.
DETECTORS: dict[str, Callable[[DataFrame], list[Check]]] = {
    "onpage": onpage, "content": content, "soft_404": soft_404, "url": address, "canonical": canonical, "hreflang": hreflang, "internal_links": internal_links, "readability": readability, "schema_validation": schema_validation, "entity": entity, "social": social,
    "image_seo": image_seo, "local_signals": local_signals,
}


def _isolated(p: DataFrame, detector: Callable[[DataFrame], list[Check]]) -> list[Check]:
    """The detector's checks; if it can't be built or analysed over ``p``, a finding that says so on every page, so that the others go on."""
    try:
        checks = detector(p)
        p.select(*(F.struct(F.lit(code), sev if isinstance(sev, Column) else F.lit(sev), cond.cast("boolean")) for code, sev, cond in checks)).schema  # noqa: B018  analysed here
        return checks
    except (PySparkException, KeyError, TypeError, ValueError, AttributeError):
        return [("detector_failed", "info", F.lit(True))]


def findings(pages: DataFrame, sections: tuple[str, ...] | None = None, watch: Observation | None = None, detectors: dict[str, Callable[[DataFrame], list[Check]]] | None = None) -> DataFrame:
    """page_id, site, section, code, severity: a row for each check that holds on a page.

    ``watch`` observes the run: pages, bytes of text that were read, and findings.
    """
    p, all_ = parsed(pages), detectors or DETECTORS
    if watch is not None:
        p = p.observe(watch, F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.count_if(F.size("objects") > 0).alias("pages_with_objects"))
    rows = [
        F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(s).alias("section"), F.lit(code).alias("code"), (sev if isinstance(sev, Column) else F.lit(sev)).alias("severity")))
        for s in sections or all_ for code, sev, cond in _isolated(p, all_[s])
    ]
    # explode_outer: for explode the optimizer would filter on the array first, and make it twice
    e = p.select("page_id", "site", F.explode_outer(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("r"))
    return e.where("r is not null").select("page_id", "site", "r.section", "r.code", "r.severity")


def audit_findings(pages: DataFrame, sections: tuple[str, ...] | None = None, watch: Observation | None = None) -> DataFrame:
    """site, section, code, severity and pages concerned, of all detectors or the named ones. One scan; a shuffle after partial counts."""
    return findings(pages, sections, watch).groupBy("site", "section", "code", "severity").agg(F.count_distinct("page_id").alias("pages"))
