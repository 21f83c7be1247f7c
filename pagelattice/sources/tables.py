"""Tables of a folder of Parquet files, and small literal tables for rules that the folder's data don't exercise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .fixtures import FIXTURES


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: name -> (DDL columns, rows). Rows are fixtures: small, fixed, and chosen to reach every branch of a rule.
LITERALS: dict[str, tuple[str, list[tuple]]] = {
    "http_response": (
        "url string, final_url string, status int, hops int, mixed boolean, temporary boolean, https boolean, hsts string, csp string, xfo string, xcto string, referrer string, permissions string",
        [
            ("https://a.test/", "https://a.test/", 200, 0, False, False, True, "max-age=31536000; includeSubDomains", "default-src 'self'", "SAMEORIGIN", "nosniff", "no-referrer", "camera=()"),
            ("https://b.test/", "https://b.test/", 200, 0, False, False, True, "max-age=86400", None, None, "nosniff", None, None),
            ("http://c.test/", "http://c.test/", 200, 0, False, False, False, None, None, None, None, None, None),
            ("http://d.test/", "https://d.test/home", 200, 3, True, True, True, "MAX-AGE=63072000", None, "DENY", None, None, None),
            ("https://e.test/gone", "https://e.test/gone", 404, 1, False, False, True, None, None, None, None, None, None),
            ("https://f.test/err", "https://f.test/err", 503, 0, False, False, True, None, "x", None, None, None, None),
        ],
    ),
    "canonical_page": (
        "page_id bigint, url string, canonicals string, header_canonical string, robots string",
        [
            (1, "https://a.test/x", "https://a.test/x", None, "index"),
            (2, "https://a.test/y/", "https://a.test/y", None, None),
            (3, "https://a.test/z", "https://a.test/x", None, "noindex,follow"),
            (4, "https://www.a.test/p", "http://a.test/p", None, None),
            (5, "https://a.test/q", None, None, None),
            (6, "https://a.test/r", "/r", None, None),
            (7, "https://a.test/s", "https://a.test/s|https://a.test/t", None, None),
            (8, "https://a.test/u", None, "https://a.test/u", None),
            (9, "https://a.test/v", "https://a.test/z", None, None),
            (10, "https://a.test/w", "https://a.test/w", "https://a.test/x", "noindex"),
            (11, "https://a.test/x?a=1", "https://a.test/x", None, None),
            (12, "https://a.test/dead", "https://e.test/gone", None, None),
        ],
    ),
    "redirect": (
        "src string, dst string, status int",
        [("/a", "/b", 301), ("/b", "/c", 302), ("/c", "/d", 301), ("/l1", "/l2", 301), ("/l2", "/l1", 301), ("/s", "/d", 301), ("/self", "/self", 301), ("/e", "/b", 308)],
    ),
    "redirect_map": (
        "old_url string, expected string, actual string, status int",
        [("/old1", "https://a.test/new1", "https://a.test/new1/", 301), ("/old2", "https://a.test/new2", "https://a.test/", 301), ("/old3", "https://a.test/new3", "https://a.test/new3", 302), ("/old4", "https://a.test/new4", None, 404)],
    ),
    "hreflang": (
        "page string, raw_lang string, url string, source string",
        [
            ("https://a.test/en", "en", "https://a.test/en/", "html"), ("https://a.test/en", "de", "https://a.test/de", "html"), ("https://a.test/en", "x-default", "https://a.test/en", "html"), ("https://a.test/en", "en", "https://a.test/en", "header"),
            ("https://a.test/de", "de", "https://a.test/de", "html"), ("https://a.test/de", "en", "https://a.test/en", "html"), ("https://a.test/de", "jp", "http://a.test/jp", "html"),
            ("https://a.test/fr", "fr-EU", "https://a.test/fr2", "header"), ("https://a.test/fr", "eng", "https://a.test/en", "header"), ("https://a.test/fr", "en-UK", "https://a.test/uk", "header"),
            ("https://a.test/zh", "zh", "https://a.test/zh", "sitemap"), ("https://a.test/zh", "zh-QQ", "https://a.test/qq", "sitemap"), ("https://a.test/zh", "x-default", "https://a.test/zh", "sitemap"), ("https://a.test/zh", "x-default", "https://a.test/en", "sitemap"),
        ],
    ),
    "robots_txt": (
        "host string, status int, body string",
        [
            ("a.test", 200, "# rules\nUser-agent: *\nDisallow: /tmp\n\nUser-agent: GPTBot\nDisallow: /\nUser-agent: CCBot\nAllow: /pub\nSitemap: https://a.test/sitemap.xml\nCrawl-delay: 5"),
            ("b.test", 200, "User-Agent: *\nDisallow: /\nno colon here\nUser-agent: ClaudeBot\nDisallow: /a\nDisallow: /b\nDisallow:"),
            ("c.test", 404, None),
            ("d.test", 500, "User-agent: *"),
            ("e.test", 200, "Sitemap: https://e.test/s1.xml\nSitemap: https://e.test/s2.xml\nUser-agent: Amazonbot"),
        ],
    ),
    "sitemap_xml": (
        "host string, url string, body string",
        [
            ("a.test", "https://a.test/sitemap.xml", "<sitemapindex><sitemap><loc>https://a.test/s1.xml</loc></sitemap><sitemap><loc> https://a.test/s2.xml </loc></sitemap></sitemapindex>"),
            ("a.test", "https://a.test/s1.xml", "<urlset><url><loc>https://a.test/</loc></url><url><LOC>https://a.test/p?page=2</LOC></url><url><loc>https://a.test/find?q=x</loc></url></urlset>"),
            ("a.test", "https://a.test/s2.xml", "<urlset><url><loc>https://a.test/{id}</loc></url><url><loc>https://a.test/p?x=1</loc></url><url><loc>https://a.test/</loc></url></urlset>"),
            ("b.test", "https://b.test/sitemap.xml", "<urlset></urlset>"),
        ],
    ),
    "url_status": (
        "url string, status int, error string, soft_404 boolean, redirect_to string",
        [
            ("https://a.test/", 200, None, False, None), ("https://a.test/1", 404, None, False, None), ("https://a.test/2", 503, None, False, None), ("https://a.test/3", None, "timeout", False, None),
            ("https://a.test/4", None, "connection_failed", False, None), ("https://a.test/5", 200, None, True, None), ("https://a.test/6", 200, None, False, "https://a.test/"), ("https://a.test/7", 403, None, False, None),
        ],
    ),
    "llms_txt": (
        "host string, body string",
        [
            ("a.test", "# A site\n> All about a, with a description that is long enough for a bonus.\n## Docs\n- [Start](https://a.test/s): begin\n- [API](https://a.test/api)\n## Blog\n- [One](https://a.test/1)\n## More\n- [Two](https://a.test/2)\n- [Three](https://a.test/3): three"),
            ("b.test", "no title\n> short\n- [x](https://b.test/x)"),
            ("c.test", "# Only a title"),
        ],
    ),
    "head_html": (
        "page_id bigint, html string",
        [
            (1, '<html><head><title>A title that is long enough for results</title><meta name="description" content="A description."><meta property="og:title" content="A title for cards"><meta property="og:description" content="short"><meta property="og:image" content="/img.png"><meta property="og:url" content="https://a.test/"><meta property="og:type" content="article"><meta name="twitter:card" content="summary"><link rel="canonical" href="https://a.test/"></head><body><img src="a.webp" alt="A photo" width="1" height="2" srcset="a 1x" sizes="1" fetchpriority="high"><img src="b.JPG?x=1" loading="lazy" alt=""></body></html>'),
            (2, '<title>Short</title><meta content="Reversed order of attributes" name="description"><meta name=\'twitter:card\' content=\'gallery\'><meta property="twitter:title" content="t"><img src="c.png" loading="lazy"><img src="d.png"><img src="e.svg#f.gif" alt="x"><h1>One</h1><h1>Two</h1>'),
            (3, '<html><body><script type="application/ld+json">{"@context":"https://schema.org","@type":"LocalBusiness","name":"[Business Name]","streetAddress":"1 Road"}</script><a href="tel:123">call</a><a href="mailto:a@b">m</a><script type="application/ld+json">{"@context":"https://schema.org","@type":"FAQPage"}</script></body></html>'),
            (4, '<body><script type="application/ld+json">{broken</script><script type="application/ld+json">{"@type":"HowTo"}</script><iframe src="https://www.google.com/maps/embed"></iframe></body>'),
            (5, '<script type="application/ld+json">{"@context":"http://schema.org","@type":"SpecialAnnouncement"}</script><meta property="og:description" content="From a card">'),
            (6, ""),
        ],
    ),
    "backlink": (
        "seq bigint, source_url string, source_domain string, target_url string, anchor string, follow boolean, dr double, tld string",
        [
            (1, "https://news.example.org/1", "news.example.org", "https://www.acme.com/", "Acme", True, 71.0, ".org"),
            (2, "https://blog.one.com/a", "blog.one.com", "https://www.acme.com/shop", "best cheap shoes", True, 33.0, ".com"),
            (3, "https://blog.one.com/b", "blog.one.com", "https://www.acme.com/shop", "best cheap shoes", True, 34.0, ".com"),
            (4, "https://blog.one.com/c", "blog.one.com", "https://www.acme.com/shop", "best cheap shoes", False, 35.0, ".com"),
            (5, "https://casino-slots.ru/x", "casino-slots.ru", "https://www.acme.com/", "click here", True, 4.0, ".ru"),
            (6, "https://uni.edu/r", "uni.edu", "https://www.acme.com/paper", "https://www.acme.com/paper", False, 88.0, ".edu"),
            (7, "https://a-b-c-d-e.net/", "a-b-c-d-e.net", "https://www.acme.com/", "sponsored post", True, 12.0, ".net"),
            (8, "https://12345.info/", "12345.info", "https://www.acme.com/shop", "", True, 20.0, ".info"),
            (9, "https://my.blogspot.com/", "my.blogspot.com", "https://www.acme.com/shop", "great deals on all of these shoes today!", False, 41.0, ".com"),
            (10, "https://big.io/a", "big.io", "https://www.acme.com/", "acme corp", True, 61.0, ".io"),
            (11, "https://big.io/b", "big.io", "https://www.acme.com/x", "read more", True, 62.0, ".io"),
            (12, "https://cheap-shoes-online.com/", "cheap-shoes-online.com", "https://www.acme.com/shop", "link exchange", True, 15.0, ".com"),
            (13, "https://spam.cn/1", "spam.cn", "https://www.acme.com/", "shoes", True, 9.0, ".cn"), (14, "https://spam.cn/2", "spam.cn", "https://www.acme.com/", "shoes", True, 9.0, ".cn"),
            (15, "https://spam.cn/3", "spam.cn", "https://www.acme.com/", "shoes", True, 9.0, ".cn"), (16, "https://spam.cn/4", "spam.cn", "https://www.acme.com/", "shoes", True, 9.0, ".cn"),
            (17, "https://spam.cn/5", "spam.cn", "https://www.acme.com/", "shoes", True, 9.0, ".cn"), (18, "https://spam.cn/6", "spam.cn", "https://www.acme.com/", "shoes", True, 9.0, ".cn"),
            (19, "https://directory-of-everything-and-much-more-for-you.com/", "directory-of-everything-and-much-more-for-you.com", "https://www.acme.com/", "acme", False, 22.0, ".com"),
            (20, "https://gov.example.gov/", "gov.example.gov", "https://www.acme.com/", None, True, 90.0, ".gov"),
        ],
    ),
    "competitor_backlink": (
        "seq bigint, source_domain string, competitor string, dr double",
        [(1, "news.example.org", "rival", 71.0), (2, "fresh.org", "rival", 55.0), (3, "fresh.org", "other", 56.0), (4, "tech.net", "rival", 80.0), (5, "big.io", "other", 61.0), (6, "tiny.co", "other", 5.0)],
    ),
    "finding": (
        "seq bigint, severity string, finding string, source string",
        [
            (1, "Warning", "Missing required file: SECURITY.md. Add it", "a"), (2, "Critical", "missing required repository file:  security.md", "b"), (3, "Info", "README sectioning is shallow", "a"), (4, "Warning", "No code examples detected in README", "a"),
            (5, "Info", "Title   too SHORT (12 chars)!", "c"), (6, "Info", "title too short (12 chars)", "d"), (7, "Critical", "Missing community profile component: Code of conduct", "a"), (8, "Warning", "Remote community profile marks `code of conduct` as missing", "b"), (9, None, "Unranked note", None),
        ],
    ),
    "metric_context": ("code_block_count int, h1_count int, has_install_section boolean, heading_count int", [(2, 1, False, 3)]),
    "assertion": (
        "assert_id bigint, role string, kind string, terms string",
        [(1, "assistant", "contains_any", "the|and"), (2, "assistant", "contains_all", "the|and"), (3, "user", "contains_pattern", "[0-9]+"), (4, "assistant", "not_contains_pattern", "(?i)password"), (5, "user", "not_contains_any", "zzz|qqq")],
    ),
    "section_score": (
        "site string, section string, score double",
        [
            ("s1", "security", 65.0), ("s1", "social", 40.0), ("s1", "robots", 80.0), ("s1", "broken_links", 97.0), ("s1", "internal_links", 80.0), ("s1", "redirects", 100.0), ("s1", "llms_txt", 0.0), ("s1", "pagespeed", None), ("s1", "onpage", 90.0), ("s1", "hreflang", None), ("s1", "canonical", 100.0),
            ("s2", "security", 10.0), ("s2", "onpage", 55.0), ("s2", "readability", 20.0), ("s2", "unknown", 99.0), ("s3", "hreflang", None),
        ],
    ),
    "grade": (
        "page string, item string, dim string, grade string",
        [
            *((p, f"{d}{i}", d, g) for p, s in (("p1", "PPFNPAPPPF"), ("p2", "NNNNNNPPFF"), ("p3", "PPPPPPPPPP")) for d in ("C", "O", "R", "E") for i, g in enumerate(s, 1)),
            ("p3", "T4", "T", "F"), ("p3", "T5", "T", "P"), ("p1", "T4", "T", "P"),
        ],
    ),
    "grade_weight": ("kind string, dim string, weight double", [("blog", "C", 0.25), ("blog", "O", 0.25), ("blog", "R", 0.2), ("blog", "E", 0.2), ("blog", "T", 0.1), ("product", "C", 0.1), ("product", "O", 0.3), ("product", "R", 0.3), ("product", "E", 0.1), ("product", "T", 0.2)]),
    "keyword": (
        "keyword string, volume bigint, difficulty int, position double, impressions bigint, clicks bigint",
        [
            ("buy running shoes", 4400, 62, 3.2, 9000, 700), ("how to lace shoes", 1900, 21, 11.0, 4000, 40), ("acme login", 700, 5, 1.0, 700, 400), ("best trail shoes review", 2400, 48, 7.5, 12000, 60), ("shoe", 90000, 95, 34.0, 90000, 90), ("shoe store near me", 8100, 55, 14.0, 5000, 20), ("acme vs rival", 320, 0, 4.0, 300, 30),
        ],
    ),
    "ctr_band": ("lo double, hi double, expected_ctr double", [(1.0, 1.5, 0.28), (1.5, 2.5, 0.15), (2.5, 3.5, 0.11), (3.5, 5.5, 0.07), (5.5, 10.5, 0.03), (10.5, 20.5, 0.01)]),
    "cwv": (
        "page string, metric string, value double",
        [(f"p{i % 3}", m, float(v * (i + 1))) for i in range(8) for m, v in (("LCP", 700), ("INP", 60), ("CLS", 0.03))],
    ),
    "psi": ("url string, body string", [("https://a.test/", '{"lighthouseResult":{"categories":{"performance":{"score":0.87}},"audits":{"lcp":{"numericValue":2300.5},"unused":{"details":{"overallSavingsMs":450}},"tiny":{"details":{"overallSavingsMs":50}}}}}'), ("https://b.test/", "{"), ("https://c.test/", '{"lighthouseResult":{"categories":{"performance":{"score":0.3}},"audits":{"lcp":{"numericValue":6100}}}}')]),
    "entity": ("page_id bigint, name string, same_as string, wikidata string, wikipedia string", [(1, "Acme", "https://www.wikidata.org/wiki/Q1|https://www.linkedin.com/company/acme|https://x.com/acme", "Acme", None), (2, "Beta", "", "Bet", "Beta"), (3, None, "https://en.wikipedia.org/wiki/Gamma|https://twitter.com/g|https://www.crunchbase.com/g", None, None)]),
    "indexnow": ("host string, key_ok boolean, meta_key boolean, robots_ok boolean, endpoint_ok boolean", [("a.test", True, False, True, True), ("b.test", False, True, True, False), ("c.test", None, None, False, None)]),
    "audit_metrics": (
        "site string, link_issues int, broken_pages int, soft_404_pages int, redirected_pages int, redirect_issues int, llms_score int, speed_score int, reading_ease double, links_per_page double, orphans int, dead_ends int, hreflang_tags int, hreflang_critical int, hreflang_high int, hreflang_medium int, near_pairs int, thin_pages int, template_groups int, template_critical int, template_warnings int, canonical_score double, local_business boolean, local_score double",
        [
            ("a.test", 2, 1, 0, 3, 1, 80, 92, 64.2, 6.5, 1, 2, 4, 1, 1, 2, 1, 3, 2, 1, 2, 88.6, True, 75.0),
            ("b.test", 9, 4, 2, 0, 5, None, None, 41.3, 3.4, 12, 9, 0, None, None, None, 0, 0, 0, None, None, None, False, None),
            ("c.test", None, None, None, None, None, 10, 40, 12.9, 1.0, None, None, None, None, None, None, 9, 9, 1, 4, 9, 40.0, None, None),
            ("d.test", 0, 0, 0, 0, 0, 100, 100, None, None, None, None, 2, 0, 0, 0, None, None, None, None, None, 100.0, True, None),
        ],
    ),
    "sitemap_summary": (
        "host string, robots_status int, sitemaps int, sitemap_status int, urls int, checked int, healthy int, pattern_urls int",
        [("a.test", 200, 1, 200, 50, 20, 20, 0), ("b.test", 200, 0, 404, 0, 0, 0, 0), ("c.test", 404, 2, 200, 9, 10, 8, 1), ("d.test", 200, 1, 200, 9, 10, 6, 5), ("e.test", 500, 0, 500, 3, 10, 1, None)],
    ),
    "link_header": (
        "url string, link string",
        [("https://a.test/f.pdf", '<https://a.test/f.pdf>; rel="alternate"; hreflang="EN", <https://a.test/de.pdf>; rel="alternate nofollow"; hreflang="de-AT", <https://a.test/c>; rel="canonical"'), ("https://b.test/", None), ("https://c.test/", '<https://c.test/x>; rel="alternate"')],
    ),
    "index_part": (
        "subject string, part string, score double",
        [("p1", "experience", 80.0), ("p1", "expertise", 25.0), ("p1", "authoritativeness", 50.0), ("p1", "trustworthiness", 70.0), ("p2", "experience", None), ("p2", "expertise", 60.0), ("p2", "other", 99.0), ("p3", "trustworthiness", None), ("p4", "eeat", 56.0), ("p4", "onpage", 80.0), ("p4", "depth", 70.0), ("p4", "ai_readiness", 20.0), ("p4", "freshness", 90.0), ("p5", "citability", 40.0), ("p5", "structure", 90.0), ("p5", "authority", 10.0), ("p5", "access", 100.0), ("p5", "multimodal", 30.0)],
    ),
    "health_signal": (
        "site string, category string, positive int, deficit int, critical int, warnings int",
        [("a.test", "content", 8, 2, 0, 1), ("a.test", "technical", 9, 1, 1, 0), ("a.test", "local", 0, 0, 0, 0), ("b.test", "onpage", 1, 9, 2, 3), ("b.test", "links", 5, 5, 0, 0)],
    ),
    "content_page": (
        "page string, kind string, words int, age_days int, topic string, impressions_year int, impressions int, impressions_before int, clicks int, clicks_before int, backlinks int, outdated boolean",
        [
            ("p1", "blog", 900, 40, "shoes", 900, 100, 200, 10, 20, 3, False), ("p2", "product", 300, 400, "shoes", 50, 80, 80, 9, 9, 0, False), ("p3", "news", 200, 95, "fair", 4, 1, 2, 0, 1, 0, True),
            ("p4", "howto", 2000, 500, "lacing", 4000, 1000, 1000, 40, 90, 8, False), ("p5", "evergreen", 1600, 731, "care", 700, 70, 60, 20, 10, 1, False), ("p6", "about", 399, 10, "us", 9, 3, 3, 1, 1, 2, True), ("p7", "other", 1, 1, None, 1, 0, 0, 0, 0, 0, True), ("p8", "comparison", 1, 365, "best", 90, 90, 100, 9, 9, 0, False),
        ],
    ),
    "channel": ("channel string, sessions int, rate double, order_value double, conversions int, lead_value double, investment double", [("shop", 10000, 0.02, 50.0, None, None, 4000.0), ("leads", None, None, None, 40, 120.0, 6000.0), ("none", 10, 0.1, 1.0, 1, 1.0, 0.0)]),
    "site_count": (
        "site string, submitted int, indexed int, location_pages int, pages_fetched int, analytics boolean, images int, no_alt int, old_format int, oversized int, no_srcset int, no_dimensions int, bad_lcp int",
        [("a.test", 100, 95, 30, 9, True, 40, 4, 10, 2, 20, 1, 0), ("b.test", 100, 90, 31, 9, False, 10, 10, 10, 10, 10, 10, 10), ("c.test", 10, 6, 50, 3, True, 0, 0, 0, 0, 0, 0, 0), ("d.test", 10, 4, 0, 0, False, 3, 1, 1, 1, 1, 1, 1), ("e.test", 0, 0, 49, 4, True, 7, 0, 0, 0, 0, 0, 0)],
    ),
    "missing_url": (
        "url string, moved boolean, wanted boolean, external_only boolean",
        [("https://a.test/search?q={search_term_string}", False, False, False), ("https://a.test/p?color=red", False, False, False), ("https://a.test/old", True, False, False), ("https://a.test/live", False, True, False), ("https://a.test/tpyo", False, False, True), ("https://a.test/gone", False, False, False)],
    ),
    "waste_url": (
        "url string",
        [("https://a.test/p?utm_source=x",), ("https://a.test/p?sort=up&page=2",), ("https://a.test/p?print=1",), ("https://a.test/p?page=2",), ("https://a.test/color=red&size=M",), ("https://a.test/blog/page/47",), ("https://a.test/tag/red/",), ("https://a.test/api/v2/p.json",), ("https://staging.a.test/",), ("https://a.test/",), (None,)],
    ),
    "gap_domain": ("domain string, rating double, relevance double, link_type double, freshness double, replicability double", [("x.org", 90.0, 80.0, 70.0, 60.0, 50.0), ("y.org", 40.0, 50.0, 40.0, 30.0, 20.0), ("z.org", 10.0, 0.0, 5.0, 90.0, 100.0)]),
    "old_url": ("old_url string, visits int, backlinks int", [("/a", 101, 0), ("/b", 3, 6), ("/c", 100, 5), ("/d", 0, 1), ("/e", 0, 0)]),
    "image_size": ("src string, kind string, kilobytes int", [("a", "thumbnail", 29), ("b", "thumbnail", 51), ("c", "content", 150), ("d", "hero", 401), ("e", "background", 800), ("f", "icon", 1)]),
    "page_plan": ("plan string, pages int, unique_share double, reviewed boolean", [("a", 501, 0.9, True), ("b", 10, 0.29, True), ("c", 10, 0.39, True), ("d", 101, 0.8, True), ("e", 5, 0.8, False), ("f", 5, 0.8, True)]),
    "task": ("task string, impact int, ranking int, effort int, week int", [("t1", 9, 8, 3, 1), ("t2", 5, 5, 0, 12), ("t3", 2, 9, 7, 20), ("t4", 1, 1, 1, 40)]),
    "answer_block": ("block string, shape string, words int, items int, longest_item int, columns int", [("b1", "paragraph", 40, None, None, None), ("b2", "paragraph", 61, None, None, None), ("b3", "list", None, 5, 14, None), ("b4", "list", None, 9, 15, None), ("b5", "table", None, None, None, 4), ("b6", "video", None, None, None, None), ("b7", "table", None, None, None, None)]),
    "answer_page": ("url string, status int, title string, body string", [("/a", 200, "Page Not Found", "Sorry: 404."), ("/b", 200, "Shop", "not found"), ("/c", 404, "404", "404"), ("/d", 200, "404", None)]),
    "page_html_hint": ("page_id bigint, html string", [(1, '<link href="/wp-content/a.css"><meta name="generator" content="WordPress 6">'), (2, '<div id="__next"></div><script src="/_next/static/x.js"></script>'), (3, '<script src="https://cdn.shopify.com/x.js"></script>'), (4, "<p>plain</p>"), (5, '<meta content="blogger" name="generator"><a href="https://x.blogspot.com">x</a>'), (6, '<script src="https://static.wixstatic.com/a.js"></script><div data-reactroot></div>')]),
}

LITERALS |= FIXTURES


def literal(spark: SparkSession, name: str) -> DataFrame:
    """A literal table as a DataFrame of one partition."""
    schema, rows = LITERALS[name]
    return spark.createDataFrame(rows, schema).coalesce(1)


_KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def literal_sql(name: str) -> str:
    """The same rows as a parenthesised SQL query."""
    schema, rows = LITERALS[name]
    cols = [c.split() for c in schema.split(", ")]
    text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else repr(v)
    body = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)
    return f"(SELECT {', '.join(f'{n}::{_KINDS[k]} AS {n}' for n, k in cols)} FROM (VALUES {body}) v({', '.join(n for n, _ in cols)}))"
