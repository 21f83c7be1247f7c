"""Literal tables of the article and audit rules: small, fixed, and chosen to reach every branch of a rule."""

from __future__ import annotations

FIXTURES: dict[str, tuple[str, list[tuple]]] = {
    "article_fact": (
        "page_id bigint, title string, description string, h1s bigint, words bigint, author string, published string, images_without_alt bigint, images_not_lazy bigint, schemas string, reading_ease double",
        [
            (1, "A title of a length that suits results", "d" * 120, 1, 1200, "A. Writer", "2024-05-01", 0, 0, "active", 55.0),
            (2, None, None, 0, 299, None, None, 2, 4, None, 12.5),
            (3, "Short", "too short", 2, 300, "", "", 0, 3, "active deprecated", 30.0),
            (4, "t" * 66, "d" * 166, 1, 999, "B", None, None, None, "restricted", None),
            (5, "t" * 65, "d" * 165, 1, 1000, "B", "2024", 1, 5, "", 29.9),
        ],
    ),
    "near_pair": (
        "url_a string, url_b string, similarity double",
        [
            ("https://a.test/x", "https://a.test/y/", 0.91), ("https://a.test/x", "https://a.test/z", 0.88), ("https://a.test/s", "https://a.test/w", 0.86),
            ("https://a.test/q", "https://a.test/x", 0.95), ("https://a.test/x", "https://nowhere.test/", 0.9),
        ],
    ),
    "template_count": ("site string, critical bigint, warnings bigint", [("a", 1, 0), ("a", 0, 2), ("b", 0, 2), ("b", 0, 2), ("c", 0, 3), ("d", 0, 0)]),
    "site_metrics": (
        "site string, platform string, title string, description string, h1s bigint, headers_missing bigint, has_llms boolean, broken bigint, soft_404 bigint, sitemap_404 bigint, sitemap_soft_404 bigint, sitemap_templates bigint, "
        "sitemap_searches bigint, canonical_critical bigint, canonical string, redirected bigint, template_critical bigint, template_warnings bigint, alternates bigint, broken_pages bigint, soft_404_pages bigint, card_tags_missing bigint, "
        "speed_failed boolean, reading_ease double, sentence_length double",
        [
            ("clean.test", "WordPress", "t" * 40, "d" * 140, 1, 0, True, 0, 0, 0, 0, 0, 0, 0, "https://clean.test/", 0, 0, 0, 0, 0, 0, 0, False, 60.0, 18.0),
            ("worst.test", "Blogger", None, None, 0, 6, False, 7, 1, 2, 1, 1, 1, 3, None, 6, 2, 9, 12, 1, 1, 3, True, 12.0, 31.0),
            ("mild.test", "Next.js", " short ", "d" * 109, 1, 3, None, 1, None, None, None, None, 2, 0, None, 4, 0, 3, 9, None, None, None, None, 39.9, None),
            ("null.test", *[None] * 24),
            ("nuxt.test", "Nuxt", "t" * 66, "d" * 171, 2, 4, True, 5, 0, 0, 0, 0, 0, 0, "x", 5, 0, 2, 10, 0, 0, 0, False, 40.0, 25.1),
        ],
    ),
    "site_runtime": ("site string, platform string, runtime string", [("a", "Next.js", None), ("b", "WordPress", "PHP"), ("c", None, "JavaScript app"), ("d", None, None), ("e", "Nuxt", "node")]),
    "site_key": ("site string, key string", [("a", "abcdefghijkl"), ("b", "12345678"), ("c", "123456789"), ("d", None), ("e", "")]),
    "sitemap_alternates": (
        "host string, url string, xml string",
        [
            ("a.test", "https://a.test/sitemap.xml", '<urlset xmlns:xhtml="x"><xhtml:link hreflang="fr" href="/f"/><xhtml:link hreflang="de" href="/d"/><xhtml:link hreflang="fr" href="/g"/></urlset>'),
            ("b.test", "https://b.test/sitemap.xml", "<urlset></urlset>"), ("c.test", "https://c.test/sitemap.xml", None),
        ],
    ),
    "domain_rating": (
        "domain string, kind string, citation double, identity double, trust double, eminence double, vetoed boolean",
        [
            ("a.test", "default", 90.0, 95.0, 92.5, 91.0, False), ("b.test", "shop", 80.0, 70.0, 75.0, None, False), ("c.test", "publisher", 85.0, 60.0, 90.0, 70.0, True),
            ("d.test", "tool", None, None, None, None, False), ("e.test", "institution", 20.0, 45.0, 10.0, 5.0, True), ("f.test", "community", 60.0, 61.0, 59.0, 62.5, None),
        ],
    ),
    "recognition_answer": (
        "entity string, question bigint, system string, points bigint",
        [
            *((e, i % 4, f"s{i // 4}", p) for e, p in (("strong", 3), ("some", 2), ("weak", 1), ("none", 0)) for i in range(16)),
            ("odd", 0, "s0", 7), ("odd", 1, "s0", None), ("odd", 2, "s0", -1),
        ],
    ),
    "review_stat": (
        "site string, stars double, reviews bigint, days_since bigint, answered double",
        [("a", 4.3, 50, 30, 0.81), ("b", 4.29, 49, 31, 0.8), ("c", 4.0, 20, 90, 0.5), ("d", 3.99, 19, 91, 0.49), ("e", None, None, None, None)],
    ),
    "business_page": (
        "url string, html string",
        [
            ("https://s.test/pricing", "<p>Start your free trial</p>"), ("https://s.test/blog", "<article>x</article>"), ("https://s.test/features", None),
            ("https://p.test/category/a", "<article><span class=byline>B</span></article>"), ("https://l.test/", '<a href="tel:1">call</a>'),
            ("https://c.test/case-studies/1", ""), ("https://o.test/products/7", "add to cart"), ("https://n.test/", ""), ("https://t.test/pricing", "add to cart"),
        ],
    ),
    "task_page": (
        "page_id bigint, url string, html string",
        [
            (1, "https://a.test/login", "<p>in</p>"), (2, "https://a.test/about", "<p>few words</p>"), (3, "https://a.test/Cart?x=1", ""),
            (4, "https://a.test/cartography", None), (5, "https://a.test/guide", "<p>" + "word " * 400 + "</p>"),
        ],
    ),
    "passage": (
        "doc_id bigint, text string",
        [
            (1, "What is it?\n" + "word " * 100 + "\nIt is " + "word " * 120), (2, "w " * 99 + "\n" + "w " * 200 + "\n" + "w " * 201), (3, None), (4, ""),
            (5, "Title \t?\n\n" + "Italy " * 150 + "\nWhy? \n" + "Some " * 101),
        ],
    ),
    "link_stat": (
        "site string, kind string, domains bigint, strong_domains bigint, toxic_share double, anchor_score double, target_share double, variation double, follow_share double",
        [
            ("a", "local", 250, 100, 0.0, 90.0, 0.8, 0.3, 0.75), ("b", "saas", 500, 50, 0.05, 60.0, 0.5, 0.9, 0.95), ("c", "shop", 10, 0, 0.2, 10.0, 0.1, 2.0, 0.3),
            ("d", "enterprise", 0, 0, 0.15, 0.0, 0.0, 1.5, 0.0), ("e", "publisher", 12000, 7000, 0.01, 80.0, 0.9, 0.5, 0.66),
        ],
    ),
    "noise_text": (
        "doc_id bigint, text string",
        [
            (1, "Read more. A plain sentence of prose here. One\ntwo\nthree. 12 34."), (2, " ".join(f"{a}{b}" for a in "abcdef" for b in "vwxyz") + ". The end is the end of the end."),
            (3, None), (4, "Search for a Post! Older posts? Fine words stay."),
        ],
    ),
    "entity_html": (
        "page_id bigint, html string",
        [
            (1, '<title>Shop | Home</title><script type="application/ld+json">{"@context":"https://schema.org","@type":"Organization","name":"Acme","url":"https://acme.test","sameAs":["https://a","https://b"]}</script><p>1 Main Street, call +1 (555) 123-4567</p>'),
            (2, '<meta property="og:site_name" content="Site Name"><title>T - x</title><script type="application/ld+json">{"@type":"Article","name":"n"}</script>'),
            (3, '<title> Only title - rest</title><script type="application/ld+json">{"@type":"Person","sameAs":"https://one"}</script><p>no contact</p>'),
            (4, None), (5, "<p>22 elm ave</p>"),
        ],
    ),
}
