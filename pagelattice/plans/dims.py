"""Fixed dimensions: values that rules are stated in. Small enough to be literals of a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Severities by rank; the lower the stronger.
SEVERITY = {"critical": 0, "high": 1, "warning": 2, "medium": 3, "low": 4, "info": 5, "pass": 6}
SEVERITY_FOUR = {"Critical": 0, "Warning": 1, "Info": 2, "Pass": 3}

#: Crawlers of AI services.
AI_CRAWLERS = ("OAI-SearchBot", "GPTBot", "ChatGPT-User", "ClaudeBot", "anthropic-ai", "PerplexityBot", "Google-Extended", "Applebot-Extended", "Bytespider", "CCBot", "FacebookBot", "Amazonbot")

#: Response headers and their weights; 25 more for HTTPS.
SECURITY_HEADERS = {"hsts": 20, "csp": 15, "xfo": 10, "xcto": 10, "referrer": 10, "permissions": 10}

#: Tag, required, least and most characters, allowed values.
SOCIAL_TAGS = (
    ("og:title", True, 10, 60, None), ("og:description", True, 50, 200, None), ("og:image", True, None, None, None), ("og:url", True, None, None, None), ("og:type", True, None, None, None), ("og:site_name", False, None, None, None), ("og:locale", False, None, None, None),
    ("twitter:card", True, None, None, "summary|summary_large_image|app|player"), ("twitter:title", False, None, 70, None), ("twitter:description", False, None, 200, None), ("twitter:image", False, None, None, None), ("twitter:site", False, None, None, None), ("twitter:creator", False, None, None, None),
)

#: Platforms of sameAs links, substring of the host, priority.
PLATFORMS = (
    ("wikidata", "wikidata.org", "critical"), ("wikipedia", "wikipedia.org", "critical"), ("linkedin", "linkedin.com", "critical"), ("crunchbase", "crunchbase.com", "high"), ("x", "x.com", "medium"), ("twitter", "twitter.com", "medium"),
    ("facebook", "facebook.com", "medium"), ("youtube", "youtube.com", "medium"), ("github", "github.com", "medium"), ("instagram", "instagram.com", "low"),
)

#: Language codes, region codes and frequent mistakes of hreflang values.
LANGUAGES = (
    "af", "sq", "am", "ar", "hy", "as", "az", "eu", "be", "bn", "bs", "bg", "ca", "ceb", "zh", "co", "hr", "cs", "da", "nl",
    "en", "eo", "et", "fi", "fr", "fy", "gl", "ka", "de", "el", "gu", "ht", "ha", "haw", "he", "hi", "hu", "is", "ig", "id",
    "ga", "it", "ja", "jv", "kn", "kk", "km", "rw", "ko", "ku", "ky", "lo", "la", "lv", "lt", "lb", "mk", "mg", "ms", "ml", "mt",
    "mi", "mr", "mn", "my", "ne", "no", "ny", "or", "ps", "fa", "pl", "pt", "pa", "ro", "ru", "sm", "gd", "sr", "st", "sn", "sd",
    "si", "sk", "sl", "so", "es", "su", "sw", "sv", "tl", "tg", "ta", "tt", "te", "th", "tr", "tk", "uk", "ur", "ug", "uz", "vi",
    "cy", "xh", "yi", "yo", "zu",
)
LANGUAGE_MISTAKES = {"eng": "en", "jp": "ja", "zh-cn": "zh-Hans", "zh-tw": "zh-Hant", "iw": "he", "in": "id"}
REGIONS = (
    "AF", "AL", "DZ", "AD", "AO", "AG", "AR", "AM", "AU", "AT", "AZ", "BS", "BH", "BD", "BB", "BY", "BE", "BZ", "BJ", "BT", "BO",
    "BA", "BW", "BR", "BN", "BG", "BF", "BI", "CV", "KH", "CM", "CA", "CF", "TD", "CL", "CN", "CO", "KM", "CG", "CD", "CR", "CI",
    "HR", "CU", "CY", "CZ", "DK", "DJ", "DM", "DO", "EC", "EG", "SV", "GQ", "ER", "EE", "SZ", "ET", "FJ", "FI", "FR", "GA", "GM",
    "GE", "DE", "GH", "GR", "GD", "GT", "GN", "GW", "GY", "HT", "HN", "HU", "IS", "IN", "ID", "IR", "IQ", "IE", "IL", "IT", "JM",
    "JP", "JO", "KZ", "KE", "KI", "KP", "KR", "KW", "KG", "LA", "LV", "LB", "LS", "LR", "LY", "LI", "LT", "LU", "MG", "MW", "MY",
    "MV", "ML", "MT", "MH", "MR", "MU", "MX", "FM", "MD", "MC", "MN", "ME", "MA", "MZ", "MM", "NA", "NR", "NP", "NL", "NZ", "NI",
    "NE", "NG", "NO", "OM", "PK", "PW", "PA", "PG", "PY", "PE", "PH", "PL", "PT", "QA", "RO", "RU", "RW", "KN", "LC", "VC", "WS",
    "SM", "ST", "SA", "SN", "RS", "SC", "SL", "SG", "SK", "SI", "SB", "SO", "ZA", "SS", "ES", "LK", "SD", "SR", "SE", "CH", "SY",
    "TW", "TJ", "TZ", "TH", "TL", "TG", "TO", "TT", "TN", "TR", "TM", "TV", "UG", "UA", "AE", "GB", "US", "UY", "UZ", "VU", "VE",
    "VN", "YE", "ZM", "ZW", "HK", "MO", "PR", "GU", "VI", "AS",
)
REGION_MISTAKES = {"UK": "GB", "LA": None, "EU": None}

#: Structured-data types by status.
SCHEMA_STATUS = {
    "SpecialAnnouncement": "retired", "CourseInfo": "retired", "EstimatedSalary": "retired", "LearningVideo": "retired", "ClaimReview": "retired", "VehicleListing": "retired", "PracticeProblem": "retired", "Dataset": "retired",
    "HowTo": "no_rich_result", "FAQPage": "restricted",
}
PLACEHOLDERS = ("[Business Name]", "[City]", "[State]", "[Phone]", "[Address]", "[Your", "[INSERT", "REPLACE", "[URL]", "[Email]")

#: Fixed values: (rule, tier, kind, pattern or threshold) of toxic links.
TOXIC_RULES = (
    ("pbn_low_dr", "high", "low_dr_follow", "10"), ("exact_anchor_spam", "high", "repeat_anchor", "5"), ("all_same_anchor", "high", "uniform_anchor", "3"),
    ("gambling_tld", "high", "domain", "casino|poker|slot[s]?|betting|gambl"), ("pharma_tld", "high", "domain", "viagra|cialis|pharma|pill[s]?|drug[s]?store"), ("adult_tld", "high", "domain", "xxx|porn|adult|webcam"),
    ("comment_spam_click_here", "medium", "anchor", "^click here$|^visit website$|^check this$|^read more$|^visit site$|^go here$|^check this out$|^see more$|^website$"),
    ("irrelevant_tld_mismatch", "medium", "tld", ".ru|.cn|.tk|.pw|.cc|.cf|.ga|.gq|.ml"), ("free_hosting_domain", "medium", "domain", r"blogspot\.|wordpress\.com|weebly\.com|tumblr\.com|wixsite\.com|jimdo\.com"),
    ("footer_sidebar_link", "medium", "anchor", "sponsored|partner|advertis"), ("numeric_domain", "medium", "domain", r"^\d{4,}"), ("excessive_hyphens", "medium", "domain", ".*-.*-.*-.*-"), ("very_long_domain", "medium", "long_domain", "40"),
    ("directory_submission", "medium", "domain", "directory|linkdir|submitlink|addurl|freesubmit"), ("exact_match_domain", "medium", "emd_low_dr", "20"), ("reciprocal_pattern", "medium", "anchor", "link exchange|reciprocal|trade links|link partner"),
)
GENERIC_ANCHORS = ("click here", "read more", "visit website", "learn more", "check this out", "this article", "here", "website", "visit site", "go here", "see more", "more info", "source", "link", "this", "great resource")

#: Good and poor limits of web vitals.
VITALS = {"LCP": (2500.0, 4000.0), "INP": (200.0, 500.0), "CLS": (0.1, 0.25)}

#: Weights of report sections; they need not sum to 100.
SECTION_WEIGHTS = {
    "security": 8, "social": 5, "robots": 8, "broken_links": 10, "internal_links": 8, "redirects": 3, "llms_txt": 5, "pagespeed": 13, "onpage": 10, "readability": 8, "entity": 5, "link_profile": 7, "hreflang": 5,
    "duplicate_content": 5, "programmatic_seo": 4, "schema_validation": 5, "image_seo": 3, "canonical": 7, "sitemap": 3, "local_signals": 3, "indexnow_probe": 2,
}
#: Weights of a backlink profile's components.
HEALTH_WEIGHTS = {"referring_domain_count": 0.20, "domain_quality": 0.20, "toxic_ratio": 0.20, "anchor_naturalness": 0.15, "geographic_relevance": 0.10, "velocity": 0.10, "follow_ratio": 0.05}

#: Evidence of a page's platform: (platform, substring of the page in lower case, points).
PLATFORM_SIGNALS = (
    ("wordpress", "/wp-content/", 4), ("wordpress", "wordpress", 3), ("shopify", "cdn.shopify.com", 5), ("wix", "wixstatic.com", 5), ("squarespace", "squarespace", 4), ("webflow", "webflow", 4), ("blogger", "blogspot.com", 3), ("blogger", "blogger", 3),
    ("nextjs", "/_next/", 4), ("nextjs", "__next", 3), ("react", "data-reactroot", 3), ("nuxt", "__nuxt", 4),
)


def dim(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A dimension as a DataFrame of one partition."""
    return spark.createDataFrame(list(rows), schema).coalesce(1)


def values_sql(rows, names: str, kinds: tuple) -> str:
    """The same dimension as SQL."""
    lit = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else repr(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    cols = names.split(", ")
    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return f"(SELECT {', '.join(f'{n}::{k} AS {n}' for n, k in zip(cols, kinds, strict=True))} FROM (VALUES {body}) v({names}))"


#: Weights of the parts of indexes.
EEAT_WEIGHTS = {"experience": 0.20, "expertise": 0.25, "authoritativeness": 0.25, "trustworthiness": 0.30}
CONTENT_WEIGHTS = {"eeat": 0.35, "onpage": 0.25, "depth": 0.20, "ai_readiness": 0.10, "freshness": 0.10}
ANSWER_WEIGHTS = {"citability": 0.25, "structure": 0.20, "authority": 0.20, "access": 0.20, "multimodal": 0.15}
CATEGORY_WEIGHTS = {"content": 22.0, "technical": 18.0, "onpage": 15.0, "links": 12.0, "schema": 10.0, "vitals": 8.0, "ai_readiness": 8.0, "images": 4.0, "local": 3.0}
GAP_WEIGHTS = {"rating": 0.30, "relevance": 0.25, "link_type": 0.20, "freshness": 0.15, "replicability": 0.10}
#: Least words by type of page, days after which content is due and stale, kilobytes of images (target, warning, stop), points of image faults.
WORD_FLOORS = {"blog": 1500, "service": 800, "home": 500, "product": 300, "about": 400, "location": 500}
FRESHNESS_DAYS = {"news": (30, 90), "data": (180, 365), "howto": (365, 545), "comparison": (365, 365), "evergreen": (545, 730), "technical": (180, 365), "trends": (365, 365)}
IMAGE_KILOBYTES = {"thumbnail": (30, 50, 100), "content": (100, 150, 200), "hero": (200, 300, 400), "background": (300, 500, 800)}
IMAGE_POINTS = {"no_alt": 30, "old_format": 20, "oversized": 20, "no_srcset": 15, "no_dimensions": 10, "bad_lcp": 5}
#: Classes of URLs that waste crawls, the first that fits, by a pattern of the URL in lower case.
CRAWL_WASTE = (
    ("session", r"[?&](utm_[a-z]+|sessionid|sid|phpsessid|gclid|fbclid)="),
    ("sort", r"[?&](sort|order|orderby)="),
    ("print", r"[?&]print="),
    ("scroll", r"[?&](page|offset)="),
    ("facet", r"[?&/](color|size|brand|price|filter)="),
    ("archive_page", r"/page/[0-9]+"),
    ("tag", r"/(tag|category)/"),
    ("api", r"/api/"),
    ("staging", r"^https?://(staging|dev|test)\."),
)
#: What pages say that answer 200 for nothing.
SOFT_404 = ("page not found", "404", "not found", "page doesn't exist", "no longer available")

#: Phrases of menus, types of entities, patterns of phone numbers and streets.
MENU_PHRASES = (
    "read more", "recent posts", "older posts", "subscribe to", "comments (atom)", "labels", "search for a post", "widget",
    "your browser does not support javascript",
)
ENTITY_TYPES = (
    "Organization", "Person", "Corporation", "LocalBusiness", "Brand", "MedicalOrganization", "EducationalOrganization", "GovernmentOrganization",
)
PHONE = r"[+]?[0-9\-() ]{7,15}"
STREET = r"(?i)[0-9]{1,5} +[a-z0-9_]+ +(street|st|avenue|ave|road|rd|blvd|drive|dr|lane|ln)"
#: Paths where sitemaps are tried, and what titles of missing pages say to link checks.
SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/wp-sitemap.xml", "/sitemap1.xml")
SOFT_404_OF_LINKS = (
    "page not found", "404", "not found", "no longer available", "does not exist", "doesn't exist", "has been removed", "page has moved", "no results found",
)
#: Where a fix is made, by platform and area.
FIX_PLACES = {
    "Blogger": {"metadata": "theme HTML, head", "heading": "post template", "headers": "proxy in front", "llms": "proxy route", "links": "posts and gadgets", "performance": "theme gadgets"},
    "WordPress": {"metadata": "SEO plugin", "heading": "theme template", "headers": "web server or CDN", "llms": "web root", "links": "menus and posts", "performance": "cache plugin"},
    "Next.js": {"metadata": "metadata export", "heading": "route component", "headers": "next.config headers", "llms": "public folder", "links": "route components", "performance": "image and script components"},
    "Nuxt": {"metadata": "useHead", "heading": "route component", "headers": "server routes", "llms": "public folder", "links": "route components", "performance": "image and script components"},
    "other": {"metadata": "page template", "heading": "page template", "headers": "web server or CDN", "llms": "web root", "links": "pages and menus", "performance": "assets and scripts"},
}
#: Weights of citation, identity, trust, eminence by kind of domain; weights and quartiles of referring domains for link health.
DOMAIN_WEIGHTS = {
    "default": (0.35, 0.20, 0.25, 0.20), "publisher": (0.40, 0.15, 0.20, 0.25), "service": (0.25, 0.30, 0.25, 0.20), "shop": (0.20, 0.20, 0.35, 0.25),
    "community": (0.35, 0.10, 0.25, 0.30), "tool": (0.25, 0.30, 0.25, 0.20), "institution": (0.45, 0.20, 0.20, 0.15),
}
LINK_HEALTH_WEIGHTS = {"domains": 0.20, "quality": 0.20, "toxic": 0.20, "anchors": 0.15, "places": 0.10, "velocity": 0.10, "follow": 0.05}
DOMAIN_QUARTILES = {"local": (20, 80, 250), "saas": (100, 500, 2000), "shop": (200, 1000, 5000), "publisher": (500, 3000, 15000), "enterprise": (1000, 8000, 50000)}
#: Signs of kinds of business in URL and HTML in lower case, in the order that settles ties; paths of pages that only serve a task.
BUSINESS_SIGNS = (
    ("saas", "/pricing|/features|free trial"),
    ("shop", '/products|"product"|add to cart'),
    ("local", "tel:|service area|google[.]com/maps"),
    ("publisher", "byline|/category/|<article"),
    ("agency", "/case-studies|client logos|/portfolio"),
)
TASK_PATHS = r"/(sign-?up|sign-?in|log-?in|register|create-account|forgot-password|reset-password|join|enroll|checkout|cart|account|profile|settings)([/?#.]|$)"
#: Weights of the dimensions of a blog post's items.
ITEM_WEIGHTS = {"C": 0.15, "O": 0.10, "R": 0.10, "E": 0.10, "T": 0.15}
