"""The audit in one pass: hand expectations, SQL on pages that have what crawled tables lack, one scan, isolated detectors."""

import duckdb
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from pagelattice import catalog
from pagelattice.operators import page_audit

WORDS = "Short words make an easy line here. " * 60
GOOD = f"""<html lang="en"><head><title>A title that is between thirty and sixty</title><meta name="description" content="{'d' * 130}"><link rel="canonical" href="https://a.test/good">
<meta property="og:title" content="A fine title"><meta property="og:description" content="{'x' * 60}"><meta property="og:image" content="https://a.test/i.png"><meta property="og:url" content="https://a.test/good"><meta property="og:type" content="article"><meta name="twitter:card" content="summary">
<link rel="alternate" hreflang="en" href="https://a.test/good"><link rel="alternate" hreflang="x-default" href="https://a.test/good/">
<script type="application/ld+json">{{"@context": "https://schema.org", "@type": "Organization", "name": "A", "sameAs": ["https://x.com/a"]}}</script></head>
<body><h1>Head</h1><p>{WORDS}</p><img src="/a.webp" alt="a" fetchpriority="high" srcset="a 1x" sizes="1px" width="1" height="1"><a href="/b">b</a><a href="c">c</a><a href="/d?x=1#y">d</a></body></html>"""
BAD = """<title>404</title><title>Page not found</title><meta name=robots content="noindex"><link rel=canonical href="/Other_page/"><link rel="canonical" href="http://www.b.test/z">
<link rel="alternate" hreflang="eng" href="http://b.test/en"><link rel="alternate" hreflang="zh" href="https://b.test/zh"><link rel="alternate" hreflang="de-UK" href="https://b.test/de"><link rel="alternate" hreflang="x-default" href="/x"><link rel="alternate" hreflang="X-Default" href="/y">
<script type="application/ld+json">{"@context": "https://schema.org", "@graph": [{"@type": "FAQPage"}, {"@type": "Person", "name": "[Your name]"}, {"name": "none"}]}</script><script type="application/ld+json">{broken</script>
<script type="application/ld+json">[{"@type": "HowTo"}, {"@context": "http://other.test", "@type": "Dataset"}]</script><a href="tel:1">call</a>
<h1>x</h1><h1>y</h1><a href="../q/./r" rel="nofollow"></a><a href="mailto:a@b.test">m</a><img src="p.JPG?x" loading="lazy"><img src="q.png" alt="" srcset="q 2x" width="1" height="2"><a href="//b.test/u">u</a><a href='https://o.test/'>o</a>
<p>Extraordinarily complicated organisational considerations necessitate multidisciplinary interdepartmental collaboration; notwithstanding administrative responsibilities, individuals characteristically underestimate communication difficulties encountered internationally throughout implementation activities regarding sophisticated telecommunication infrastructure.</p>"""
PAGES = [(1, "https://a.test/good", GOOD), (2, "https://b.test/Dir_a/page.html?sort=1", BAD), (3, "http://c.test/{x}", None), (4, "https://c.test/?q=a", ""), (5, "https://a.test/good/", GOOD.replace('alt="a"', "")), (6, "https://c.test/" + "u" * 100, "<a href='#'>no</a>" + "".join(f"<a href='/{i}'>l</a>" for i in range(120)))]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def codes(df, page):
    return {r.code for r in df.where(F.col("page_id") == page).collect()}


def test_findings_by_hand(pages):
    f = page_audit.findings(pages)
    assert codes(f, 1) == set()
    assert codes(f, 5) == {"canonical_slash_mismatch", "alt_missing"}
    assert codes(f, 2) == {
        "title_short", "title_repeated", "description_missing", "h1_repeated", "thin_content", "soft_404_title", "url_facet", "url_upper_case", "url_underscore", "canonical_several", "canonical_relative", "canonical_other_page",
        "canonical_noindex_conflict", "alternates_without_self", "alternates_several_defaults", "alternates_mixed_protocols", "alternates_bad_code", "links_few", "links_nofollow", "links_without_text", "hard_to_read", "long_sentences", "invalid_json",
        "context_missing", "context_unknown", "type_missing", "placeholder", "type_retired", "type_no_rich_result", "type_restricted", "same_as_missing", "open_graph_incomplete", "card_incomplete", "alt_missing", "first_image_lazy",
        "first_image_without_priority", "first_image_without_srcset", "sizes_missing", "raster_images", "dimensions_missing", "local_business_missing",
    }
    assert codes(f, 3) == codes(page_audit.findings(pages.where("page_id = 3").withColumn("title", F.lit(1)).withColumn("h", F.lit(2))), 3)
    assert {"no_https", "url_template", "links_none", "no_images", "entity_missing", "thin_content", "title_missing", "canonical_missing"} <= codes(f, 3)
    assert {"url_search"} <= codes(f, 4) and {"links_many", "url_too_long"} <= codes(f, 6) and "links_few" not in codes(f, 6)
    assert {r.severity for r in f.where("code = 'alt_missing' and page_id = 5").collect()} == {"high"}


def test_sql_on_rich_pages(spark, pages, tmp_path):
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in catalog.QUERIES["audit_findings"](spark, str(tmp_path)).collect())
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(tuple(r) for r in c.execute(f"select site, section, code, severity, pages from ({catalog.ORACLES['audit_findings']})").fetchall())
    assert got == want and len({r[2] for r in got}) > 50


def test_one_scan_and_no_join(spark, pages, tmp_path):
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    df = page_audit.audit_findings(spark.read.parquet(str(tmp_path / "pages.parquet")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "Union" not in plan and "Python" not in plan


def test_a_detector_that_fails_leaves_the_others(pages):
    broken = {"content": page_audit.content, "gone": lambda p: [("x", "info", F.col("no_such_column"))], "bug": lambda p: [("x", "info", F.lit(True) & {}["k"])]}
    got = {(r.section, r.code, r.page_id) for r in page_audit.findings(pages, detectors=broken).collect()}
    assert {s for s, c, _ in got if c == "detector_failed"} == {"gone", "bug"} and ("content", "thin_content", 3) in got


def test_observed(pages):
    watch = Observation("audit")
    page_audit.audit_findings(pages, watch=watch).collect()
    assert watch.get["pages"] == len(PAGES) and watch.get["pages_with_objects"] == 3


def test_no_pages(pages):
    assert page_audit.audit_findings(pages.limit(0)).count() == 0


def test_syllables_in_one_string_equal_those_by_word(spark):
    text = "The eagle rhythm e be bee xyz whale Able, naïve x1 a_b gee queue strengths hmm tree_ on e. Eeee nth the THE aye cwm-fjord 日本 able"
    df = spark.createDataFrame([(1, "https://a.test/", f"<p>{text}</p>"), (2, "https://a.test/", "<p>e</p>"), (3, "https://a.test/", "")], "page_id long, url string, html string")
    from pagelattice.functions import text as T

    got = {r.page_id: (r.n_letters, r.syllables, r.words) for r in page_audit.parsed(df).select("page_id", "n_letters", "syllables", "words").collect()}
    words = F.filter(T.words(F.lit(text)), lambda w: w.rlike("^[a-zA-Z]+$"))
    want = spark.range(1).select(F.size(words), T.total(F.transform(words, T.syllables_a)), F.size(T.words(F.lit(text)))).first()
    assert got == {1: tuple(want), 2: (1, 1, 1), 3: (0, 0, 0)}
