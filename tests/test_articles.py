"""Articles parsed from nested HTML by hand-made expectations, audits over all detectors, and the command line."""

import numpy as np
import pytest

from pagelattice import __main__ as cli
from pagelattice.operators import articles, audits, documents

LONG = "one two three four five six seven eight nine"
PAGES = [
    # containers within containers: the outer one ends after the inner one, and what follows it is no part of the article
    (1, "https://a.test/1", f'<body class="wp-site"><div class="entry-content"><div><p>{LONG}</p></div><h1>Head <b>line</b></h1><p>too short</p><img src="a" alt=""><img src="b" alt="x" loading="lazy"></div>'
        f'<p>{LONG} outside</p><span class="byline">Ann <i>Author</i></span><time class="entry-date" datetime="2024-05-01">May</time><div class="cat-links"><a>News</a><a> </a></div></body>'),
    (2, "https://b.blogspot.com/2", f'<div itemprop="articleBody"><p>{LONG}<p>{LONG} again</div><a class="label-link">L1</a><meta itemprop="datePublished" content="2023-01-02">'),
    (3, "https://c.test/3", f"<main><article><p>{LONG}</p></article></main><script>var x = '<p>{LONG}</p>'</script>"),
    (4, "https://d.test/4", '<meta name="generator" content="Ghost 5"><section class="gh-content"><h1>G</h1><div>open'),
    (5, None, None),
    (6, "https://e.test/6", "</div><<p>>&lt;b&gt; " + "x" * 200_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def test_article_facts(pages):
    got = {r.page_id: r for r in articles.article_facts(pages.withColumnRenamed("page_id", "PAGE_ID").selectExpr("PAGE_ID as page_id", "url", "html", "1 as title")).collect()}
    one = got[1]
    assert (one.platform, one.container, one.author, one.published, one.labels) == ("wordpress", "div", "Ann Author", "2024-05-01", ["News"])
    assert one.h1 == ["Head line"] and one.paragraphs == [LONG] and (one.images, one.images_without_alt, one.images_not_lazy) == (2, 1, 1)
    assert (got[2].platform, got[2].labels, got[2].published) == ("blogger", ["L1"], "2023-01-02") and len(got[2].paragraphs) == 2
    assert (got[3].platform, got[3].container, got[3].paragraphs) == ("generic", "article", [LONG])
    assert (got[4].platform, got[4].container, got[4].h1) == ("ghost", "section", ["G"])
    assert got[5].platform == "generic" and got[5].container is None and got[5].paragraphs == [] and got[6].page_id == 6


def test_no_pages(spark, pages):
    assert articles.article_facts(pages.limit(0)).count() == 0


def test_audit_counts_pages_of_every_detector(pages):
    got = {(r.site, r.section, r.code): r.pages for r in audits.audit_findings(pages.where("page_id < 5")).collect()}
    assert got[("a.test", "content", "thin_content")] == 1 and got[("d.test", "onpage", "title_missing")] == 1
    only = audits.audit_findings(pages, ("content",)).select("section").distinct().collect()
    assert [r.section for r in only] == ["content"]


@pytest.mark.parametrize("kind", ["parquet", "json", "csv"])
def test_command_line(spark, pages, tmp_path, kind):
    pages.write.parquet(str(tmp_path / "pages"))
    cli.main(["article", "--pages", str(tmp_path / "pages"), "--out", str(tmp_path / "out"), "--format", kind])
    read = spark.read.parquet if kind == "parquet" else spark.read.text
    assert read(str(tmp_path / "out" / "facts")).count() == 6 + (0 if kind != "csv" else spark.read.text(str(tmp_path / "out" / "facts")).where("value like 'page_id,%'").count())
    assert not (tmp_path / "out" / "keywords").exists()  # its table was not given


def test_command_without_its_tables(spark, tmp_path):
    with pytest.raises(ValueError, match="pages"):
        cli.run(spark, "schema", {}, str(tmp_path))


def test_every_command_names_known_tables():
    for sheets in cli.COMMANDS.values():
        for operator, tables in sheets.values():
            assert callable(operator) and tables


def test_near_pairs_stand_on_classes(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    text = " ".join(words)
    near = " ".join([*words[:-1], "other"])  # one shingle of 196 differs
    rows = [(5, text), (2, text.upper()), (9, text + "!"), (7, near), (1, "a text of its own with nothing in common"), (3, None), (4, "12 34")]
    got = {(r.a, r.b): r.similarity for r in documents.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # 5 has the text of 2 but for case, so it is an exact copy; 9 has other characters but the same words
    assert set(got) == {(2, 7), (2, 9)} and got[(2, 9)] == 1.0 and 0.85 <= got[(2, 7)] <= 1.0
    assert documents.near_pairs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_residues():
    x = np.array([0, 1, documents.PRIME - 1, documents.PRIME, documents.PRIME + 1, 2 * documents.PRIME, documents.PRIME**2, (1 << 62) - 1], dtype=np.int64)
    assert (documents._residues(x) == x % documents.PRIME).all()


def test_boilerplate_by_hand(spark):
    rows = [(i, "s", "a b c d e f " + "xyz"[i]) for i in range(3)] + [(9, "t", None), (8, "s", "")]
    got = {r.source: tuple(r)[1:] for r in documents.boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string"), share=0.75).collect()}
    # of the three shingles of a text of seven words two are common to 3 of 4 texts
    assert got == {"s": (4, 2, 0.6667), "t": (1, 0, 0.0)}
