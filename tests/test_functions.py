"""Column expressions on single values."""

import pytest
from pyspark.sql import functions as F

from pagelattice.functions import html as H
from pagelattice.functions import text as T
from pagelattice.functions import urls as U


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize("base,href,want", [
    ("https://a.test/x/y", "z", "https://a.test/x/z"), ("https://a.test/x/y", "/z", "https://a.test/z"), ("https://a.test/x/y", "//b.test/z", "https://b.test/z"), ("https://a.test", "z", "https://a.test/z"),
    ("https://a.test/x/y", "../z", "https://a.test/z"), ("https://a.test/x/y?q", "?p", "https://a.test/x/y?p"), ("https://a.test/x#f", "#g", "https://a.test/x#g"), ("https://a.test/x", "mailto:m", "mailto:m"),
])
def test_resolve(spark, base, href, want):
    assert one(spark, U.resolve(F.col("b"), F.col("h")), b=base, h=href) == want


@pytest.mark.parametrize("url,want", [("HTTPS://A.test/x//", "https://a.test/x"), ("http://a.test", "http://a.test/"), ("http://a.test/?b=1#c", "http://a.test/?b=1")])
def test_normal_form_is_stable(spark, url, want):
    got = one(spark, U.normal_a(F.col("u")), u=url)
    assert got == want and one(spark, U.normal_a(F.col("u")), u=got) == got


def test_visible_text(spark):
    h = "<html><!-- c --><script>var t=\"</p>\";</script><nav>n</nav><p>a &amp; b<p>c&nbsp;d &copy;</html>"
    assert one(spark, H.visible(F.col("h")), h=h) == "a & b c d"


def test_attributes(spark):
    assert one(spark, H.attr(F.col("t"), "alt"), t='src="x" alt=""') == ""
    assert one(spark, H.attr(F.col("t"), "alt"), t='src="x" data-alt="y"') is None
    assert one(spark, H.attr(F.col("t"), "alt"), t="alt='q' x") == "q"


@pytest.mark.parametrize("word,a,b", [("the", 1, 1), ("table", 1, 1), ("reading", 2, 2), ("a", 1, 1), ("queue", 1, 1), ("beautiful", 3, 3)])
def test_syllables(spark, word, a, b):
    assert one(spark, T.syllables_a(F.col("w")), w=word) == a
    assert one(spark, T.syllables_b(F.col("w")), w=word) == b


def test_shingles(spark):
    assert one(spark, T.shingles(F.split("t", " "), 2), t="a b a b c") == ["a b", "b a", "b c"]
    assert one(spark, T.shingles(F.split("t", " "), 5), t="a b") == ["a b"]


def test_links_of_malformed_pages(spark):
    """By hand: unclosed, nested, quoted and broken links keep their own text."""
    from pagelattice.operators import links

    html = (
        '<p><A HREF="/one">First <b>one</b></a> text <a href="/open">left open <a href=\'two?x=1#f\' rel="noFollow me">Second</a>'
        '<a name="here">no href</a><a href="#top">skip</a><a href="mailto:a@b">skip</a><a\nhref=/bare>Bare</A><a href="http://Other.test/">x</a><a href="/img"><img src="i"></a><abbr>no link</abbr><a href="/cut"'
    )
    page = spark.createDataFrame([(1, "https://s.test/d/p", html), (2, "https://s.test/", None)], "page_id long, url string, html string")
    got = [(r.target, r.anchor, r.nofollow, r.internal) for r in links.raw_links(page).orderBy("pos").collect()]
    assert got == [
        ("https://s.test/one", "First one", False, True),
        ("https://s.test/open", "left open", False, True),
        ("https://s.test/d/two?x=1#f", "Second", True, True),
        ("https://s.test/bare", "Bare", False, True),
        ("http://Other.test/", "x", False, False),
        ("https://s.test/img", "[no text]", False, True),
    ]
