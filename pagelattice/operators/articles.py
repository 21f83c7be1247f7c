"""Articles: the article's own part of a page, its rules, prose against navigation, entities of structured data.

What nests (containers within containers) is read by a parser in Arrow batches; all else is a narrow projection.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..plans import dims
from ..plans.stage import in_batches
from .pages import json_ld, meta_first, metas, rules

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Of each platform where the article is: (attribute or None for the element's name, pattern), the first that is found.
CONTAINERS = {
    "blogger": (("itemprop", "^articleBody$"), ("class", "post-body|entry-content")),
    "wordpress": (("class", "entry-content|post-content|article-content"), (None, "^article$")),
    "ghost": (("class", "gh-content|post-content|article-content"),),
    "generic": ((None, "^article$"), (None, "^main$"), ("id", "content|main|article"), ("class", "content|article|post|entry")),
}
LABELS = {"blogger": "label-link|goog-label", "wordpress": "cat-links|tags-links|post-categories"}
DATES = (("itemprop", "^datePublished$"), ("class", "published|post-date|entry-date"), ("name", "^article:published_time$"))
ARTICLE = (
    "page_id long, platform string, container string, author string, published string, labels array<string>, h1 array<string>,"
    " paragraphs array<string>, images long, images_without_alt long, images_not_lazy long"
)


class Spans(HTMLParser):
    """Elements as (name, attributes, first and last place) and pieces of text by place; script and style text is left out."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.places: list[int] = []
        self.texts: list[str] = []
        self._open: list[int] = []
        self._place = 0
        self.feed(html)
        self.close()
        for i in self._open:
            self.nodes[i][3] = self._place + 1

    def handle_starttag(self, tag, attrs):
        self._place += 1
        self.nodes.append([tag, {k: v or "" for k, v in attrs}, self._place, self._place])
        if tag not in VOID:
            self._open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        self._place += 1
        self.nodes.append([tag, {k: v or "" for k, v in attrs}, self._place, self._place])

    def handle_endtag(self, tag):
        depth = next((d for d in range(len(self._open) - 1, -1, -1) if self.nodes[self._open[d]][0] == tag), None)
        if depth is None:
            return
        self._place += 1
        for i in self._open[depth:]:
            self.nodes[i][3] = self._place
        del self._open[depth:]

    def handle_data(self, data):
        if self._open and self.nodes[self._open[-1]][0] in ("script", "style"):
            return
        self._place += 1
        self.places.append(self._place)
        self.texts.append(data)

    def text(self, node) -> str:
        a, b = bisect_left(self.places, node[2]), bisect_left(self.places, node[3])
        return " ".join(" ".join(self.texts[a:b]).split())

    def within(self, outer, *names: str) -> list:
        inside = self.nodes if outer is None else [n for n in self.nodes if outer[2] < n[2] < outer[3]]
        return [n for n in inside if n[0] in names]

    def first(self, attribute: str | None, pattern: str):
        p = re.compile(pattern, re.IGNORECASE)
        return next((n for n in self.nodes if p.search(n[0] if attribute is None else n[1].get(attribute, ""))), None)


def platform_of(s: Spans, url: str) -> str:
    generator = next((n[1].get("content", "").lower() for n in s.nodes if n[0] == "meta" and n[1].get("name") == "generator"), "")
    for name in ("blogger", "wordpress", "ghost"):
        if name in generator:
            return name
    if "blogspot.com" in url or any("data-blog-id" in n[1] for n in s.nodes):
        return "blogger"
    if any(n[0] == "body" and "wp-" in n[1].get("class", "") for n in s.nodes):
        return "wordpress"
    if s.first("class", "gh-content|ghost-"):
        return "ghost"
    return "wordpress" if any(n[0] == "link" and "api.w.org" in n[1].get("rel", "") for n in s.nodes) else "generic"


def article_of(page_id: int, url: str, html: str) -> dict:
    s = Spans(html)
    platform = platform_of(s, url)
    box = next((n for n in (s.first(*c) for c in CONTAINERS[platform]) if n), None)
    author = s.first("class", "author|byline") or s.first("itemprop", "^author$") or s.first("rel", "^author$")
    date = next((n for n in (s.first(*d) for d in DATES) if n), None)
    labels = []
    if platform in LABELS:
        marked = [n for n in s.nodes if re.search(LABELS[platform], n[1].get("class", ""), re.IGNORECASE)]
        links = [n for n in marked if n[0] == "a"] if platform == "blogger" else [a for n in marked for a in s.within(n, "a")]
        labels = [t for t in map(s.text, links) if t]
    images = s.within(box, "img")
    return {
        "page_id": page_id, "platform": platform, "container": box[0] if box else None,
        "author": s.text(author)[:100] or None if author else None,
        "published": (date[1].get("content") or date[1].get("datetime") or s.text(date))[:50] or None if date else None,
        "labels": labels, "h1": [t for t in map(s.text, s.within(box, "h1")) if t],
        "paragraphs": [t for t in map(s.text, s.within(box, "p")) if len(t.split()) > 8],
        "images": len(images), "images_without_alt": sum(not n[1].get("alt") for n in images),
        "images_not_lazy": sum(n[1].get("loading") != "lazy" and bool(n[1].get("src")) for n in images),
    }


def article_facts(pages: DataFrame) -> DataFrame:
    """Of each page the article's platform, container, author, date, labels, h1, paragraphs of more than 8 words and images.

    A null html is an empty page. Pages come in Arrow batches; a page is parsed once and nothing is kept between pages.
    """
    schema = pages.sparkSession.createDataFrame([], ARTICLE).schema
    arrow = pa.schema([
        ("page_id", pa.int64()), ("platform", pa.string()), ("container", pa.string()), ("author", pa.string()), ("published", pa.string()),
        *((k, pa.list_(pa.string())) for k in ("labels", "h1", "paragraphs")), *((k, pa.int64()) for k in ("images", "images_without_alt", "images_not_lazy")),
    ])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([article_of(r["page_id"], r["url"] or "", r["html"] or "") for r in b.to_pylist()], schema=arrow)

    return in_batches(pages.select(F.col("page_id").cast("long"), "url", "html"), parse, schema)


def article_findings(facts: DataFrame) -> DataFrame:
    """page_id, code, severity of the article rules that hold.

    ``facts``: page_id, title, description, h1s, words, author, published, images_without_alt, images_not_lazy, schemas
    (null or '' for none; else the statuses of the page's objects parted by blanks), reading_ease.
    """
    n = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    some, title, meta = F.split(F.coalesce("schemas", F.lit("")), " "), n("title"), n("description")
    return rules(facts, ["page_id"], [
        ("title_missing", "critical", title == 0), ("title_short", "warning", title.between(1, 29)), ("title_long", "warning", title > 65),
        ("description_missing", "warning", meta == 0), ("description_short", "warning", meta.between(1, 99)), ("description_long", "warning", meta > 165),
        ("h1_missing", "critical", F.col("h1s") == 0), ("h1_repeated", "warning", F.col("h1s") > 1),
        ("very_thin", "critical", F.col("words") < 300), ("thin", "warning", F.col("words").between(300, 999)),
        ("author_missing", "warning", n("author") == 0), ("date_missing", "info", n("published") == 0),
        ("alt_missing", "warning", F.col("images_without_alt") > 0), ("not_lazy", "info", F.col("images_not_lazy") > 3),
        ("schema_missing", "warning", n("schemas") == 0), ("schema_retired", "critical", F.array_contains(some, "deprecated")),
        ("schema_restricted", "warning", F.array_contains(some, "restricted")), ("hard_to_read", "info", F.col("reading_ease") < 30),
    ])


def page_paragraphs(pages: DataFrame) -> DataFrame:
    """page_id, paragraphs (p elements with text), how many have more than 8 words, and the words of these."""
    p = pages.select("page_id", H.elements(F.coalesce("html", F.lit("")), "p").alias("p"))
    p = p.withColumn("n", F.transform("p", lambda x: F.size(F.split(x, " "))))
    long = F.filter("n", lambda x: x > 8)
    return p.select("page_id", F.size("p").cast("long").alias("paragraphs"), F.size(long).cast("long").alias("long_ones"), T.total(long).cast("long").alias("long_words"))


def visible_lines(pages: DataFrame) -> DataFrame:
    """page_id, lines and characters of the page's text with one line a piece between tags."""
    text = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<!--.*?-->", " ")
    for name in ("script", "style", "nav", "header", "footer", "aside"):
        text = F.regexp_replace(text, rf"(?is)<{name}(?:\s[^>]*)?>.*?</{name}\s*>", " ")
    pieces = F.split(F.regexp_replace(text, "<[^>]*>", "\x03"), "\x03")
    p = pages.select("page_id", F.transform(pieces, lambda x: H.squeeze(H.decode(x))).alias("p"))
    p = p.select("page_id", F.filter("p", lambda x: x != "").alias("p"))
    return p.select("page_id", F.size("p").cast("long").alias("lines"), F.length(F.array_join("p", "\n")).cast("long").alias("chars"))


def navigation_noise(docs: DataFrame) -> DataFrame:
    """doc_id, sentences, and how many of them are navigation rather than prose.

    Noise: a phrase of menus, two line breaks, no word, or 25 words and more of which over 85 % differ.
    """
    low = lambda s: F.lower(s)
    d = docs.select("doc_id", F.transform(T.sentences(F.coalesce("text", F.lit(""))), lambda s: F.struct(
        low(s).alias("s"), F.filter(T.words(low(s)), lambda w: w.rlike("^[a-z]+$")).alias("w"))).alias("x"))
    phrase = "|".join(re.escape(p) for p in dims.MENU_PHRASES)
    noise = F.filter("x", lambda x: x["s"].rlike(phrase) | (F.regexp_count(x["s"], F.lit("\n")) >= 2) | (F.size(x["w"]) == 0)
        | ((F.size(x["w"]) >= 25) & (100 * F.size(F.array_distinct(x["w"])) > 85 * F.size(x["w"]))))
    return d.select("doc_id", F.size("x").cast("long").alias("sentences"), F.size(noise).cast("long").alias("noise"))


def page_entities(pages: DataFrame) -> DataFrame:
    """Organisations and persons of JSON-LD: page_id, block, item, type, name, url, same_as (number of links)."""
    e = json_ld(pages).where(F.col("type").isin(*dims.ENTITY_TYPES))
    member = lambda k: F.get_json_object("raw", f"$.{k}")
    links = F.when(member("sameAs").startswith("["), F.size(F.from_json(member("sameAs"), "array<string>"))).when(member("sameAs").isNotNull(), 1).otherwise(0)
    return e.select("page_id", "block", "item", "type", F.coalesce(member("name"), F.lit("")).alias("name"), member("url").alias("url"), links.cast("long").alias("same_as"))


def entity_names(pages: DataFrame) -> DataFrame:
    """page_id and the name of what a page stands for: its first entity, og:site_name, or the title up to | or -."""
    first = page_entities(pages).groupBy("page_id").agg(F.min_by("name", F.struct("block", "item")).alias("entity"))
    h = F.coalesce("html", F.lit(""))
    p = pages.select("page_id", metas(h).alias("m"), F.get(H.elements(h, "title"), 0).alias("title")).join(first, "page_id", "left")
    filled = lambda c: F.when(F.trim(c) != "", c)
    title = filled(F.trim(F.regexp_extract("title", r"^([^|\-]*)", 1)))
    return p.select("page_id", F.coalesce(filled(F.col("entity")), meta_first(F.col("m"), "og:site_name"), title).alias("name"))


def contact_signals(pages: DataFrame) -> DataFrame:
    """page_id and whether its text has a phone number and a street address."""
    t = pages.select("page_id", H.visible(F.coalesce("html", F.lit("")), ("script", "style")).alias("t"))
    return t.select("page_id", F.col("t").rlike(dims.PHONE).alias("phone"), F.col("t").rlike(dims.STREET).alias("address"))
