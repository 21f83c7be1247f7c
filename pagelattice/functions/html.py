"""HTML as column expressions: tags, attributes, visible text. Patterns need no look-around, so every engine reads them alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trimmed

#: Elements whose content is no visible text of the page.
CHROME = ("script", "style", "nav", "footer", "header", "aside")
ATTR = r"""(?is)(?:^|\s){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
JSONLD = r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""
#: Character references that are text; all others become a blank.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def tags(html: Column, name: str) -> Column:
    """Attribute text of every start tag of one name, in order."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}(?:\s([^>]*))?>"), F.lit(1))


def attr(tag: Column, name: str) -> Column:
    """An attribute's value; null if the tag doesn't have it, '' if it is empty."""
    p = ATTR.format(name=name)
    return F.when(tag.rlike(p), F.concat(*(F.regexp_extract(tag, p, i) for i in (1, 2, 3))))


def elements(html: Column, name: str) -> Column:
    """Text of every element of one name: tags dropped, white space squeezed, empty ones left out."""
    inner = F.regexp_extract_all(html, F.lit(rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}\s*>"), F.lit(1))
    return F.filter(F.transform(inner, lambda x: squeeze(decode(F.regexp_replace(x, "<[^>]*>", " ")))), lambda x: x != "")


def squeeze(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, r"[ \t\r\n\f]+", " "))


def decode(text: Column) -> Column:
    for k, v in ENTITIES[:-1]:
        text = F.replace(text, F.lit(k), F.lit(v))
    held = F.replace(text, F.lit("&amp;"), F.lit("\x01"))
    return F.replace(F.regexp_replace(held, "&[a-zA-Z]+;|&#[0-9]+;", " "), F.lit("\x01"), F.lit("&"))


def visible(html: Column, drop: tuple = CHROME) -> Column:
    """Visible text: comments and ``drop`` elements out, tags to blanks, references decoded, white space squeezed."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for name in drop:
        text = F.regexp_replace(text, rf"(?is)<{name}(?:\s[^>]*)?>.*?</{name}\s*>", " ")
    return squeeze(decode(F.regexp_replace(text, "<[^>]*>", " ")))


def json_blocks(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(JSONLD), F.lit(1))
