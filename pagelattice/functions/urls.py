"""URLs as column expressions: parts, the normal forms that links and canonicals are compared in, templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, authority, path, query, fragment
PARTS = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, PARTS, i)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    """Lower-case host with its port, without credentials."""
    return F.regexp_replace(F.lower(part(url, 2)), "^[^@]*@", "")


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    return part(url, 3)


def query(url: Column) -> Column:
    return part(url, 4)


def fragment(url: Column) -> Column:
    return part(url, 5)


def _trimmed(p: Column) -> Column:
    return F.regexp_replace(p, "/+$", "")


def normal_a(url: Column) -> Column:
    """Scheme, host, path without trailing slash (the root keeps one), query; no fragment."""
    p = _trimmed(path(url))
    return F.concat(scheme(url), F.lit("://"), host(url), F.when(p == "", "/").otherwise(p), F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(""))


def normal_b(url: Column) -> Column:
    """Scheme, host and path without trailing slash; the root has none."""
    return F.concat(scheme(url), F.lit("://"), host(url), _trimmed(path(url)))


def normal_c(url: Column, site: Column) -> Column:
    """As B for http(s) URLs of ``site``; null for others."""
    return F.when(scheme(url).isin("http", "https") & (host(url) == site), normal_b(url))


def normal_d(url: Column) -> Column:
    """Host and path, root as '/': the form that canonicals are compared in."""
    p = _trimmed(path(url))
    return F.concat(host(url), F.when(p == "", "/").otherwise(p))


def template(url: Column) -> Column:
    """Path with its last segment replaced by * where there are two or more."""
    segments = F.filter(F.split(path(url), "/"), lambda x: x != "")
    head = F.array_join(F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(1))), "/")
    return F.when(F.size(segments) >= 2, F.concat(F.lit("/"), head, F.lit("/*"))).when(F.size(segments) == 1, F.concat(F.lit("/"), head)).otherwise("/")


def depth(url: Column) -> Column:
    return F.size(F.filter(F.split(path(url), "/"), lambda x: x != ""))


def tld(url: Column) -> Column:
    return F.regexp_extract(host(url), r"(\.[a-z0-9-]+)(?::[0-9]+)?$", 1)


def base_parts(url: Column) -> Column:
    """What ``resolve_from`` needs of a page's URL: make it a column of the page before links are exploded or a lambda runs over them."""
    return F.struct(url.alias("url"), scheme(url).alias("scheme"), F.concat(scheme(url), F.lit("://"), host(url)).alias("root"), F.when(path(url) == "", "/").otherwise(path(url)).alias("path"))


def resolve_from(b: Column, href: Column) -> Column:
    """An href against the URL of its page (``base_parts``): absolute, //host, /path, ?query, #fragment, or relative to the page's folder; one or two ../ are folded."""
    joined = F.concat(b["root"], F.regexp_replace(b["path"], "[^/]*$", ""), F.regexp_replace(href, r"^(?:\./)+", ""))
    for _ in range(2):
        joined = F.regexp_replace(joined, r"/[^/.][^/]*/\.\./", "/")
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(b["scheme"], F.lit(":"), href))
        .when(href.startswith("/"), F.concat(b["root"], href))
        .when(href.startswith("?"), F.concat(b["root"], b["path"], href))
        .when(href.startswith("#") | (href == ""), F.concat(F.regexp_replace(b["url"], "#.*$", ""), href))
        .otherwise(joined)
    )


def resolve(base: Column, href: Column) -> Column:
    """An href against the URL of its page."""
    return resolve_from(base_parts(base), href)


#: URL hygiene classes, first match wins.
PLACEHOLDER = r"\{[^}]+\}"
SEARCH = r"(?i)[?&](q|query|search|s|search_term_string|keyword|term)="
FACET = r"(?i)[?&](sort|order|filter|page|offset|limit|color|size|brand|category|tag)="


def hygiene(url: Column) -> Column:
    return F.when(url.rlike(PLACEHOLDER), "template").when(url.rlike(SEARCH), "search").when(url.rlike(FACET), "faceted").when(url.contains("?"), "parameter").otherwise("clean")
