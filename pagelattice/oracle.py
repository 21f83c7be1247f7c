"""Pieces of DuckDB SQL that the queries' oracles are put together from."""

from __future__ import annotations

from .functions.html import ATTR, CHROME, ENTITIES, JSONLD
from .functions.urls import PARTS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[ \\t\\r\\n\\f]+', ' ', 'g'))"


def decode(x: str) -> str:
    for k, v in ENTITIES[:-1]:
        x = f"replace({x}, {q(k)}, {q(v)})"
    return f"replace(regexp_replace(replace({x}, '&amp;', chr(1)), '&[a-zA-Z]+;|&#[0-9]+;', ' ', 'g'), chr(1), '&')"


def visible(x: str, drop: tuple = CHROME) -> str:
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    for n in drop:
        x = f"regexp_replace({x}, '(?is)<{n}(?:\\s[^>]*)?>.*?</{n}\\s*>', ' ', 'g')"
    return squeeze(decode(f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"))


def tags(x: str, n: str) -> str:
    return f"regexp_extract_all({x}, '(?is)<{n}(?:\\s([^>]*))?>', 1)"


def attr(x: str, n: str) -> str:
    p = q(ATTR.format(name=n))
    return f"CASE WHEN regexp_matches({x}, {p}) THEN concat(regexp_extract({x}, {p}, 1), regexp_extract({x}, {p}, 2), regexp_extract({x}, {p}, 3)) END"


def elements(x: str, n: str) -> str:
    inner = f"regexp_extract_all({x}, '(?is)<{n}(?:\\s[^>]*)?>(.*?)</{n}\\s*>', 1)"
    return f"list_filter(list_transform({inner}, lambda x: {squeeze(decode('regexp_replace(x, ' + q('<[^>]*>') + ', ' + q(' ') + ', ' + q('g') + ')'))}), lambda x: x <> '')"


def blocks(x: str) -> str:
    return f"regexp_extract_all({x}, {q(JSONLD)}, 1)"


def part(x: str, i: int) -> str:
    return f"regexp_extract({x}, {q(PARTS)}, {i})"


def scheme(x: str) -> str:
    return f"lower({part(x, 1)})"


def host(x: str) -> str:
    return f"regexp_replace(lower({part(x, 2)}), '^[^@]*@', '')"


def trimmed(x: str) -> str:
    return f"regexp_replace({part(x, 3)}, '/+$', '')"


def normal_a(x: str) -> str:
    return f"concat({scheme(x)}, '://', {host(x)}, CASE WHEN {trimmed(x)} = '' THEN '/' ELSE {trimmed(x)} END, CASE WHEN {part(x, 4)} <> '' THEN '?' || {part(x, 4)} ELSE '' END)"


def normal_b(x: str) -> str:
    return f"concat({scheme(x)}, '://', {host(x)}, {trimmed(x)})"


def normal_d(x: str) -> str:
    return f"concat({host(x)}, CASE WHEN {trimmed(x)} = '' THEN '/' ELSE {trimmed(x)} END)"


def segments(x: str) -> str:
    return f"list_filter(string_split({part(x, 3)}, '/'), lambda s: s <> '')"


def template(x: str) -> str:
    s = segments(x)
    return f"CASE WHEN len({s}) >= 2 THEN '/' || array_to_string(({s})[:-2], '/') || '/*' WHEN len({s}) = 1 THEN '/' || ({s})[1] ELSE '/' END"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+')"


def ascii_words(x: str) -> str:
    return f"list_filter({words(f'lower({x})')}, lambda w: regexp_matches(w, '^[a-z]+$'))"


def normalised(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[ \\t\\r\\n\\f]+', ' ', 'g'))"
