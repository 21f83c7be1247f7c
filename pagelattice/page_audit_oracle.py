"""DuckDB SQL of the audit in one pass: the same facts and conditions, written over the pages themselves."""

from __future__ import annotations

from . import oracle as O
from .operators.hosts import SOFT_404
from .operators.page_audit import RASTER
from .oracles import _HYG
from .plans import dims

_SKIP = "'(?i)^(#|javascript:|mailto:|tel:|data:)'"


def _strings(values) -> str:
    return "[" + ", ".join(O.q(v) for v in values) + "]"


def _resolve(base: str, href: str) -> str:
    root, path = f"{O.scheme(base)} || '://' || {O.host(base)}", O.part(base, 3)
    rooted = f"CASE WHEN {path} = '' THEN '/' ELSE {path} END"
    joined = f"{root} || regexp_replace({rooted}, '[^/]*$', '') || regexp_replace({href}, '^(?:\\./)+', '')"
    for _ in range(2):
        joined = f"regexp_replace({joined}, '/[^/.][^/]*/\\.\\./', '/', 'g')"
    return (
        f"CASE WHEN {href} IS NULL THEN NULL WHEN regexp_matches({href}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN {href} WHEN starts_with({href}, '//') THEN {O.scheme(base)} || ':' || {href} WHEN starts_with({href}, '/') THEN {root} || {href} "
        f"WHEN starts_with({href}, '?') THEN {root} || {rooted} || {href} WHEN starts_with({href}, '#') OR {href} = '' THEN regexp_replace({base}, '#.*$', '') || {href} ELSE {joined} END"
    )


_REL = f"string_split_regex(lower(coalesce({O.attr('t', 'rel')}, '')), '\\s+')"
_LETTERS = "lambda x: regexp_matches(x, '^[a-zA-Z]+$')"
_SENTENCES = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\t\\r\\n\\f]+', '\\1' || chr(2), 'g'), chr(2)), lambda s: trim(s)), lambda s: s <> '')"
_FILLED = lambda n: f"coalesce({O.attr('t', n)} <> '', false)"
_LOW = lambda n: f"lower(coalesce({O.attr('t', n)}, ''))"
_META = lambda k: f"list_filter(m, lambda x: x.k = '{k}' AND trim(x.v) <> '')[1].v"
_LAST = lambda k: f"coalesce(list_filter(m, lambda x: x.k = '{k}')[-1].v, '')"
_SLASH = lambda u: f"(ends_with({O.part(u, 3)}, '/') AND length({O.part(u, 3)}) > 1)"

_CTES = f"""
h AS (SELECT page_id, url, {O.host('url')} AS site, coalesce(html, '') AS html FROM pages),
a1 AS MATERIALIZED (SELECT page_id, url, site, list_transform({O.tags('html', 'meta')}, lambda t: {{'k': lower(coalesce({O.attr('t', 'property')}, {O.attr('t', 'name')}, '')), 'v': coalesce({O.attr('t', 'content')}, '')}}) AS m,
  {O.elements('html', 'title')} AS titles, {O.elements('html', 'h1')} AS h1, list_transform({O.blocks('html')}, lambda b: trim(b)) AS blocks, {O.tags('html', 'link')} AS link, {O.visible('html')} AS text,
  list_transform({O.tags('html', 'img')}, lambda t: {{'no_alt': {O.attr('t', 'alt')} IS NULL, 'loading': {_LOW('loading')}, 'priority': {_LOW('fetchpriority')}, 'srcset': {_FILLED('srcset')}, 'sizes': {_FILLED('sizes')},
    'sized': {_FILLED('width')} AND {_FILLED('height')}, 'raster': list_contains({_strings(RASTER)}, lower(regexp_extract(coalesce({O.attr('t', 'src')}, ''), '^[^?#]*(\\.[^.?#]*)(?:[?#].*)?$', 1)))}}) AS img,
  list_transform(list_filter(string_split_regex(html, '(?i)<a\\s')[2:], lambda x: contains(x, '>')), lambda x: {{'t': regexp_extract(x, '^([^>]*)>', 1), 'inner': regexp_extract(x, '(?is)^[^>]*>(.*?)(?:</a|\\z)', 1)}}) AS a,
  contains(lower(html), 'google.com/maps') AS map, regexp_matches(html, '(?i)href=["'']tel:') AS tel, regexp_matches(html, '(?i)(streetAddress|postalCode|addressLocality|Address")') AS address, regexp_matches(html, '(?i)"@type"\\s*:\\s*"LocalBusiness"') AS local_business FROM h),
a2 AS MATERIALIZED (SELECT *, list_transform(list_filter(link, lambda t: list_contains({_REL}, 'canonical') AND trim(coalesce({O.attr('t', 'href')}, '')) <> ''), lambda t: trim({O.attr('t', 'href')})) AS canonicals,
  list_transform(list_filter(link, lambda t: list_contains({_REL}, 'alternate') AND {_FILLED('hreflang')} AND {_FILLED('href')}), lambda t: {{'lang': lower(trim({O.attr('t', 'hreflang')})), 'href': trim({O.attr('t', 'href')})}}) AS alternates,
  {O.words('text')} AS w, {_SENTENCES} AS sentences, list_transform(a, lambda x: {{'href': trim({O.attr('x.t', 'href')}), 'nofollow': list_contains({_REL.replace('(t, ', '(x.t, ').replace("THEN concat(regexp_extract(t", "THEN concat(regexp_extract(x.t").replace("regexp_matches(t,", "regexp_matches(x.t,").replace("regexp_extract(t,", "regexp_extract(x.t,")}, 'nofollow'),
    'bare': {O.squeeze(O.decode("regexp_replace(x.inner, '<[^>]*>', ' ', 'g')"))} = ''}}) AS hrefs FROM a1),
a3 AS MATERIALIZED (SELECT *, list_transform(list_filter(hrefs, lambda x: x.href IS NOT NULL AND x.href <> '' AND NOT regexp_matches(x.href, {_SKIP})), lambda x: {{'target': {_resolve('url', 'x.href')}, 'nofollow': x.nofollow, 'bare': x.bare}}) AS links,
  {_resolve('url', 'canonicals[1]')} AS canonical, list_transform(alternates, lambda x: {{'lang': x.lang, 'url': {_resolve('url', 'x.href')}}}) AS tags FROM a2),
a4 AS MATERIALIZED (SELECT *, list_filter(links, lambda x: {O.scheme('x.target')} IN ('http', 'https') AND {O.host('x.target')} = site) AS own, list_filter(w, {_LETTERS}) AS letters,
  greatest(1, len(list_filter(sentences, lambda s: len(list_filter({O.words('s')}, {_LETTERS})) >= 4)))::DOUBLE AS n_sentences, coalesce({_META('description')}, {_META('og:description')}) AS description FROM a3),
o AS (SELECT page_id, unnest(CASE WHEN NOT json_valid(b) THEN [{{'valid': false, 'raw': b, 'type': NULL::VARCHAR, 'context': NULL::VARCHAR}}]
    WHEN json_type(b) = 'ARRAY' THEN list_transform(json_extract(b, '$[*]'), lambda j: {{'valid': true, 'raw': j::VARCHAR, 'type': json_extract_string(j, '$."@type"'), 'context': json_extract_string(j, '$."@context"')}})
    WHEN json_type(b, '$."@graph"') = 'ARRAY' THEN list_transform(json_extract(b, '$."@graph"[*]'), lambda j: {{'valid': true, 'raw': j::VARCHAR, 'type': json_extract_string(j, '$."@type"'), 'context': coalesce(json_extract_string(j, '$."@context"'), json_extract_string(b, '$."@context"'))}})
    ELSE [{{'valid': true, 'raw': b, 'type': json_extract_string(b, '$."@type"'), 'context': json_extract_string(b, '$."@context"')}}] END) AS j FROM (SELECT page_id, unnest(blocks) AS b FROM a1)),
ob AS (SELECT page_id, list(j) AS objects FROM o GROUP BY page_id),
f AS (SELECT a4.*, coalesce(objects, []) AS objects, coalesce(length(titles[1]), 0) AS tl, coalesce(length(description), 0) AS dl, len(titles) AS n_titles, len(h1) AS n_h1, len(w) AS words, len(canonicals) AS nc, CASE WHEN canonical IS NOT NULL THEN {O.normal_a('canonical')} = {O.normal_a('url')} END AS self,
  coalesce(contains(list_filter(m, lambda x: x.k = 'robots')[-1].v, 'noindex'), false) AS noindex, len(list_distinct(list_transform(own, lambda x: {O.normal_b('x.target')}))) AS n_own, {_HYG('url')} AS hygiene, len(letters)::DOUBLE AS nw,
  list_sum(list_transform(letters, lambda x: CASE WHEN length(x) <= 2 THEN 1 ELSE greatest(1, len(regexp_extract_all(regexp_replace(lower(x), 'e$', ''), '[aeiouy]+'))) END))::DOUBLE AS syllables, tel OR address OR map AS hint FROM a4 LEFT JOIN ob USING (page_id))
"""

_LANG, _REGION = "string_split(x.lang, '-')[1]", "upper(nullif(regexp_extract(x.lang, '^[^-]*-(.*)$', 1), ''))"
_BAD = (
    f"x.lang <> 'x-default' AND (NOT list_contains({_strings(dims.LANGUAGES)}, {_LANG}) OR ({_LANG} = 'zh' AND {_REGION} IS NULL) OR coalesce(NOT list_contains({_strings([*dims.REGIONS, 'HANS', 'HANT'])}, {_REGION}), false)"
    f" OR coalesce(list_contains({_strings(dims.REGION_MISTAKES)}, {_REGION}), false))"
)
_ANY = lambda f: f"len(list_filter(objects, lambda x: coalesce({f}, false))) > 0"
_IMG = lambda f: f"len(list_filter(img, lambda x: {f}))"
_TYPED = f"list_contains({_strings(dims.ENTITY_TYPES)}, x.type)"
_STATUS = lambda s: _ANY(f"list_contains({_strings(k for k, v in dims.SCHEMA_STATUS.items() if v == s)}, x.type)")
_ABSENT = lambda p: " OR ".join(f"{_LAST(t)} = ''" for t, required, *_ in dims.SOCIAL_TAGS if required and t.startswith(p))
_EASE = "round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 206.835::DOUBLE - 1.015::DOUBLE * nw / n_sentences - 84.6::DOUBLE * syllables / nw)), 1)"

CHECKS = [
    ("onpage", "title_missing", "'critical'", "tl = 0"), ("onpage", "title_short", "'warning'", "tl > 0 AND tl < 30"), ("onpage", "title_long", "'warning'", "tl > 60"), ("onpage", "title_repeated", "'warning'", "n_titles > 1"), ("onpage", "description_missing", "'high'", "dl = 0"),
    ("onpage", "description_short", "'info'", "dl > 0 AND dl < 120"), ("onpage", "description_long", "'warning'", "dl > 160"), ("onpage", "h1_missing", "'high'", "n_h1 = 0"), ("onpage", "h1_repeated", "'warning'", "n_h1 > 1"),
    ("content", "thin_content", "CASE WHEN words < 100 THEN 'critical' ELSE 'warning' END", "words < 300"),
    ("soft_404", "soft_404_title", "'critical'", " OR ".join(f"contains(lower(coalesce(titles[1], '')), {O.q(s)})" for s in SOFT_404)),
    ("url", "url_template", "'critical'", "hygiene = 'template'"), ("url", "url_search", "'warning'", "hygiene = 'search'"), ("url", "url_facet", "'warning'", "hygiene = 'faceted'"), ("url", "url_parameter", "'info'", "hygiene = 'parameter'"),
    ("url", "url_upper_case", "'info'", f"regexp_matches({O.part('url', 3)}, '[A-Z]')"), ("url", "url_underscore", "'info'", f"contains({O.part('url', 3)}, '_')"), ("url", "url_too_long", "'warning'", "length(url) > 100"), ("url", "no_https", "'critical'", f"{O.scheme('url')} = 'http'"),
    ("canonical", "canonical_several", "'critical'", "nc > 1"), ("canonical", "canonical_missing", "'high'", "nc = 0"), ("canonical", "canonical_relative", "'high'", "NOT regexp_matches(canonicals[1], '^[a-zA-Z][a-zA-Z0-9+.-]*://')"),
    ("canonical", "canonical_http_on_https", "'high'", f"{O.scheme('canonical')} = 'http' AND {O.scheme('url')} = 'https'"), ("canonical", "canonical_www_mismatch", "'high'", f"starts_with({O.host('canonical')}, 'www.') <> starts_with(site, 'www.')"),
    ("canonical", "canonical_slash_mismatch", "'warning'", f"self AND {_SLASH('canonical')} <> {_SLASH('url')}"), ("canonical", "canonical_other_page", "'info'", "NOT self"), ("canonical", "canonical_noindex_conflict", "'critical'", "noindex AND NOT self"),
    ("hreflang", "alternates_without_self", "'critical'", "len(tags) > 0 AND len(list_filter(tags, lambda x: regexp_replace(x.url, '/+$', '') = regexp_replace(url, '/+$', ''))) = 0"), ("hreflang", "alternates_without_default", "'high'", "len(tags) > 0 AND len(list_filter(tags, lambda x: x.lang = 'x-default')) = 0"),
    ("hreflang", "alternates_several_defaults", "'high'", "len(list_filter(tags, lambda x: x.lang = 'x-default')) > 1"), ("hreflang", "alternates_mixed_protocols", "'warning'", f"len(list_distinct(list_transform(tags, lambda x: {O.scheme('x.url')}))) > 1"),
    ("hreflang", "alternates_bad_code", "'high'", f"len(list_filter(tags, lambda x: {_BAD})) > 0"),
    ("internal_links", "links_none", "'high'", "n_own = 0"), ("internal_links", "links_few", "'warning'", "n_own < 3"), ("internal_links", "links_many", "'warning'", "n_own > 100"), ("internal_links", "links_nofollow", "'warning'", "len(list_filter(own, lambda x: x.nofollow)) > 0"),
    ("internal_links", "links_without_text", "'warning'", "len(list_filter(own, lambda x: x.bare)) > 0"),
    ("readability", "hard_to_read", "'warning'", f"nw > 0 AND {_EASE} < 40"), ("readability", "long_sentences", "'warning'", "nw / n_sentences > 25"),
    ("schema_validation", "invalid_json", "'warning'", _ANY("NOT x.valid")), ("schema_validation", "context_missing", "'warning'", _ANY("x.valid AND x.context IS NULL")), ("schema_validation", "context_unknown", "'warning'", _ANY("x.context NOT IN ('https://schema.org', 'http://schema.org')")),
    ("schema_validation", "type_missing", "'warning'", _ANY("x.valid AND x.type IS NULL")), ("schema_validation", "placeholder", "'critical'", _ANY("x.valid AND (" + " OR ".join(f"contains(lower(x.raw), {O.q(s.lower())})" for s in dims.PLACEHOLDERS) + ")")),
    ("schema_validation", "type_retired", "'critical'", _STATUS("retired")), ("schema_validation", "type_no_rich_result", "'info'", _STATUS("no_rich_result")), ("schema_validation", "type_restricted", "'warning'", _STATUS("restricted")),
    ("entity", "entity_missing", "'critical'", f"NOT ({_ANY(_TYPED)})"), ("entity", "same_as_missing", "'critical'", f"{_ANY(_TYPED)} AND NOT ({_ANY(_TYPED + ' AND contains(x.raw, ' + O.q(chr(34) + 'sameAs' + chr(34)) + ')')})"),
    ("social", "open_graph_incomplete", "'warning'", _ABSENT("og:")), ("social", "card_incomplete", "'warning'", _ABSENT("twitter:")),
    ("image_seo", "no_images", "'info'", "len(img) = 0"), ("image_seo", "alt_missing", f"CASE WHEN {_IMG('x.no_alt')} * 4 > len(img) THEN 'high' ELSE 'warning' END", f"{_IMG('x.no_alt')} > 0"), ("image_seo", "first_image_lazy", "'critical'", "img[1].loading = 'lazy'"),
    ("image_seo", "first_image_without_priority", "'warning'", "img[1].priority <> 'high'"), ("image_seo", "first_image_without_srcset", "'warning'", "NOT img[1].srcset"), ("image_seo", "srcset_missing", "'warning'", f"len(img) > 1 AND {_IMG('NOT x.srcset')} > len(img) // 2"),
    ("image_seo", "sizes_missing", "'info'", f"{_IMG('x.srcset AND NOT x.sizes')} > 0"), ("image_seo", "dimensions_missing", f"CASE WHEN {_IMG('NOT x.sized')} > len(img) // 2 THEN 'warning' ELSE 'info' END", f"{_IMG('NOT x.sized')} > 0"), ("image_seo", "raster_images", "'info'", f"{_IMG('x.raster')} > 0"),
    ("local_signals", "local_business_missing", "'high'", "hint AND NOT local_business"), ("local_signals", "phone_link_missing", "'medium'", "hint AND NOT local_business AND NOT tel"),
]

_ROWS = " UNION ALL ".join(f"SELECT page_id, site, '{s}' AS section, '{c}' AS code, {sev} AS severity FROM f1 WHERE {cond}" for s, c, sev, cond in CHECKS)

PAGE_AUDIT = {
    "audit_findings": f"WITH {_CTES}, f1 AS MATERIALIZED (SELECT * FROM f) SELECT site, section, code, severity, count(DISTINCT page_id) AS pages FROM ({_ROWS}) GROUP BY ALL",
}
