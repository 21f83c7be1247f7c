"""DuckDB SQL of the article and audit operators' queries."""

from __future__ import annotations

from . import oracle as O
from .oracles import _SENT, ORACLES
from .plans import dims
from .sources.tables import literal_sql as lit

_H = "coalesce(html, '')"
_LEN = lambda c: f"length(trim(coalesce({c}, '')))"
_NUM = lambda c: f"coalesce({c}, 0)"
_FIRST = "split_part(canonicals, '|', 1)"
_ART = lit("article_fact")
_SITES = lit("site_metrics")


def _rules(table: str, key: str, checks: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT {key}, '{code}' AS code, '{sev}' AS severity FROM {table} WHERE {cond}" for code, sev, cond in checks)


_ARTICLE_RULES = [
    ("title_missing", "critical", "coalesce(title, '') = ''"), ("title_short", "warning", "length(title) BETWEEN 1 AND 29"), ("title_long", "warning", "length(title) > 65"),
    ("description_missing", "warning", "coalesce(description, '') = ''"), ("description_short", "warning", "length(description) BETWEEN 1 AND 99"),
    ("description_long", "warning", "length(description) > 165"), ("h1_missing", "critical", "h1s = 0"), ("h1_repeated", "warning", "h1s > 1"),
    ("very_thin", "critical", "words < 300"), ("thin", "warning", "words >= 300 AND words < 1000"), ("author_missing", "warning", "coalesce(author, '') = ''"),
    ("date_missing", "info", "coalesce(published, '') = ''"), ("alt_missing", "warning", "images_without_alt > 0"), ("not_lazy", "info", "images_not_lazy > 3"),
    ("schema_missing", "warning", "coalesce(schemas, '') = ''"), ("schema_retired", "critical", "list_contains(string_split(schemas, ' '), 'deprecated')"),
    ("schema_restricted", "warning", "list_contains(string_split(schemas, ' '), 'restricted')"), ("hard_to_read", "info", "reading_ease < 30"),
]

_FIXES = [
    ("add_h1", "'critical'", "coalesce(h1s, 0) = 0", "heading"), ("description_length", "'warning'", f"NOT ({_LEN('description')} BETWEEN 110 AND 170)", "metadata"),
    ("title_length", "'warning'", f"NOT ({_LEN('title')} BETWEEN 30 AND 65)", "metadata"), ("add_headers", "CASE WHEN headers_missing >= 4 THEN 'critical' ELSE 'warning' END", "headers_missing > 0", "headers"),
    ("add_llms", "'warning'", "has_llms IS NOT TRUE", "llms"), ("repair_links", "CASE WHEN broken >= 5 THEN 'critical' ELSE 'warning' END", "broken > 0", "links"),
    ("answer_404", "'warning'", "soft_404 > 0", "links"), ("sitemap_404", "'critical'", "sitemap_404 > 0", "links"), ("sitemap_soft_404", "'warning'", "sitemap_soft_404 > 0", "links"),
    ("sitemap_patterns", "CASE WHEN sitemap_templates > 0 THEN 'critical' ELSE 'warning' END", f"{_NUM('sitemap_templates')} + {_NUM('sitemap_searches')} > 0", "links"),
    ("canonical_errors", "'critical'", "canonical_critical > 0", "metadata"), ("add_canonical", "'warning'", f"{_NUM('canonical_critical')} = 0 AND canonical IS NULL", "metadata"),
    ("link_to_final_urls", "CASE WHEN redirected >= 5 THEN 'critical' ELSE 'warning' END", "redirected > 0", "links"), ("template_errors", "'critical'", "template_critical > 0", "metadata"),
    ("template_warnings", "'warning'", f"{_NUM('template_critical')} = 0 AND template_warnings > 2", "metadata"),
    ("alternate_pages", "CASE WHEN alternates >= 10 THEN 'critical' ELSE 'warning' END", "alternates > 0", "metadata"), ("broken_pages", "'critical'", "broken_pages > 0", "links"),
    ("soft_404_pages", "'warning'", "soft_404_pages > 0", "links"), ("card_tags", "'warning'", "card_tags_missing > 0", "metadata"), ("measure_speed", "'info'", "speed_failed", "performance"),
    ("shorten_sentences", "'warning'", "coalesce(reading_ease, 100) < 40 OR coalesce(sentence_length, 0) > 25", "metadata"),
]
_PLACES = "(SELECT * FROM (VALUES " + ", ".join(f"({O.q(p)}, {O.q(a)}, {O.q(w)})" for p, h in dims.FIX_PLACES.items() for a, w in h.items()) + ") v(p, area, w))"
_FOUND = " UNION ALL ".join(f"SELECT site, platform, {i} AS i, {sev} AS severity, '{code}' AS fix, '{area}' AS area FROM {_SITES} WHERE {cond}" for i, (code, sev, cond, area) in enumerate(_FIXES))
_OWN = f"(SELECT DISTINCT url FROM {lit('canonical_page')} WHERE {O.normal_d(_FIRST)} = {O.normal_d('url')})"
_ENT = f"""(SELECT page_id, block, j ->> '$."@type"' AS type, coalesce(j ->> '$.name', '') AS name, j ->> '$.url' AS url, CASE WHEN json_type(j, '$.sameAs') = 'ARRAY' THEN json_array_length(j, '$.sameAs') WHEN j ->> '$.sameAs' IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS same_as
  FROM (SELECT page_id, block - 1 AS block, trim(b[block]) AS j FROM (SELECT page_id, b, unnest(range(1, len(b) + 1)) AS block FROM (SELECT page_id, {O.blocks(_H)} AS b FROM {lit("entity_html")})))
  WHERE j ->> '$."@type"' IN ({", ".join(map(O.q, dims.ENTITY_TYPES))}))"""
_TASK_WORDS = f"(SELECT page_id, url, len({O.words(O.visible(_H))})::BIGINT AS words FROM {lit('task_page')})"


def _noise(table: str) -> str:
    phrase = " OR ".join(f"contains(s, {O.q(p)})" for p in dims.MENU_PHRASES)
    w = f"list_filter({O.words('s')}, lambda w: regexp_matches(w, '^[a-z]+$'))"
    bad = f"{phrase} OR length(s) - length(replace(s, chr(10), '')) >= 2 OR len(w) = 0 OR (len(w) >= 25 AND 100 * len(list_distinct(w)) > 85 * len(w))"
    each = f"(SELECT doc_id, s, {w} AS w FROM (SELECT doc_id, lower(unnest({_SENT})) AS s FROM (SELECT doc_id, coalesce(text, '') AS text FROM {table})))"
    return f"SELECT doc_id, count(s) AS sentences, count(*) FILTER (WHERE {bad}) AS noise FROM (SELECT doc_id FROM {table}) LEFT JOIN {each} USING (doc_id) GROUP BY doc_id"


def _passages(table: str) -> str:
    return f"""SELECT doc_id, i - 1 AS pos, words, ends_with({O.squeeze("before")}, '?') AS asked FROM (SELECT doc_id, i, p[i] AS p, coalesce(CASE WHEN i > 1 THEN p[i - 1] END, '') AS before, len({O.words("p[i]")})::BIGINT AS words
      FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM {table})))
      WHERE words BETWEEN 100 AND 200 AND NOT regexp_matches(lower(p), '^[ \\t]*(it|this|that|these|those|they)\\b')"""


def _business(table: str) -> str:
    kinds = dims.BUSINESS_SIGNS
    counts = ", ".join(f"count(*) FILTER (WHERE regexp_matches(t, {O.q(s)})) AS {k}" for k, s in kinds)
    best = f"greatest({', '.join(k for k, _ in kinds)})"
    case = " ".join(f"WHEN {k} = {best} THEN '{k}'" for k, _ in kinds)
    return f"SELECT site, CASE WHEN {best} = 0 THEN 'unknown' {case} END AS kind, {best} AS pages FROM (SELECT site, {counts} FROM (SELECT {O.host('url')} AS site, lower(concat_ws(' ', url, html)) AS t FROM {table}) GROUP BY site)"


def _domains() -> str:
    names = ("citation", "identity", "trust", "eminence")
    w = ", ".join(f"('{k}', {', '.join(f'{x}::DOUBLE' for x in v)})" for k, v in dims.DOMAIN_WEIGHTS.items())
    total = " + ".join(f"coalesce({n} * w{n}, 0::DOUBLE)" for n in names)
    weight = " + ".join(f"CASE WHEN {n} IS NULL THEN 0::DOUBLE ELSE w{n} END" for n in names)
    raw = f"(SELECT domain, vetoed, CASE WHEN {weight} > 0 THEN round(({total}) / ({weight}), 2) END AS raw FROM {lit('domain_rating')} JOIN (SELECT * FROM (VALUES {w}) v(kind, {', '.join('w' + n for n in names)})) USING (kind))"
    score = "CASE WHEN vetoed AND raw > 39 THEN 39::DOUBLE ELSE raw END"
    return f"SELECT *, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 60 THEN 'medium' WHEN score >= 40 THEN 'low' WHEN score >= 0 THEN 'poor' END AS band FROM (SELECT domain, raw, {score} AS score FROM {raw})"


def _link_health() -> str:
    q3 = ", ".join(f"('{k}', {v[2]}::DOUBLE)" for k, v in dims.DOMAIN_QUARTILES.items())
    f = {
        "domains": "domains * 100::DOUBLE / q", "quality": "CASE WHEN domains > 0 THEN strong_domains * 100::DOUBLE / domains ELSE 0 END", "toxic": "100 - toxic_share * 100 * 100 / 15", "anchors": "anchor_score",
        "places": "target_share * 100", "velocity": "(1.5::DOUBLE - variation) / 1.2::DOUBLE * 100", "follow": "100 - 10 * greatest(0::DOUBLE, 70 - follow_share * 100, follow_share * 100 - 85) / 5",
    }
    score = " + ".join(f"greatest(0::DOUBLE, least(100::DOUBLE, {v})) * {dims.LINK_HEALTH_WEIGHTS[k]}::DOUBLE" for k, v in f.items())
    return f"SELECT *, CASE WHEN score >= 80 THEN 'healthy' WHEN score >= 60 THEN 'moderate' WHEN score >= 40 THEN 'at_risk' ELSE 'critical' END AS rating FROM (SELECT site, round({score}, 1) AS score FROM {lit('link_stat')} JOIN (SELECT * FROM (VALUES {q3}) v(kind, q)) USING (kind))"


def _review(c: str, good: str, poor: str) -> str:
    return f"CASE WHEN {c} {good} THEN 'good' WHEN {c} {poor} THEN 'poor' ELSE 'fair' END"


_STRIP = "regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', ' ', 'g')"
for _n in ("script", "style", "nav", "header", "footer", "aside"):
    _STRIP = f"regexp_replace({_STRIP}, '(?is)<{_n}(?:\\s[^>]*)?>.*?</{_n}\\s*>', ' ', 'g')"
_PIECES = f"list_filter(list_transform(string_split(regexp_replace({_STRIP}, '<[^>]*>', chr(3), 'g'), chr(3)), lambda x: {O.squeeze(O.decode('x'))}), lambda x: x <> '')"

AUDITS: dict[str, str] = {
    "article_findings": _rules(_ART, "page_id", _ARTICLE_RULES),
    "page_paragraphs": f"SELECT page_id, len(p)::BIGINT AS paragraphs, len(list_filter(n, lambda x: x > 8))::BIGINT AS long_ones, coalesce(list_sum(list_filter(n, lambda x: x > 8)), 0)::BIGINT AS long_words FROM (SELECT page_id, p, list_transform(p, lambda x: len(string_split(x, ' '))) AS n FROM (SELECT page_id, {O.elements(_H, 'p')} AS p FROM pages))",
    "visible_lines": f"SELECT page_id, len(p)::BIGINT AS lines, length(array_to_string(p, chr(10)))::BIGINT AS chars FROM (SELECT page_id, {_PIECES} AS p FROM pages)",
    "navigation_noise": _noise("documents"),
    "navigation_noise_cases": _noise(lit("noise_text")),
    "page_entities": f"SELECT page_id, block, 0 AS item, type, name, url, same_as FROM {_ENT}",
    "entity_names": f"""SELECT page_id, coalesce(nullif(trim(e.name), ''), nullif(trim(site), ''), nullif(trim(title), '')) AS name FROM (SELECT page_id, regexp_extract({_H}, '(?i)og:site_name" content="([^"]*)"', 1) AS site,
      regexp_extract(({O.elements(_H, "title")})[1], '^([^|-]*)', 1) AS title FROM {lit("entity_html")}) LEFT JOIN (SELECT page_id, arg_min(name, block) AS name FROM {_ENT} GROUP BY page_id) e USING (page_id)""",
    "contact_signals": f"SELECT page_id, regexp_matches(t, {O.q(dims.PHONE)}) AS phone, regexp_matches(t, {O.q(dims.STREET)}) AS address FROM (SELECT page_id, {O.visible(_H, ('script', 'style'))} AS t FROM {lit('entity_html')})",
    "site_risk": f"SELECT *, CASE WHEN critical > 0 THEN 'high' WHEN warnings > 3 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT site, sum(critical)::BIGINT AS critical, sum(warnings)::BIGINT AS warnings FROM {lit('template_count')} GROUP BY site)",
    "thin_pages_first": f"SELECT page_id, words FROM ({ORACLES['thin_content']}) ORDER BY words, page_id LIMIT 10",
    "largest_groups": f"SELECT pattern, pages FROM ({ORACLES['template_groups']}) ORDER BY pages DESC, pattern LIMIT 20",
    "self_canonical_pairs": f"SELECT url_a, url_b, similarity, 'high' AS severity FROM {lit('near_pair')} WHERE url_a IN (SELECT url FROM {_OWN}) AND url_b IN (SELECT url FROM {_OWN})",
    "canonical_filled": f"SELECT url, coalesce(split_part(canonicals, '|', 1), header_canonical) AS canonical FROM {lit('canonical_page')}",
    "environment_fixes": f"""SELECT site, row_number() OVER (PARTITION BY site ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, i) - 1 AS place, severity, fix, coalesce(o.w, d.w) AS "where"
      FROM ({_FOUND}) f JOIN {_PLACES} d ON d.p = 'other' AND d.area = f.area LEFT JOIN {_PLACES} o ON o.p = f.platform AND o.area = f.area
      UNION ALL SELECT site, 0, 'pass', 'none', '' FROM {_SITES} WHERE site NOT IN (SELECT site FROM ({_FOUND}))""",
    "raw_html_notice": f"SELECT site, coalesce(platform, '') IN ('Next.js', 'Nuxt') OR contains(coalesce(runtime, ''), 'JavaScript') AS caveat FROM {lit('site_runtime')}",
    "masked_keys": f"SELECT site, CASE WHEN length(key) > 8 THEN key[:4] || '...' || key[-4:] ELSE '***' END AS key FROM {lit('site_key')}",
    "sitemap_candidates": f"""SELECT DISTINCT host, url FROM (SELECT host, trim(unnest(regexp_extract_all(body, '(?im)^[ \\t]*sitemap:[ \\t]*([^\\r\\n]*)', 1))) AS url FROM {lit("robots_txt")} WHERE status = 200
      UNION ALL SELECT host, 'https://' || host || unnest([{", ".join(map(O.q, dims.SITEMAP_PATHS))}]) FROM {lit("robots_txt")}) WHERE url <> ''""",
    "sitemap_languages": f"SELECT host, url, array_to_string(list_sort(list_distinct(regexp_extract_all(xml, 'hreflang=\"([^\"]+)\"', 1))), ',') AS languages, contains(xml, 'xmlns:xhtml') AS declared FROM {lit('sitemap_alternates')}",
    "soft_404_of_links": f"SELECT url FROM {lit('answer_page')} WHERE status = 200 AND ({' OR '.join(f'contains(lower(title), {O.q(s)})' for s in dims.SOFT_404_OF_LINKS)})",
    "domain_index": _domains(),
    "item_priorities": f"SELECT page, item, gain, row_number() OVER (PARTITION BY page ORDER BY gain DESC, item) AS place FROM (SELECT page, item, round(CASE grade WHEN 'F' THEN 10 WHEN 'A' THEN 5 ELSE 0 END * CASE dim WHEN 'C' THEN 0.15 WHEN 'O' THEN 0.1 WHEN 'R' THEN 0.1 WHEN 'E' THEN 0.1 WHEN 'T' THEN 0.15 END::DOUBLE, 4) AS gain FROM {lit('grade')}) WHERE gain > 0 QUALIFY place <= 5",
    "recognition": f"SELECT *, CASE WHEN points >= 36 THEN 'strong' WHEN points >= 24 THEN 'moderate' WHEN points >= 12 THEN 'weak' ELSE 'none' END AS band FROM (SELECT entity, sum(CASE WHEN points > 3 THEN 3 WHEN points < 0 THEN 0 ELSE points END)::BIGINT AS points FROM {lit('recognition_answer')} GROUP BY entity)",
    "review_bands": f"SELECT site, {_review('stars', '>= 4.3', '< 4.0')} AS stars, {_review('reviews', '>= 50', '< 20')} AS number, {_review('days_since', '<= 30', '> 90')} AS recency, {_review('answered', '> 0.8', '< 0.5')} AS answers FROM {lit('review_stat')}",
    "business_kinds": _business(lit("business_page")),
    "business_kinds_of_pages": _business("pages"),
    "content_pages": f"SELECT page_id, words FROM {_TASK_WORDS} WHERE words < 300 AND NOT regexp_matches(lower(url), {O.q(dims.TASK_PATHS)})",
    "passage_blocks": _passages("documents"),
    "passage_cases": _passages(lit("passage")),
    "link_health": _link_health(),
}
