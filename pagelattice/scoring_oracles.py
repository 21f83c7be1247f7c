"""DuckDB SQL of the scoring operators' queries."""

from __future__ import annotations

from . import oracle as O
from .oracles import _EDGE_RAW, ORACLES
from .plans import dims
from .sources.tables import literal_sql as lit


def _dim(values: dict, names: str) -> str:
    """A dictionary of numbers or tuples of numbers as a query."""
    rows = ", ".join(f"('{k}', {', '.join(map(repr, v if isinstance(v, tuple) else (v,)))})" for k, v in values.items())
    return f"(SELECT * FROM (VALUES {rows}) v({names}))"


def _index(weights: dict) -> str:
    return f"SELECT subject, count(weight) FILTER (WHERE score IS NOT NULL) AS parts, round(sum(score * weight::DOUBLE) / sum(weight::DOUBLE) FILTER (WHERE score IS NOT NULL), 2) AS score FROM {lit('index_part')} LEFT JOIN {_dim(weights, 'part, weight')} USING (part) GROUP BY subject"


_SECTIONS = f"""(SELECT site, unnest(['internal_links', 'redirects', 'llms_txt', 'pagespeed', 'readability', 'link_profile', 'hreflang', 'duplicate_content', 'programmatic_seo', 'canonical', 'local_signals']) AS section,
  unnest([greatest(0, 100 - (coalesce(link_issues, 0) * 10 + coalesce(broken_pages, 0) * 15 + coalesce(soft_404_pages, 0) * 10 + coalesce(redirected_pages, 0) * 5)),
    greatest(0, 100 - coalesce(redirect_issues, 0) * 25), coalesce(llms_score, 0), speed_score,
    CASE WHEN coalesce(reading_ease, 0) >= 60 THEN 100 WHEN reading_ease >= 30 THEN 50 + floor((reading_ease - 30) * 50 / 30) ELSE greatest(0, floor(coalesce(reading_ease, 0) * 50 / 30)) END,
    CASE WHEN links_per_page IS NULL THEN 0 ELSE greatest(0, least(100, 70 + CASE WHEN links_per_page >= 5 THEN 15 WHEN links_per_page >= 3 THEN 5 ELSE -15 END - least(30, coalesce(orphans, 0) * 5) - least(20, coalesce(dead_ends, 0) * 3))) END,
    CASE WHEN hreflang_tags > 0 THEN greatest(0, 100 - coalesce(hreflang_critical, 0) * 30 - coalesce(hreflang_high, 0) * 15 - coalesce(hreflang_medium, 0) * 5) END,
    CASE WHEN near_pairs IS NULL THEN 0 ELSE greatest(0, 100 - near_pairs * 20 - coalesce(thin_pages, 0) * 10) END,
    CASE WHEN template_groups > 0 THEN greatest(0, 100 - coalesce(template_critical, 0) * 25 - coalesce(template_warnings, 0) * 8) END,
    coalesce(trunc(canonical_score), 50), CASE WHEN local_business THEN trunc(coalesce(local_score, 0)) END]::DOUBLE[]) AS score FROM {lit("audit_metrics")})"""
_WEIGHTED = f"(SELECT site, score, CASE WHEN score IS NOT NULL THEN weight END AS weight FROM {_SECTIONS} LEFT JOIN {_dim(dims.SECTION_WEIGHTS, 'section, weight')} USING (section))"
_OVERALL = f"(SELECT site, count(weight) AS sections, coalesce(sum(weight), 0)::BIGINT AS weight, CASE WHEN sum(weight) > 0 THEN round(sum(score * weight) / sum(weight)) ELSE 0 END::BIGINT AS overall FROM {_WEIGHTED} GROUP BY site)"
_PAGE = lit("content_page")
_SITE = lit("site_count")
_CANON = f"(SELECT url, coalesce(split_part(canonicals, '|', 1), header_canonical) AS c, CASE WHEN canonicals IS NULL THEN 0 ELSE length(canonicals) - length(replace(canonicals, '|', '')) + 1 END AS n, coalesce(robots, '') AS robots FROM {lit('canonical_page')})"
_SAYS = lambda c: "(" + " OR ".join(f"contains(lower(coalesce({c}, '')), {O.q(x)})" for x in dims.SOFT_404) + ")"
_WASTE = lambda table: "SELECT class, count(*) AS urls FROM (SELECT CASE " + " ".join(f"WHEN regexp_matches(lower(url), {O.q(p)}) THEN '{k}'" for k, p in dims.CRAWL_WASTE) + f" ELSE 'none' END AS class FROM {table}) GROUP BY class"

SCORING: dict[str, str] = {
    "section_scores": f"SELECT site, section, score FROM {_SECTIONS}",
    "audit_overall": f"SELECT *, CASE WHEN overall >= 90 THEN 'A' WHEN overall >= 80 THEN 'B' WHEN overall >= 70 THEN 'C' WHEN overall >= 60 THEN 'D' WHEN overall >= 50 THEN 'E' ELSE 'F' END AS letter FROM {_OVERALL}",
    "sitemap_scores": f"""SELECT host, greatest(0, least(100, 30 + (robots_status = 200 AND sitemaps > 0)::INT * 20 + (sitemap_status = 200)::INT * 15 + (urls > 0)::INT * 10
      + CASE WHEN checked = 0 THEN 0 WHEN healthy >= 0.95 * checked THEN 25 WHEN healthy >= 0.8 * checked THEN 15 WHEN healthy >= 0.6 * checked THEN 5 ELSE -10 END - least(20, coalesce(pattern_urls, 0) * 10)))::BIGINT AS score FROM {lit("sitemap_summary")}""",
    "eeat_index": _index(dims.EEAT_WEIGHTS),
    "content_index": _index(dims.CONTENT_WEIGHTS),
    "answer_index": _index(dims.ANSWER_WEIGHTS),
    "site_health": f"""SELECT site, round(greatest(0, sum(base * weight) / sum(weight) FILTER (WHERE base IS NOT NULL) - 15 * sum(critical) - 5 * sum(warnings)), 2) AS score
      FROM (SELECT *, CASE WHEN positive + deficit > 0 THEN 100.0::DOUBLE * positive / (positive + deficit) END AS base FROM {lit("health_signal")}) LEFT JOIN (SELECT category, weight::DOUBLE AS weight FROM {_dim(dims.CATEGORY_WEIGHTS, "category, weight")}) USING (category) GROUP BY site""",
    "image_index": f"SELECT site, CASE WHEN images > 0 THEN round(({' + '.join(f'{n} * (images - {k})::DOUBLE / images' for k, n in dims.IMAGE_POINTS.items())}), 2) END AS score FROM {_SITE}",
    "word_floors": f"SELECT page, kind, words, floor, floor - words AS missing FROM {_PAGE} JOIN {_dim(dims.WORD_FLOORS, 'kind, floor')} USING (kind) WHERE words < floor",
    "freshness": f"SELECT page, kind, age_days, CASE WHEN due IS NULL THEN 'unknown' WHEN age_days <= due THEN 'fresh' WHEN age_days <= stale THEN 'due' ELSE 'stale' END AS state FROM {_PAGE} LEFT JOIN {_dim(dims.FRESHNESS_DAYS, 'kind, due, stale')} USING (kind)",
    "content_actions": f"""SELECT page, CASE WHEN sharing > 1 THEN 'consolidate' WHEN impressions_year < 10 AND backlinks = 0 AND outdated THEN 'prune' WHEN impressions_before > 0 AND clicks < clicks_before AND NOT outdated THEN 'refresh' ELSE 'keep' END AS bucket
      FROM (SELECT *, count(*) OVER (PARTITION BY topic) AS sharing FROM {_PAGE}) WHERE topic IS NOT NULL""",
    "traffic_diagnosis": f"SELECT page, CASE WHEN impressions * 10 < impressions_before * 9 THEN 'ranking' WHEN clicks * 10 < clicks_before * 9 THEN 'result_page' ELSE 'none' END AS cause FROM {_PAGE}",
    "answer_shapes": f"SELECT block, shape, coalesce(CASE shape WHEN 'paragraph' THEN words >= 40 AND words <= 60 WHEN 'list' THEN items >= 5 AND items <= 9 AND longest_item < 15 WHEN 'table' THEN columns <= 4 END, false) AS fits FROM {lit('answer_block')}",
    "paragraphs": r"""WITH p AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\n[ \t\r\f]*\n'), lambda x: regexp_matches(x, '[^ \t\n\r\f]')) AS p FROM documents)
      SELECT doc_id, len(p)::BIGINT AS paragraphs, len(list_filter(p, lambda x: len(regexp_extract_all(x, '[^ \t\n\r\f]+')) > 8))::BIGINT AS long_ones FROM p""",
    "header_alternates": f"""SELECT url, lower(raw_lang) AS lang, raw_lang, href FROM (SELECT url, regexp_extract(p, 'hreflang="([^"]+)"', 1) AS raw_lang, regexp_extract(p, '<([^>]+)>', 1) AS href, regexp_extract(p, 'rel="([^"]+)"', 1) AS rel
      FROM (SELECT url, unnest(string_split(link, ',')) AS p FROM {lit("link_header")})) WHERE raw_lang <> '' AND href <> '' AND contains(rel, 'alternate')""",
    "indexation_bands": f"SELECT site, round(r, 4) AS ratio, CASE WHEN r IS NULL THEN 'unknown' WHEN r > 0.9 THEN 'healthy' WHEN r >= 0.7 THEN 'acceptable' WHEN r >= 0.5 THEN 'problem' ELSE 'significant' END AS band FROM (SELECT site, CASE WHEN submitted > 0 THEN indexed::DOUBLE / submitted END AS r FROM {_SITE})",
    "missing_url_fixes": f"""SELECT url, category, CASE WHEN category IN ('facet', 'deleted') THEN 'high' WHEN category = 'typo' THEN 'medium' ELSE 'critical' END AS priority FROM (SELECT url,
      CASE WHEN regexp_matches(lower(url), '\\{{[^}}]*\\}}|/search([/?]|$)|[?&](q|s|query|search)=') THEN 'search' WHEN contains(url, '?') THEN 'facet' WHEN wanted THEN 'restore' WHEN moved THEN 'moved' WHEN external_only THEN 'typo' ELSE 'deleted' END AS category FROM {lit("missing_url")})""",
    "crawl_waste": _WASTE(lit("waste_url")),
    "crawl_waste_of_pages": _WASTE("pages"),
    "redirect_tiers": f"SELECT old_url, CASE WHEN visits > 100 OR backlinks > 5 THEN 'P1' WHEN visits > 0 OR backlinks > 0 THEN 'P2' ELSE 'P3' END AS tier FROM {lit('old_url')}",
    "sitemap_sample": "SELECT url FROM (SELECT DISTINCT url FROM pages) ORDER BY md5(url), url LIMIT 20",
    "ungrouped_pages": f"SELECT page_id, pattern FROM (SELECT page_id, {O.host('url')} || {O.template('url')} AS pattern FROM pages) WHERE pattern NOT IN (SELECT pattern FROM ({ORACLES['template_groups']}))",
    "canonical_summary": f"""SELECT count(*) AS pages, count(*) FILTER (WHERE c IS NULL) AS missing, count(*) FILTER (WHERE n > 1) AS multiple, count(*) FILTER (WHERE c IS NOT NULL AND contains(robots, 'noindex')) AS noindex_conflict,
      count(*) FILTER (WHERE {O.host("c")} <> {O.host("url")} AND regexp_replace({O.host("c")}, '^www[.]', '') = regexp_replace({O.host("url")}, '^www[.]', '')) AS www_mismatch,
      count(*) FILTER (WHERE {O.normal_b("c")} = {O.normal_b("url")}) AS own, count(*) FILTER (WHERE c IS NOT NULL AND {O.normal_b("c")} <> {O.normal_b("url")}) AS alternate FROM {_CANON}""",
    "soft_404_title_and_body": f"SELECT url FROM {lit('answer_page')} WHERE status = 200 AND {_SAYS('title')} AND {_SAYS('body')}",
    "links_with_subdomains": f"SELECT page_id, count(*) FILTER (WHERE own) AS internal_links, count(*) FILTER (WHERE NOT own) AS external_links FROM (SELECT page_id, {O.host('target')} = host OR ends_with({O.host('target')}, '.' || host) AS own FROM {_EDGE_RAW}) GROUP BY page_id",
    "links_by_absolute_url": f"SELECT page_id, target, min(pos) AS pos FROM {_EDGE_RAW} GROUP BY page_id, target",
    "link_set": f"SELECT DISTINCT host, regexp_replace(target, '#.*$', '') AS target FROM {_EDGE_RAW} WHERE internal",
    "gap_scores": f"SELECT domain, o AS opportunity, CASE WHEN o >= 70 THEN 'tier1' WHEN o >= 40 THEN 'tier2' ELSE 'tier3' END AS tier FROM (SELECT domain, round({' + '.join(f'{k} * {w}::DOUBLE' for k, w in dims.GAP_WEIGHTS.items())}, 2) AS o FROM {lit('gap_domain')})",
    "modal_target": f"SELECT target_url, count(*) AS links FROM {lit('backlink')} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    "image_weights": f"SELECT src, kind, kilobytes, CASE WHEN a IS NULL THEN 'unknown' WHEN kilobytes < a THEN 'target' WHEN kilobytes <= b THEN 'acceptable' WHEN kilobytes <= c THEN 'warning' ELSE 'stop' END AS band FROM {lit('image_size')} LEFT JOIN {_dim(dims.IMAGE_KILOBYTES, 'kind, a, b, c')} USING (kind)",
    "programmatic_gates": f"SELECT plan, CASE WHEN pages > 500 OR unique_share < 0.3 THEN 'stop' WHEN unique_share < 0.4 THEN 'thin' WHEN pages > 100 OR NOT reviewed THEN 'warning' ELSE 'pass' END AS gate FROM {lit('page_plan')}",
    "location_gates": f"SELECT site, location_pages, CASE WHEN location_pages >= 50 THEN 'stop' WHEN location_pages > 30 THEN 'warning' ELSE 'pass' END AS gate FROM {_SITE}",
    "roadmap": f"SELECT task, round(impact * ranking::DOUBLE / greatest(effort, 1), 2) AS priority, CASE WHEN week <= 4 THEN 'foundation' WHEN week <= 12 THEN 'expansion' WHEN week <= 24 THEN 'scale' ELSE 'authority' END AS phase FROM {lit('task')}",
    "audit_confidence": f"SELECT site, CASE WHEN pages_fetched >= 8 AND analytics THEN 'high' WHEN pages_fetched >= 4 THEN 'medium' WHEN pages_fetched >= 1 THEN 'low' ELSE 'none' END AS confidence FROM {_SITE}",
    "return_on_search": f"SELECT channel, round(v, 2) AS revenue, CASE WHEN investment > 0 THEN round((v - investment) / investment * 100, 2) END AS roi_percent FROM (SELECT *, coalesce(sessions * rate * order_value, conversions * lead_value) AS v FROM {lit('channel')})",
}
