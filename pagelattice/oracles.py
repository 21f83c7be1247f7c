"""DuckDB SQL for the catalog's queries, written on the tables and literal rows themselves."""

from __future__ import annotations

from . import oracle as O
from .operators.documents import coefficients
from .plans import dims
from .sources.tables import literal_sql as lit

_H = "coalesce(html, '')"
_WORDS = f"(SELECT page_id, {O.host('url')} AS host, len({O.words(O.visible(_H))})::BIGINT AS words FROM pages)"


def _facts(table: str) -> str:
    metas = f"list_transform({O.tags(_H, 'meta')}, lambda t: {{'k': lower(coalesce({O.attr('t', 'property')}, {O.attr('t', 'name')}, '')), 'v': coalesce({O.attr('t', 'content')}, '')}})"
    canon = f"list_transform(list_filter({O.tags(_H, 'link')}, lambda t: list_contains(string_split_regex(lower(coalesce({O.attr('t', 'rel')}, '')), '\\s+'), 'canonical') AND trim(coalesce({O.attr('t', 'href')}, '')) <> ''), lambda t: trim({O.attr('t', 'href')}))"
    first = lambda k: f"(list_filter(m, lambda x: x.k = '{k}' AND trim(x.v) <> ''))[1].v"
    return f"""(SELECT page_id, t[1] AS title, len(t)::BIGINT AS n_titles, coalesce({first('description')}, {first('og:description')}) AS meta_description,
      CASE WHEN {first('description')} IS NOT NULL THEN 'meta' WHEN {first('og:description')} IS NOT NULL THEN 'og' END AS meta_source, (list_filter(m, lambda x: x.k = 'robots'))[-1].v AS meta_robots,
      c[1] AS canonical, len(c)::BIGINT AS n_canonicals, len(h1)::BIGINT AS n_h1, h1[1] AS first_h1, len(h2)::BIGINT AS n_h2, len(h3)::BIGINT AS n_h3, lower({O.attr(f'({O.tags(_H, "html")})[1]', 'lang')}) AS lang
      FROM (SELECT page_id, html, {metas} AS m, {O.elements(_H, 'title')} AS t, {O.elements(_H, 'h1')} AS h1, {O.elements(_H, 'h2')} AS h2, {O.elements(_H, 'h3')} AS h3, {canon} AS c FROM {table}))"""


_PF = _facts("pages")
_HEAD = lit("head_html")


def _lengths(f: str) -> str:
    checks = [("title_missing", "critical", "t = 0"), ("title_short", "warning", "t > 0 AND t < 30"), ("title_long", "warning", "t > 60"), ("title_repeated", "warning", "n_titles > 1"), ("description_missing", "high", "m = 0"), ("description_short", "info", "m > 0 AND m < 120"), ("description_long", "warning", "m > 160"), ("h1_missing", "high", "n_h1 = 0"), ("h1_repeated", "warning", "n_h1 > 1")]
    base = f"(SELECT *, coalesce(length(title), 0) AS t, coalesce(length(meta_description), 0) AS m FROM {f})"
    return " UNION ALL ".join(f"SELECT page_id, '{c}' AS code, '{s}' AS severity FROM {base} WHERE {w}" for c, s, w in checks)


_EDGE_RAW = f"""(SELECT page_id, host, pos, target, CASE WHEN a = '' THEN '[no text]' ELSE a END AS anchor, nofollow, {O.host('target')} = host AS internal FROM (
  SELECT page_id, {O.host('url')} AS host, i AS pos, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN {O.scheme('url')} || ':' || href WHEN starts_with(href, '/') THEN {O.scheme('url')} || '://' || {O.host('url')} || href
      WHEN starts_with(href, '?') THEN {O.scheme('url')} || '://' || {O.host('url')} || {O.part('url', 3)} || href ELSE {O.scheme('url')} || '://' || {O.host('url')} || regexp_replace({O.part('url', 3)}, '[^/]*$', '') || href END AS target,
    left({O.squeeze(O.decode("regexp_replace(coalesce(txt, ''), '<[^>]*>', ' ', 'g')"))}, 80) AS a, list_contains(string_split_regex(lower(coalesce({O.attr('tag', 'rel')}, '')), '\\s+'), 'nofollow') AS nofollow
  FROM (SELECT page_id, url, i, tag, txt, trim({O.attr('tag', 'href')}) AS href FROM (SELECT page_id, url, i - 2 AS i, regexp_extract(parts[i], '^([^>]*)>', 1) AS tag, regexp_extract(parts[i], '(?is)^[^>]*>(.*?)(?:</a|\\z)', 1) AS txt
    FROM (SELECT page_id, url, parts, unnest(range(2, len(parts) + 1)) AS i FROM (SELECT page_id, url, string_split_regex({_H}, '(?i)<a\\s') AS parts FROM pages)) WHERE contains(parts[i], '>')))
  WHERE href IS NOT NULL AND href <> '' AND NOT regexp_matches(href, '(?i)^(#|javascript:|mailto:|tel:|data:)')) WHERE {O.scheme('target')} IN ('http', 'https'))"""
_EDGES = f"(SELECT page_id, host, {O.normal_b('target')} AS target, arg_min(anchor, pos) AS anchor, arg_min(nofollow, pos) AS nofollow FROM {_EDGE_RAW} WHERE internal GROUP BY page_id, host, {O.normal_b('target')})"
_DEG = f"""(SELECT p.page_id, coalesce(i.n, 0)::BIGINT AS in_degree, coalesce(o.n, 0)::BIGINT AS out_degree FROM pages p LEFT JOIN (SELECT target, count(DISTINCT page_id) AS n FROM {_EDGES} GROUP BY 1) i ON i.target = {O.normal_b('p.url')}
  LEFT JOIN (SELECT page_id, count(*) AS n FROM {_EDGES} GROUP BY 1) o ON o.page_id = p.page_id)"""
_PATTERN = f"{O.host('url')} || {O.template('url')}"
_HYG = lambda c: f"CASE WHEN regexp_matches({c}, '\\{{[^}}]+\\}}') THEN 'template' WHEN regexp_matches({c}, '(?i)[?&](q|query|search|s|search_term_string|keyword|term)=') THEN 'search' WHEN regexp_matches({c}, '(?i)[?&](sort|order|filter|page|offset|limit|color|size|brand|category|tag)=') THEN 'faceted' WHEN contains({c}, '?') THEN 'parameter' ELSE 'clean' END"

_ASC = O.ascii_words("text")
_SYL_A = "list_transform(w, lambda x: CASE WHEN length(x) <= 2 THEN 1 ELSE greatest(1, len(regexp_extract_all(regexp_replace(x, 'e$', ''), '[aeiouy]+'))) END)"
_SENT = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\t\\r\\n\\f]+', '\\1' || chr(2), 'g'), chr(2)), lambda s: trim(s)), lambda s: s <> '')"
_EASE = "round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 206.835::DOUBLE - 1.015::DOUBLE * words::DOUBLE / sentences::DOUBLE - 84.6::DOUBLE * syllables::DOUBLE / words::DOUBLE)), 1)"
_GRADE = "round(greatest(0.0::DOUBLE, 0.39::DOUBLE * words::DOUBLE / sentences::DOUBLE + 11.8::DOUBLE * syllables::DOUBLE / words::DOUBLE - 15.59::DOUBLE), 1)"
_READ_A = f"""(SELECT *, {_EASE} AS reading_ease, {_GRADE} AS grade, round(words::DOUBLE / 200, 1) AS minutes FROM (SELECT doc_id, len(w)::BIGINT AS words, greatest(1, len(list_filter({_SENT}, lambda s: len(list_filter({O.words('s')}, lambda x: regexp_matches(x, '^[a-zA-Z]+$'))) >= 4)))::BIGINT AS sentences,
  list_sum({_SYL_A})::BIGINT AS syllables, len(list_filter({_SYL_A}, lambda x: x >= 3))::BIGINT AS complex_words FROM (SELECT doc_id, text, {_ASC} AS w FROM documents) WHERE len(w) > 0))"""
_LEVEL = "CASE WHEN reading_ease >= 80 THEN 'easy' WHEN reading_ease >= 60 THEN 'standard' WHEN reading_ease >= 40 THEN 'difficult' WHEN reading_ease >= 20 THEN 'very_difficult' ELSE 'extremely_difficult' END"
_SH = lambda k: f"CASE WHEN len(w) >= {k} THEN list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
_STOP = "[" + ", ".join(O.q(w) for w in __import__("pagelattice.functions.text", fromlist=["STOP_WORDS"]).STOP_WORDS) + "]"
_COEF = "[" + ", ".join(f"[{a}::BIGINT, {b}::BIGINT]" for a, b in coefficients(100)) + "]"
_DIGEST = f"sha256({O.normalised('text')})"

_RB = lit("robots_txt")
_RULES = f"""(SELECT host, line_no, last_value(CASE WHEN directive = 'user-agent' THEN value END IGNORE NULLS) OVER (PARTITION BY host ORDER BY line_no) AS agent, directive, value FROM (SELECT host, line_no, lower(trim(split_part(line, ':', 1))) AS directive, trim(substr(line, instr(line, ':') + 1)) AS value
  FROM (SELECT host, (i - 1)::BIGINT AS line_no, trim(ls[i]) AS line FROM (SELECT host, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT host, string_split_regex(body, '\\r?\\n') AS ls FROM {_RB} WHERE status = 200))) WHERE line <> '' AND NOT starts_with(line, '#') AND contains(line, ':')))"""
_AIC = f"""(SELECT h.host, h.crawler, CASE WHEN h.status = 404 THEN 'no_robots' WHEN o.agent IS NOT NULL AND o.full_ > 0 THEN 'blocked' WHEN o.agent IS NOT NULL AND o.dis > 0 THEN 'partly_blocked' WHEN o.agent IS NOT NULL AND o.alw > 0 THEN 'allowed' WHEN o.agent IS NOT NULL THEN 'no_rules'
  WHEN s.agent IS NOT NULL AND s.full_ > 0 THEN 'blocked_by_star' WHEN s.agent IS NOT NULL THEN 'inherits_star' ELSE 'unmanaged' END AS crawler_status
  FROM (SELECT host, status, unnest([{', '.join(O.q(c) for c in dims.AI_CRAWLERS)}]) AS crawler FROM {_RB} WHERE status IN (200, 404)) h
  LEFT JOIN (SELECT host, agent, count(*) FILTER (WHERE directive = 'disallow' AND value <> '') AS dis, count(*) FILTER (WHERE directive = 'disallow' AND value = '/') AS full_, count(*) FILTER (WHERE directive = 'allow') AS alw FROM {_RULES} WHERE agent IS NOT NULL GROUP BY 1, 2) o ON o.host = h.host AND o.agent = h.crawler
  LEFT JOIN (SELECT host, agent, count(*) FILTER (WHERE directive = 'disallow' AND value = '/') AS full_ FROM {_RULES} WHERE agent = '*' GROUP BY 1, 2) s ON s.host = h.host)"""
_SM = lit("sitemap_xml")
_LOCS = f"(SELECT host, url AS sitemap, unnest(regexp_extract_all(body, '(?i)<loc>\\s*([^<\\s]+)\\s*</loc>', 1)) AS loc, regexp_matches(body, '(?i)<sitemapindex') AS is_index FROM {_SM})"
_SMP = f"(SELECT DISTINCT host, loc FROM {_LOCS} s WHERE NOT is_index AND (EXISTS (SELECT 1 FROM {_LOCS} c WHERE c.is_index AND c.host = s.host AND c.loc = s.sitemap) OR NOT EXISTS (SELECT 1 FROM {_LOCS} c WHERE c.is_index AND c.host = s.host)))"
_US = lit("url_status")
_HEALTH = f"(SELECT url, CASE WHEN error = 'timeout' THEN 'timeout' WHEN error IS NOT NULL THEN 'error' WHEN status BETWEEN 400 AND 499 THEN 'not_found' WHEN status >= 500 THEN 'server_error' WHEN soft_404 THEN 'soft_404' WHEN redirect_to IS NOT NULL THEN 'redirected' ELSE 'healthy' END AS class FROM {_US})"

_BL = lit("backlink")
_CB = lit("competitor_backlink")
_BUCKET = "CASE WHEN dr <= 20 THEN '0-20' WHEN dr <= 40 THEN '21-40' WHEN dr <= 60 THEN '41-60' WHEN dr <= 80 THEN '61-80' ELSE '81-100' END"
_BRANDS = f"(SELECT DISTINCT split_part(regexp_replace(lower(regexp_extract(target_url, '^[a-z]+://([^/?#]+)', 1)), '^www\\.', ''), '.', 1) AS term FROM {_BL})"
_ACLS = f"""(SELECT seq, anchor, CASE WHEN a = '' THEN 'empty' WHEN EXISTS (SELECT 1 FROM {_BRANDS} WHERE contains(a, term)) THEN 'branded' WHEN regexp_matches(a, '^https?://|^www\\.|\\.com|\\.org|\\.net|\\.io') THEN 'url' WHEN a IN ({', '.join(O.q(g) for g in dims.GENERIC_ANCHORS)}) THEN 'generic'
  WHEN len(string_split_regex(a, '\\s+')) <= 5 AND NOT regexp_matches(a, '[!@#$%]') THEN 'exact_match' ELSE 'other' END AS class FROM (SELECT *, trim(lower(coalesce(anchor, ''))) AS a FROM {_BL}))"""
_AMIX = f"(SELECT class, count(*) AS links, array_to_string((list(coalesce(anchor, '') ORDER BY seq))[1:5], '|') AS examples, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS percent FROM {_ACLS} GROUP BY class)"


def _toxic() -> str:
    conds = {
        "low_dr_follow": lambda p: f"dr < {p} AND follow", "repeat_anchor": lambda p: f"(SELECT count(*) FROM {_BL} z WHERE z.source_domain = b.source_domain AND z.anchor IS NOT DISTINCT FROM b.anchor) > {p} AND a <> ''",
        "uniform_anchor": lambda p: f"(SELECT count(*) >= {p} AND count(DISTINCT coalesce(z.anchor, '')) = 1 FROM {_BL} z WHERE z.source_domain = b.source_domain)", "domain": lambda p: f"regexp_matches(lower(source_domain), {O.q(p)})", "anchor": lambda p: f"regexp_matches(a, {O.q(p)})",
        "tld": lambda p: f"tld IN ({', '.join(O.q(x) for x in p.split('|'))})", "long_domain": lambda p: f"length(source_domain) > {p}", "emd_low_dr": lambda p: f"len(string_split(split_part(source_domain, '.', 1), '-')) >= 3 AND dr < {p}",
    }
    each = " UNION ALL ".join(f"SELECT '{r}' AS rule, '{t}' AS tier, source_domain, seq, source_url, target_url, anchor FROM (SELECT *, lower(trim(coalesce(anchor, ''))) AS a FROM {_BL}) b WHERE {conds[k](p)}" for r, t, k, p in dims.TOXIC_RULES)
    return f"(SELECT rule, tier, source_domain, seq, substr(md5(source_url || '|' || target_url || '|' || coalesce(anchor, '')), 1, 12) AS link_id FROM ({each}) QUALIFY row_number() OVER (PARTITION BY rule, source_domain ORDER BY seq) = 1)"


_TOX = _toxic()
_TRATIO = f"(SELECT count(*) FILTER (WHERE tier = 'high') AS high, count(*) FILTER (WHERE tier = 'medium') AS medium, count(DISTINCT source_domain) AS toxic_domains, (SELECT count(DISTINCT source_domain) FROM {_BL}) AS domains, round(count(DISTINCT source_domain)::DOUBLE / (SELECT count(DISTINCT source_domain) FROM {_BL}), 3) AS ratio FROM {_TOX})"
_OVER = f"(SELECT count(*) AS backlinks, count(DISTINCT source_domain) AS domains, count(*) FILTER (WHERE follow) AS follow, round(avg(dr), 1) AS avg_dr, (list(dr ORDER BY dr))[count(*)::INT // 2 + 1] AS upper_median_dr, round(count(*) FILTER (WHERE follow)::DOUBLE / count(*), 3) AS follow_ratio FROM {_BL})"
_HPART = f"""(SELECT CASE WHEN domains >= 50 THEN 100 WHEN domains >= 20 THEN 70 WHEN domains >= 10 THEN 50 WHEN domains >= 5 THEN 30 ELSE 10 END::DOUBLE AS referring_domain_count, least(100.0::DOUBLE, greatest(0.0::DOUBLE, avg_dr * 1.2::DOUBLE)) AS domain_quality,
  CASE WHEN toxic <= 0.05 THEN 100 WHEN toxic <= 0.10 THEN 75 WHEN toxic <= 0.20 THEN 50 WHEN toxic <= 0.35 THEN 25 ELSE 0 END::DOUBLE AS toxic_ratio, CASE WHEN exact <= 10 AND branded >= 30 THEN 100 WHEN exact <= 15 AND branded >= 20 THEN 75 WHEN exact <= 20 THEN 50 WHEN exact <= 30 THEN 25 ELSE 0 END::DOUBLE AS anchor_naturalness,
  least(100.0::DOUBLE, CASE WHEN tlds >= 5 THEN 80 WHEN tlds >= 3 THEN 60 ELSE 40 END + CASE WHEN eg > 0 THEN 20 ELSE 0 END)::DOUBLE AS geographic_relevance, 50.0::DOUBLE AS velocity, CASE WHEN follow_ratio BETWEEN 0.60 AND 0.85 THEN 100 WHEN follow_ratio BETWEEN 0.50 AND 0.90 THEN 70 WHEN follow_ratio BETWEEN 0.40 AND 0.95 THEN 40 ELSE 15 END::DOUBLE AS follow_ratio
  FROM (SELECT domains, avg_dr, follow_ratio, (SELECT ratio FROM {_TRATIO}) AS toxic, coalesce((SELECT max(percent) FROM {_AMIX} WHERE class = 'exact_match'), 0) AS exact, coalesce((SELECT max(percent) FROM {_AMIX} WHERE class = 'branded'), 0) AS branded, (SELECT count(DISTINCT tld) FROM {_BL} WHERE tld <> '') AS tlds, (SELECT count(*) FROM {_BL} WHERE tld IN ('.edu', '.gov')) AS eg FROM {_OVER}))"""
_GAP = f"(SELECT coalesce(m.source_domain, t.source_domain) AS source_domain, CASE WHEN m.source_domain IS NULL THEN 'only_theirs' WHEN t.source_domain IS NULL THEN 'only_mine' ELSE 'shared' END AS side, dr, coalesce(competitors, 0)::BIGINT AS competitors FROM (SELECT DISTINCT source_domain FROM {_BL}) m FULL JOIN (SELECT source_domain, arg_max(dr, seq) AS dr, count(DISTINCT competitor) AS competitors FROM {_CB} GROUP BY 1) t ON m.source_domain = t.source_domain)"

_HF = f"(SELECT page, raw_lang, url, lower(split_part(raw_lang, '-', 1)) AS lang, CASE WHEN contains(raw_lang, '-') THEN upper(substr(raw_lang, instr(raw_lang, '-') + 1)) END AS region FROM (SELECT *, min(r) OVER (PARTITION BY page) AS best FROM (SELECT *, CASE source WHEN 'html' THEN 0 WHEN 'header' THEN 1 ELSE 2 END AS r FROM {lit('hreflang')})) WHERE r = best)"
_IN = lambda xs: "(" + ", ".join(O.q(x) for x in xs) + ")"
_LHINT = "CASE lang " + " ".join(f"WHEN {O.q(k)} THEN {O.q(v)}" for k, v in dims.LANGUAGE_MISTAKES.items()) + " END"
_HCODES = f"""(SELECT page, raw_lang, 'three_letters' AS code, {_LHINT} AS hint FROM {_HF} WHERE lower(raw_lang) <> 'x-default' AND length(lang) = 3 UNION ALL SELECT page, raw_lang, 'unknown_language', {_LHINT} FROM {_HF} WHERE lower(raw_lang) <> 'x-default' AND length(lang) <> 3 AND lang NOT IN {_IN(dims.LANGUAGES)}
  UNION ALL SELECT page, raw_lang, 'ambiguous_chinese', NULL FROM {_HF} WHERE lang = 'zh' AND region IS NULL UNION ALL SELECT page, raw_lang, 'region_mistake', CASE region WHEN 'UK' THEN 'GB' END FROM {_HF} WHERE lower(raw_lang) <> 'x-default' AND region IN ('UK', 'LA', 'EU')
  UNION ALL SELECT page, raw_lang, 'unknown_region', NULL FROM {_HF} WHERE lower(raw_lang) <> 'x-default' AND region IS NOT NULL AND region NOT IN ('UK', 'LA', 'EU', 'HANS', 'HANT') AND region NOT IN {_IN(dims.REGIONS)})"""
_HT = f"(SELECT regexp_replace(page, '/+$', '') AS page, regexp_replace(url, '/+$', '') AS url, raw_lang FROM {_HF})"
_HRET = f"(SELECT DISTINCT a.page, a.url, CASE WHEN EXISTS (SELECT 1 FROM {_HT} k WHERE k.page = a.url) THEN EXISTS (SELECT 1 FROM {_HT} k WHERE k.page = a.url AND k.url = a.page) END AS passed FROM {_HT} a WHERE a.page <> a.url AND lower(a.raw_lang) <> 'x-default')"

_CP = f"""(SELECT p.*, t.next, s.target_status, p.norm = {O.normal_a('p.url')} AS self FROM (SELECT *, {O.normal_a('abs')} AS norm FROM (SELECT *, CASE WHEN raw IS NULL THEN NULL WHEN regexp_matches(raw, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN raw ELSE {O.scheme('url')} || '://' || {O.host('url')} || raw END AS abs FROM (SELECT *, CASE WHEN canonicals IS NULL THEN 0 ELSE len(string_split(canonicals, '|')) END AS n, coalesce(split_part(canonicals, '|', 1), header_canonical) AS raw FROM {lit('canonical_page')}))) p
  LEFT JOIN (SELECT norm, min(nx) AS next FROM (SELECT {O.normal_a('url')} AS norm, {O.normal_a("CASE WHEN regexp_matches(coalesce(split_part(canonicals, '|', 1), header_canonical), '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN coalesce(split_part(canonicals, '|', 1), header_canonical) ELSE 'https://a.test' || coalesce(split_part(canonicals, '|', 1), header_canonical) END")} AS nx, canonicals, header_canonical FROM {lit('canonical_page')}) WHERE coalesce(canonicals, header_canonical) IS NOT NULL GROUP BY norm) t ON t.norm = p.norm AND p.raw IS NOT NULL
  LEFT JOIN (SELECT {O.normal_a('url')} AS norm, min(status) AS target_status FROM {lit('http_response')} GROUP BY 1) s ON s.norm = p.norm AND p.raw IS NOT NULL)"""
_SLASH = lambda u: f"({O.part(u, 3)} LIKE '%/' AND length({O.part(u, 3)}) > 1)"
_CCHECK = [
    ("several", "critical", "n > 1"), ("missing", "high", "raw IS NULL"), ("header_only", "info", "n = 0 AND raw IS NOT NULL"), ("relative", "high", "raw IS NOT NULL AND NOT regexp_matches(raw, '^[a-zA-Z][a-zA-Z0-9+.-]*://')"), ("http_on_https", "high", f"raw IS NOT NULL AND {O.scheme('abs')} = 'http' AND {O.scheme('url')} = 'https'"),
    ("www_mismatch", "high", f"raw IS NOT NULL AND starts_with({O.host('abs')}, 'www.') <> starts_with({O.host('url')}, 'www.')"), ("not_self", "info", "raw IS NOT NULL AND NOT self"), ("slash_mismatch", "warning", f"raw IS NOT NULL AND self AND {_SLASH('abs')} <> {_SLASH('url')}"), ("noindex_conflict", "critical", "raw IS NOT NULL AND contains(lower(robots), 'noindex') AND NOT self"),
    ("header_conflict", "critical", f"raw IS NOT NULL AND header_canonical IS NOT NULL AND {O.normal_a('header_canonical')} <> norm"), ("target_error", "critical", "target_status >= 400"), ("chain", "critical", "raw IS NOT NULL AND NOT self AND next IS NOT NULL AND next <> norm"),
]
_CAUDIT = "(" + " UNION ALL ".join(f"SELECT page_id, '{c}' AS code, '{s}' AS severity FROM {_CP} WHERE {w}" for c, s, w in _CCHECK) + ")"

_DAYS = "(SELECT CAST(ts AS DATE) AS day, count(*) AS events FROM events GROUP BY 1)"
_SESS = "(SELECT user_id, session, count(*) AS events, ((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000)::BIGINT AS seconds, ((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000) > 10 OR count(*) >= 2 AS engaged FROM (SELECT *, sum(new)::BIGINT OVER () AS x, (sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS session FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY 1, 2)".replace("sum(new)::BIGINT OVER () AS x, ", "")

_SEG = "CASE WHEN regexp_matches(c, '\\b(buy|price|cheap|order|deal|coupon|shop)\\b') THEN 'transactional' WHEN regexp_matches(c, '\\b(best|top|review|reviews|compare|vs)\\b') THEN 'commercial' WHEN regexp_matches(c, '\\b(login|sign in|official|website)\\b') THEN 'navigational' WHEN regexp_matches(c, '\\bnear me\\b') THEN 'local' WHEN regexp_matches(c, '^(how|what|why|when|where|who)\\b|\\b(guide|tutorial)\\b') THEN 'informational' ELSE 'unclear' END"
_GR = f"(SELECT *, CASE grade WHEN 'P' THEN 10.0 WHEN 'A' THEN 5.0 WHEN 'F' THEN 0.0 END::DOUBLE AS v FROM {lit('grade')})"

_PLAT = {}
for _p, _s, _x in dims.PLATFORM_SIGNALS:
    _PLAT.setdefault(_p, []).append(f"CASE WHEN contains(h, {O.q(_s)}) THEN {_x} ELSE 0 END")


def _platform(table: str) -> str:
    rows = " UNION ALL ".join(f"SELECT page_id, '{p}' AS n, {' + '.join(v)} AS p FROM (SELECT page_id, lower({_H}) AS h FROM {table})" for p, v in sorted(_PLAT.items()))
    return f"""SELECT t.page_id, coalesce(r[1].n, 'generic') AS platform, coalesce(r[1].p, 0)::BIGINT AS points, r[2].n AS runner_up, CASE WHEN coalesce(r[1].p, 0) >= 6 THEN 'high' WHEN coalesce(r[1].p, 0) >= 3 THEN 'medium' WHEN coalesce(r[1].p, 0) > 0 THEN 'low' ELSE 'none' END AS confidence
      FROM {table} t LEFT JOIN (SELECT page_id, list({{'p': p, 'n': n}} ORDER BY p DESC, n) AS r FROM ({rows}) WHERE p > 0 GROUP BY page_id) USING (page_id)"""


_IMGS = f"""(SELECT page_id, (i - 1)::INT AS pos, {O.attr('t', 'src')} AS src, {O.attr('t', 'alt')} AS alt, lower(coalesce({O.attr('t', 'loading')}, '')) AS loading, lower(coalesce({O.attr('t', 'fetchpriority')}, '')) AS fetchpriority, lower(regexp_extract(coalesce({O.attr('t', 'src')}, ''), '^[^?#]*(\\.[^.?#]*)(?:[?#].*)?$', 1)) AS extension,
  coalesce({O.attr('t', 'srcset')} <> '', false) AS has_srcset, coalesce({O.attr('t', 'sizes')} <> '', false) AS has_sizes, coalesce({O.attr('t', 'width')} <> '', false) AND coalesce({O.attr('t', 'height')} <> '', false) AS has_dimensions FROM (SELECT page_id, ts[i] AS t, i FROM (SELECT page_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT page_id, {O.tags(_H, 'img')} AS ts FROM {_HEAD}))))"""
_IMG = f"""SELECT page_id, total, missing_alt, empty_alt, missing_srcset, missing_sizes, missing_dimensions, raster, lazy_first, CASE WHEN total = 0 THEN 70 ELSE greatest(0, 100 - (CASE WHEN pct > 25 THEN 30 WHEN pct > 10 THEN 15 WHEN pct > 0 THEN 5 ELSE 0 END + CASE WHEN lazy_first THEN 20 ELSE 0 END + CASE WHEN missing_dimensions > total // 2 THEN 10 ELSE 0 END + CASE WHEN raster > 0 THEN 5 ELSE 0 END)) END::BIGINT AS score
  FROM (SELECT *, round(100.0::DOUBLE * missing_alt / greatest(total, 1), 1) AS pct FROM (SELECT h.page_id, count(i.pos) AS total, count(i.pos) FILTER (WHERE alt IS NULL) AS missing_alt, count(i.pos) FILTER (WHERE trim(alt) = '') AS empty_alt, count(i.pos) FILTER (WHERE NOT has_srcset) AS missing_srcset, count(i.pos) FILTER (WHERE has_srcset AND NOT has_sizes) AS missing_sizes, count(i.pos) FILTER (WHERE NOT has_dimensions) AS missing_dimensions,
  count(i.pos) FILTER (WHERE extension IN ('.jpg', '.jpeg', '.png', '.gif', '.bmp', '.tiff')) AS raster, coalesce(arg_min(loading = 'lazy', i.pos), false) AS lazy_first FROM {_HEAD} h LEFT JOIN {_IMGS} i USING (page_id) GROUP BY h.page_id))"""
_METAS = lambda table: f"(SELECT page_id, html, list_transform({O.tags(_H, 'meta')}, lambda t: {{'k': lower(coalesce({O.attr('t', 'property')}, {O.attr('t', 'name')}, '')), 'v': coalesce({O.attr('t', 'content')}, '')}}) AS m FROM {table})"


def _social(table: str) -> str:
    tags = dims.values_sql(dims.SOCIAL_TAGS, "tag, required, lo, hi, allowed", ("VARCHAR", "BOOLEAN", "INTEGER", "INTEGER", "VARCHAR"))
    return f"""(SELECT page_id, tag, required, coalesce(value <> '', false) AS present, coalesce(value <> '' AND (lo IS NULL OR length(value) >= lo) AND (hi IS NULL OR length(value) <= hi) AND (allowed IS NULL OR list_contains(string_split(allowed, '|'), value)) AND (tag NOT IN ('og:image', 'og:url') OR regexp_matches(value, '^https?://')), false) AS ok
      FROM (SELECT page_id, d.*, (list_filter(m, lambda x: x.k = d.tag))[-1].v AS value FROM {_METAS(table)}, {tags} d))"""


ORACLES: dict[str, str] = {
    "thin_content": f"SELECT page_id, host, words, CASE WHEN words < 100 THEN 'critical' ELSE 'warning' END AS severity FROM {_WORDS} WHERE words < 300",
    "host_word_stats": f"SELECT host, count(*) AS pages, count(*) FILTER (WHERE words < 300) AS thin_pages, round(avg(words), 2) AS avg_words, min(words) AS min_words, max(words) AS max_words, greatest(0, 100 - 10 * count(*) FILTER (WHERE words < 300))::BIGINT AS score FROM {_WORDS} GROUP BY host",
    "page_facts": f"SELECT * FROM {_PF}", "title_meta_lengths": _lengths(_PF), "head_facts": f"SELECT * FROM {_facts(_HEAD)}",
    "length_scores": f"SELECT p.page_id, coalesce(min(CASE severity WHEN 'critical' THEN 40 WHEN 'high' THEN 60 WHEN 'warning' THEN 80 WHEN 'info' THEN 90 END), 100)::BIGINT AS score FROM pages p LEFT JOIN (SELECT * FROM ({_lengths(_PF)}) WHERE code <> 'title_repeated') USING (page_id) GROUP BY 1",
    "onpage_scores": f"SELECT page_id, (50 + CASE WHEN title IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN meta_description IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN n_h1 > 0 THEN 10 ELSE 0 END + CASE WHEN canonical IS NOT NULL THEN 10 ELSE 0 END)::BIGINT AS score FROM {_PF}",
    "title_uniqueness": f"SELECT {O.host('url')} AS host, lower(title) AS value, count(*) AS pages FROM {_PF} JOIN pages USING (page_id) WHERE title IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
    "h1_uniqueness": f"SELECT {O.host('url')} AS host, lower(first_h1) AS value, count(*) AS pages FROM {_PF} JOIN pages USING (page_id) WHERE first_h1 IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
    "template_groups": f"""SELECT *, CASE WHEN thin_pages * 2 > pages THEN 'high' WHEN (titles < pages)::INT + (h1s < pages)::INT + (thin_pages > 0)::INT > 2 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT {_PATTERN} AS pattern, count(*) AS pages, round(avg(words), 1) AS avg_words, min(words) AS min_words, max(words) AS max_words, count(*) FILTER (WHERE words < 300) AS thin_pages, count(DISTINCT lower(title)) AS titles, count(DISTINCT lower(first_h1)) AS h1s
      FROM pages JOIN {_PF} f USING (page_id) JOIN {_WORDS} w USING (page_id) GROUP BY 1 HAVING count(*) >= 3)""",
    "severity_totals": f"SELECT CASE WHEN severity IN ('critical', 'high') THEN 'critical' WHEN severity IN ('warning', 'medium') THEN 'warning' ELSE 'info' END AS severity, count(*) AS findings FROM (SELECT severity FROM ({_lengths(_PF)}) UNION ALL SELECT CASE WHEN words < 100 THEN 'critical' ELSE 'warning' END FROM {_WORDS} WHERE words < 300) GROUP BY 1",
    "platform_detection": _platform("pages"), "platform_hints": _platform(lit("page_html_hint")),
    "soft_404_pages": f"SELECT page_id, title FROM {_PF} WHERE regexp_matches(lower(coalesce(title, '')), 'page not found|404|not found|no longer available|does not exist|page doesn''t exist|page has been removed')",
    "image_list": f"SELECT * FROM {_IMGS}", "image_scores": _IMG, "social_checks": f"SELECT * FROM {_social(_HEAD)}",
    "social_scores": f"SELECT page_id, count(*) FILTER (WHERE present) AS present, count(*) FILTER (WHERE required AND NOT present) AS missing_required, count(*) FILTER (WHERE present AND NOT ok) AS out_of_bounds, round(100.0::DOUBLE * count(*) FILTER (WHERE present) / 13)::BIGINT AS score FROM {_social(_HEAD)} GROUP BY 1",
    "social_previews": f"SELECT page_id, coalesce((list_filter(m, lambda x: x.k = 'og:title' AND trim(x.v) <> ''))[1].v, (list_filter(m, lambda x: x.k = 'twitter:title' AND trim(x.v) <> ''))[1].v, ({O.elements(_H, 'title')})[1]) AS title, coalesce((list_filter(m, lambda x: x.k = 'og:description' AND trim(x.v) <> ''))[1].v, (list_filter(m, lambda x: x.k = 'twitter:description' AND trim(x.v) <> ''))[1].v, (list_filter(m, lambda x: x.k = 'description' AND trim(x.v) <> ''))[1].v) AS description, coalesce((list_filter(m, lambda x: x.k = 'og:image' AND trim(x.v) <> ''))[1].v, (list_filter(m, lambda x: x.k = 'twitter:image' AND trim(x.v) <> ''))[1].v) AS image FROM {_METAS(_HEAD)}",
    "local_scores": f"""SELECT page_id, local_business, organization, tel_links, mail_links, address, map, CASE WHEN tel_links > 0 OR address OR map OR local_business THEN least(100, 40 + CASE WHEN local_business THEN 35 ELSE 0 END + CASE WHEN organization AND NOT local_business THEN 10 ELSE 0 END + CASE WHEN tel_links > 0 THEN 10 ELSE 0 END + CASE WHEN address THEN 5 ELSE 0 END + CASE WHEN map THEN 5 ELSE 0 END) END::BIGINT AS score
      FROM (SELECT page_id, regexp_matches(html, '(?i)"@type"\\s*:\\s*"LocalBusiness"') AS local_business, regexp_matches(html, '(?i)"@type"\\s*:\\s*"Organization"') AS organization, len(regexp_extract_all(html, '(?i)href=["'']tel:')) AS tel_links, len(regexp_extract_all(html, '(?i)href=["'']mailto:')) AS mail_links, regexp_matches(html, '(?i)(streetAddress|postalCode|addressLocality|Address")') AS address, regexp_matches(html, '(?i)google\\.com/maps|maps\\.app\\.goo\\.gl') AS map FROM {_HEAD})""",
    "url_parts": f"SELECT page_id, {O.scheme('url')} AS scheme, {O.host('url')} AS host, {O.part('url', 3)} AS path, {O.part('url', 4)} AS query, {O.part('url', 5)} AS fragment, regexp_extract({O.host('url')}, '(\\.[a-z0-9-]+)(?::[0-9]+)?$', 1) AS tld, len({O.segments('url')})::BIGINT AS depth FROM pages",
    "url_normal_forms": f"SELECT page_id, {O.normal_a('url')} AS form_a, {O.normal_b('url')} AS form_b, CASE WHEN {O.scheme('url')} IN ('http', 'https') THEN {O.normal_b('url')} END AS form_c, {O.normal_d('url')} AS form_d, {O.template('url')} AS pattern FROM pages",
    "url_hygiene_classes": f"SELECT {_HYG('url')} AS class, count(*) AS urls FROM pages GROUP BY 1",
    "url_standards": f"SELECT count(*) FILTER (WHERE regexp_matches({O.part('url', 3)}, '[A-Z]')) AS upper_case, count(*) FILTER (WHERE contains({O.part('url', 3)}, '_')) AS underscores, count(*) FILTER (WHERE length(url) > 100) AS too_long, count(*) FILTER (WHERE {O.part('url', 5)} <> '') AS fragments, count(*) FILTER (WHERE {O.part('url', 4)} <> '') AS parameters FROM pages",
    "http_vs_https": f"SELECT {O.host('url')} AS host, count(*) FILTER (WHERE {O.scheme('url')} = 'http') AS http_urls, count(*) FILTER (WHERE {O.scheme('url')} = 'https') AS https_urls FROM pages GROUP BY 1 HAVING count(*) FILTER (WHERE {O.scheme('url')} = 'http') > 0 AND count(*) FILTER (WHERE {O.scheme('url')} = 'https') > 0",
    "www_overlap": f"SELECT regexp_replace({O.host('url')}, '^www\\.', '') AS host, regexp_replace({O.normal_d('url')}, '^www\\.', '') AS path FROM pages WHERE starts_with({O.host('url')}, 'www.') INTERSECT SELECT {O.host('url')}, {O.normal_d('url')} FROM pages WHERE NOT starts_with({O.host('url')}, 'www.')",
    "link_edges": f"SELECT * FROM {_EDGES}", "anchor_top20": f"SELECT anchor, count(*) AS links FROM {_EDGES} WHERE anchor <> '[no text]' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "out_degree_stats": f"SELECT min(n) AS min_links, max(n) AS max_links, round(avg(n), 1) AS avg_links, count(*) FILTER (WHERE n < 3) AS few_links, count(*) FILTER (WHERE n > 100) AS many_links FROM (SELECT p.page_id, count(e.target) AS n FROM pages p LEFT JOIN {_EDGES} e USING (page_id) GROUP BY 1)",
    "in_out_degree": f"SELECT * FROM {_DEG}", "orphans_le1": f"SELECT page_id, in_degree FROM {_DEG} WHERE in_degree <= 1", "orphans_zero_in": f"SELECT page_id, {O.normal_b('url')} AS target FROM pages WHERE {O.normal_b('url')} NOT IN (SELECT target FROM {_EDGES})",
    "dead_ends": f"SELECT page_id, url FROM pages WHERE page_id NOT IN (SELECT page_id FROM {_EDGES})", "top_linked": f"SELECT target, count(DISTINCT page_id) AS linking_pages, count(*) FILTER (WHERE nofollow) AS nofollow_links FROM {_EDGES} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "broken_targets": f"SELECT target, count(DISTINCT page_id) AS linking_pages, array_to_string((list(DISTINCT page_id ORDER BY page_id))[1:5], ',') AS examples FROM {_EDGES} WHERE target NOT IN (SELECT {O.normal_b('url')} FROM pages) GROUP BY 1",
    "external_domains": f"SELECT {O.host('target')} AS domain, count(DISTINCT target) AS urls FROM {_EDGE_RAW} WHERE NOT internal GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
    "anchor_diversity": f"SELECT target, count(*) AS links, count(DISTINCT lower(anchor)) AS anchors, round(count(DISTINCT lower(anchor))::DOUBLE / count(*), 3) AS diversity FROM {_EDGES} GROUP BY 1 HAVING count(*) > 1",
    "template_cross_links": f"SELECT a.pattern, count(*) AS cross_links, count(DISTINCT a.page_id) AS linking_pages FROM (SELECT page_id, {_PATTERN} AS pattern FROM pages) a JOIN {_EDGES} e USING (page_id) JOIN (SELECT page_id AS to_id, {O.normal_b('url')} AS target, {_PATTERN} AS pattern FROM pages) t ON t.target = e.target AND t.pattern = a.pattern AND t.to_id <> a.page_id GROUP BY 1",
    "reach_depth": f"WITH RECURSIVE e AS (SELECT DISTINCT {O.normal_b('p.url')} AS src, g.target AS dst FROM {_EDGES} g JOIN pages p USING (page_id)), r(node, depth) AS (SELECT min({O.normal_b('url')}), 0::BIGINT FROM pages GROUP BY {O.host('url')} UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 3) SELECT depth, count(*) AS nodes FROM (SELECT node, min(depth) AS depth FROM r GROUP BY 1) GROUP BY 1",
    "redirect_chains": f"WITH RECURSIVE h AS (SELECT * FROM {lit('redirect')}), r AS (SELECT src, dst AS final, 1::BIGINT AS hops, src = dst AS loop, status IN (302, 307) AS temporary, [src, dst] AS path FROM h UNION ALL SELECT r.src, h.dst, r.hops + 1, list_contains(r.path, h.dst), r.temporary OR h.status IN (302, 307), list_append(r.path, h.dst) FROM r JOIN h ON h.src = r.final WHERE NOT r.loop AND r.hops < 10) SELECT src, final, hops, loop, temporary FROM r QUALIFY row_number() OVER (PARTITION BY src ORDER BY hops DESC) = 1",
    "exact_dups": f"SELECT {_DIGEST} AS digest, count(*) AS docs, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "thin_texts": f"SELECT doc_id, words, CASE WHEN words < 100 THEN 'critical' ELSE 'warning' END AS severity FROM (SELECT doc_id, len({O.words('text')})::BIGINT AS words FROM documents) WHERE words < 300",
    "near_dups_minhash": f"""WITH s AS (SELECT doc_id, {_DIGEST} AS exact, {_SH(5)} AS sh FROM (SELECT doc_id, text, {_ASC} AS w FROM documents)), g AS (SELECT doc_id, exact, list_transform({_COEF}, lambda c: list_min(list_transform(h, lambda x: (x * c[1] + c[2]) % 2147483647))) AS sig FROM (SELECT doc_id, exact, list_transform(sh, lambda x: ('0x' || substr(md5(x), 1, 15))::BIGINT % 2147483647) AS h FROM s WHERE len(sh) > 0)),
      r AS (SELECT doc_id, exact, min(doc_id) OVER (PARTITION BY sig) AS rep FROM g), f AS (SELECT doc_id, unnest(range(1, 101)) AS i, unnest(sig) AS v FROM g), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM f a JOIN f b ON a.i = b.i AND a.v = b.v AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING count(*) >= 85) SELECT p.a, p.b, n / 100.0::DOUBLE AS similarity FROM p JOIN r x ON x.doc_id = p.a JOIN r y ON y.doc_id = p.b WHERE x.exact <> y.exact AND (p.b = y.rep OR x.rep = y.rep) AND p.a = x.rep""",
    "boilerplate_ratio": f"""WITH s AS (SELECT source, doc_id, unnest({_SH(5)}) AS sh FROM (SELECT source, doc_id, {_ASC} AS w FROM documents)), n AS (SELECT source, count(*) AS docs FROM documents GROUP BY 1), c AS (SELECT s.source, sh FROM s JOIN n USING (source) GROUP BY 1, 2, docs HAVING count(*) >= greatest(2.0, 0.8 * docs)),
      d AS (SELECT s.source, s.doc_id, count(c.sh)::DOUBLE / count(*) AS x FROM s LEFT JOIN c ON c.source = s.source AND c.sh = s.sh GROUP BY 1, 2) SELECT n.source, n.docs, (SELECT count(*) FROM c WHERE c.source = n.source) AS common_shingles, coalesce(round((SELECT avg(x) FROM d WHERE d.source = n.source), 4), 0.0::DOUBLE) AS mean_share FROM n""",
    "benchmark_overlap": f"SELECT doc_id, item_id, count(*) AS shared FROM (SELECT doc_id, unnest({_SH(8)}) AS sh FROM (SELECT doc_id, {_ASC} AS w FROM documents)) JOIN (SELECT item_id, unnest({_SH(8)}) AS sh FROM (SELECT item_id, {_ASC} AS w FROM benchmark)) USING (sh) GROUP BY 1, 2",
    "readability_a": f"SELECT *, {_LEVEL} AS level FROM {_READ_A}", "reading_levels": f"SELECT {_LEVEL} AS level, count(*) AS docs, round(avg(reading_ease), 2) AS avg_ease FROM {_READ_A} GROUP BY 1", "quality_by_readability": f"SELECT {_LEVEL} AS level, count(*) AS docs, round(avg(quality::DOUBLE), 4) AS share_good FROM {_READ_A} JOIN labels USING (doc_id) GROUP BY 1",
    "readability_b": f"SELECT *, CASE WHEN reading_ease >= 70 THEN 'easy' WHEN reading_ease >= 50 THEN 'medium' ELSE 'difficult' END AS label FROM (SELECT *, {_EASE} AS reading_ease, {_GRADE} AS grade FROM (SELECT doc_id, greatest(1, len(w))::BIGINT AS words, greatest(1, len(list_filter(string_split_regex(text, '[.!?]+'), lambda x: trim(x) <> '')))::BIGINT AS sentences, coalesce(list_sum(list_transform(w, lambda x: CASE WHEN length(x) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(lower(x), '[aeiouy]+')) - CASE WHEN lower(x) LIKE '%e' THEN 1 ELSE 0 END) END)), 0)::BIGINT AS syllables FROM (SELECT doc_id, text, regexp_extract_all(text, '[a-zA-Z''-]+') AS w FROM documents WHERE trim(text) <> '')))",
    "keyword_ngrams": f"""WITH d AS (SELECT doc_id, list_filter({_ASC}, lambda x: length(x) >= 3 AND NOT list_contains({_STOP}, x)) AS w FROM documents), g AS (SELECT doc_id, n, unnest(list_transform(range(1, greatest(1, len(w) - n + 2)), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS term FROM d, (VALUES (1), (2), (3)) v(n)),
      c AS (SELECT doc_id, n, term, count(*) AS c FROM g GROUP BY 1, 2, 3 HAVING count(*) > CASE WHEN n = 1 THEN 3 ELSE 1 END), t AS (SELECT doc_id, term, (c * CASE n WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 5 END)::BIGINT AS score FROM c), p AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) <= 36),
      l AS (SELECT * FROM t a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.doc_id = a.doc_id AND b.term <> a.term AND contains(b.term, a.term))) SELECT doc_id, term, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM l QUALIFY rank <= 12""",
    "long_sentences_topk": f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, i) AS rank, words, sentence FROM (SELECT doc_id, i, s[i] AS sentence, len({O.words('s[i]')})::BIGINT AS words FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {_SENT} AS s FROM documents))) QUALIFY rank <= 5",
    "citable_passages": f"SELECT doc_id, (i - 1)::BIGINT AS pos, words, CASE WHEN (i - 1) * 3 < n THEN 'first' WHEN (i - 1) * 3 < n * 2 THEN 'middle' ELSE 'last' END AS third FROM (SELECT doc_id, i, len(p) AS n, len({O.words('p[i]')})::BIGINT AS words FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))) WHERE words BETWEEN 134 AND 167",
    "keyword_density": f"WITH d AS (SELECT doc_id, {_ASC} AS w FROM documents), c AS (SELECT doc_id, n, x, count(*) AS c FROM (SELECT doc_id, len(w) AS n, unnest(list_filter(w, lambda z: length(z) >= 3 AND NOT list_contains({_STOP}, z))) AS x FROM d) GROUP BY 1, 2, 3), t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, x DESC) = 1) SELECT doc_id, x AS word, c AS uses, round(c::DOUBLE / n, 4) AS share FROM t WHERE round(c::DOUBLE / n, 4) > 0.03",
    "robots_parse": f"SELECT * FROM {_RULES}", "ai_crawler_status": f"SELECT * FROM {_AIC}", "crawl_delays": f"SELECT host, agent, try_cast(value AS DOUBLE) AS seconds FROM {_RULES} WHERE directive = 'crawl-delay'",
    "robots_scores": f"SELECT host, sitemaps, managed, CASE WHEN status = 200 THEN 60 + CASE WHEN sitemaps > 0 THEN 20 ELSE 0 END + least(20, 2 * managed) WHEN status = 404 THEN 20 ELSE 0 END::BIGINT AS score FROM (SELECT host, status, (SELECT count(*) FROM {_RULES} r WHERE r.host = b.host AND directive = 'sitemap') AS sitemaps, (SELECT count(*) FROM {_AIC} a WHERE a.host = b.host AND crawler_status NOT IN ('unmanaged', 'inherits_star', 'no_robots')) AS managed FROM {_RB} b)",
    "sitemap_locs": f"SELECT * FROM {_LOCS}", "sitemap_pages": f"SELECT * FROM {_SMP}", "sitemap_hygiene": f"SELECT host, {_HYG('loc')} AS class, count(*) AS urls FROM {_SMP} GROUP BY 1, 2",
    "sitemap_vs_crawl": f"SELECT CASE WHEN s.url IS NULL THEN 'crawl_only' WHEN c.url IS NULL THEN 'sitemap_only' ELSE 'both' END AS side, count(*) AS urls FROM (SELECT DISTINCT {O.normal_a('loc')} AS url FROM {_SMP}) s FULL JOIN (SELECT DISTINCT {O.normal_a('url')} AS url FROM pages) c ON s.url = c.url GROUP BY 1",
    "url_health": f"SELECT class, count(*) AS urls FROM {_HEALTH} GROUP BY 1", "broken_link_score": f"SELECT checked, broken, soft, greatest(0, 100 - floor((broken + soft) * 300 / greatest(checked, 1)))::BIGINT AS score FROM (SELECT count(*) AS checked, count(*) FILTER (WHERE class IN ('not_found', 'server_error', 'timeout', 'error')) AS broken, count(*) FILTER (WHERE class = 'soft_404') AS soft FROM {_HEALTH})",
    "llms_items": f"SELECT host, line_no, section, regexp_extract(line, p, 1) AS title, regexp_extract(line, p, 2) AS url, regexp_extract(line, p, 3) AS description FROM (SELECT *, last_value(CASE WHEN starts_with(line, '## ') THEN trim(substr(line, 4)) END IGNORE NULLS) OVER (PARTITION BY host ORDER BY line_no) AS section, '^-\\s*\\[([^\\]]+)\\]\\(([^)]+)\\)(?::\\s*(.*))?' AS p FROM (SELECT host, (i - 1)::BIGINT AS line_no, trim(ls[i]) AS line FROM (SELECT host, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT host, string_split(body, chr(10)) AS ls FROM {lit('llms_txt')})))) WHERE starts_with(line, '- [') AND regexp_matches(line, '^-\\s*\\[([^\\]]+)\\]\\(([^)]+)\\)')".replace("regexp_extract(line, p,", "regexp_extract(line, '^-\\s*\\[([^\\]]+)\\]\\(([^)]+)\\)(?::\\s*(.*))?',").replace(", '^-\\s*\\[([^\\]]+)\\]\\(([^)]+)\\)(?::\\s*(.*))?' AS p FROM", " FROM"),
    "llms_scores": f"""SELECT host, sections, links, description_length, least(100, CASE WHEN title THEN 20 ELSE 0 END + CASE WHEN description_length > 0 THEN 20 ELSE 0 END + CASE WHEN description_length > 50 THEN 5 ELSE 0 END + CASE WHEN sections > 0 THEN 15 ELSE 0 END + CASE WHEN sections >= 3 THEN 5 ELSE 0 END + CASE WHEN links > 0 THEN 20 ELSE 0 END + CASE WHEN links >= 5 THEN 5 ELSE 0 END + CASE WHEN links >= 10 THEN 5 ELSE 0 END + CASE WHEN n > 200 THEN 5 ELSE 0 END)::BIGINT AS score
      FROM (SELECT host, starts_with(ls[1], '# ') AS title, length(body) AS n, length(array_to_string(list_transform(list_filter(ls[2:], lambda x: starts_with(x, '> ')), lambda x: trim(substr(x, 3))), ' '))::BIGINT AS description_length, len(list_filter(ls[2:], lambda x: starts_with(x, '## ')))::BIGINT AS sections, len(list_filter(ls[2:], lambda x: regexp_matches(x, '^- ?\\[[^\\]]+\\]\\([^)]+\\)')))::BIGINT AS links FROM (SELECT host, body, list_transform(string_split(trim(body), chr(10)), lambda x: trim(x)) AS ls FROM {lit('llms_txt')}))""",
    "security_scores": f"SELECT url, present, 6 - present AS missing, hsts_weak, least(100, CASE WHEN https THEN 25 ELSE 0 END + w)::BIGINT AS score FROM (SELECT url, https, (" + " + ".join(f"({h} IS NOT NULL)::BIGINT" for h in dims.SECURITY_HEADERS) + ") AS present, (" + " + ".join(f"CASE WHEN {h} IS NOT NULL THEN {w} ELSE 0 END" for h, w in dims.SECURITY_HEADERS.items()) + f") AS w, hsts IS NOT NULL AND (coalesce(try_cast(nullif(regexp_extract(lower(hsts), 'max-age=([0-9]+)', 1), '') AS BIGINT) < 31536000, false) OR NOT contains(lower(hsts), 'includesubdomains')) AS hsts_weak FROM {lit('http_response')})",
    "redirect_findings": " UNION ALL ".join(f"SELECT url, '{c}' AS code, '{s}' AS severity FROM {lit('http_response')} WHERE {w}" for c, s, w in (("long_chain", "warning", "hops > 2"), ("chain", "info", "hops = 2"), ("mixed_protocol", "warning", "mixed"), ("temporary", "info", "temporary"), ("client_error", "critical", "status BETWEEN 400 AND 499"), ("server_error", "critical", "status >= 500"))),
    "redirect_map_check": f"SELECT old_url, CASE WHEN status >= 400 OR actual IS NULL THEN 'broken' WHEN regexp_replace(expected, '/+$', '') <> regexp_replace(actual, '/+$', '') THEN 'wrong_target' WHEN status <> 301 THEN 'not_permanent' ELSE 'ok' END AS verdict FROM {lit('redirect_map')}",
    "canonical_audit": f"SELECT * FROM {_CAUDIT}", "canonical_scores": f"SELECT c.page_id, greatest(0, 100 - coalesce(sum(CASE severity WHEN 'critical' THEN 30 WHEN 'high' THEN 20 WHEN 'warning' THEN 10 ELSE 0 END), 0))::BIGINT AS score FROM {lit('canonical_page')} c LEFT JOIN {_CAUDIT} a USING (page_id) GROUP BY 1",
    "canonical_groups": f"SELECT norm AS canonical, count(*) AS pages, count(*) FILTER (WHERE norm <> own) AS not_self FROM (SELECT {O.normal_a('url')} AS own, norm FROM {_CP} WHERE canonicals IS NOT NULL) GROUP BY 1 HAVING count(*) > 1 AND count(*) FILTER (WHERE norm <> own) > 0",
    "hreflang_codes": f"SELECT * FROM {_HCODES}", "hreflang_return_tags": f"SELECT * FROM {_HRET}",
    "hreflang_pages": f"""SELECT page, tags, self_reference, x_default, protocols, bad_codes, missing_returns, greatest(0, 100 - (CASE WHEN self_reference THEN 0 ELSE 30 END + 30 * missing_returns + CASE WHEN x_default <> 1 THEN 15 ELSE 0 END + 15 * bad_codes + CASE WHEN protocols > 1 THEN 5 ELSE 0 END))::BIGINT AS score FROM (SELECT t.page, count(*) AS tags, bool_or(regexp_replace(t.page, '/+$', '') = regexp_replace(t.url, '/+$', '')) AS self_reference, count(*) FILTER (WHERE lower(raw_lang) = 'x-default') AS x_default, count(DISTINCT {O.scheme('t.url')}) AS protocols,
      (SELECT count(*) FROM {_HCODES} c WHERE c.page = t.page) AS bad_codes, (SELECT count(*) FROM {_HRET} r WHERE r.page = regexp_replace(t.page, '/+$', '') AND passed = false) AS missing_returns FROM {_HF} t GROUP BY t.page)""",
    "cwv_p75_rating": f"SELECT page, metric, p75, CASE WHEN p75 <= CASE metric WHEN 'LCP' THEN 2500 WHEN 'INP' THEN 200 ELSE 0.1 END THEN 'good' WHEN p75 <= CASE metric WHEN 'LCP' THEN 4000 WHEN 'INP' THEN 500 ELSE 0.25 END THEN 'needs_improvement' ELSE 'poor' END AS rating FROM (SELECT page, metric, round(quantile_cont(value, 0.75), 6) AS p75 FROM {lit('cwv')} GROUP BY 1, 2)",
    "psi_facts": f"SELECT url, round(try_cast(json_extract_string(j, '$.lighthouseResult.categories.performance.score') AS DOUBLE) * 100)::BIGINT AS performance, try_cast(json_extract_string(j, '$.lighthouseResult.audits.lcp.numericValue') AS DOUBLE) AS lcp_ms, (coalesce(try_cast(json_extract_string(j, '$.lighthouseResult.audits.unused.details.overallSavingsMs') AS DOUBLE) > 100, false)::INT + coalesce(try_cast(json_extract_string(j, '$.lighthouseResult.audits.tiny.details.overallSavingsMs') AS DOUBLE) > 100, false)::INT)::BIGINT AS savings FROM (SELECT url, CASE WHEN json_valid(body) THEN body END AS j FROM {lit('psi')})",
    "indexnow_scores": f"SELECT host, (CASE WHEN key_ok THEN 40 ELSE 0 END + CASE WHEN meta_key THEN 20 ELSE 0 END + CASE WHEN endpoint_ok THEN 30 ELSE 0 END + CASE WHEN robots_ok THEN 10 ELSE 0 END)::BIGINT AS score FROM {lit('indexnow')}",
    "backlink_overview": f"SELECT * FROM {_OVER}", "dr_buckets": f"SELECT {_BUCKET} AS bucket, count(*) AS backlinks FROM {_BL} GROUP BY 1", "anchor_mix": f"SELECT * FROM {_AMIX}", "top_anchors": f"SELECT anchor, count(*) AS links FROM {_BL} WHERE anchor <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15", "tld_mix": f"SELECT tld, count(*) AS links FROM {_BL} WHERE tld <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "domain_ratings": f"SELECT source_domain, dr, {_BUCKET} AS bucket FROM (SELECT source_domain, arg_max(dr, seq) AS dr FROM {_BL} GROUP BY 1)", "top_targets": f"SELECT target_url, count(*) AS backlinks, count(DISTINCT source_domain) AS domains, count(*) FILTER (WHERE follow) AS follow, count(*) FILTER (WHERE NOT follow) AS nofollow FROM {_BL} GROUP BY 1",
    "toxic_links": f"SELECT * FROM {_TOX}", "toxic_ratio": f"SELECT * FROM {_TRATIO}", "backlink_health": f"SELECT *, round(" + " + ".join(f"{k} * {w}::DOUBLE" for k, w in dims.HEALTH_WEIGHTS.items()) + f", 1) AS score FROM {_HPART}",
    "backlink_issues": f"SELECT component, score, CASE WHEN score < 25 THEN 'critical' WHEN score < 50 THEN 'warning' ELSE 'info' END AS severity FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS component, {k} AS score FROM {_HPART}" for k in dims.HEALTH_WEIGHTS) + ") WHERE score < 60",
    "disavow_lines": f"SELECT DISTINCT CASE WHEN count(*) OVER (PARTITION BY source_domain) >= 3 THEN 'domain:' || source_domain ELSE source_url END AS line FROM (SELECT DISTINCT source_domain, source_url FROM {_BL} WHERE source_domain IN (SELECT source_domain FROM {_TOX} WHERE tier = 'high'))",
    "competitor_gap": f"SELECT * FROM {_GAP}", "gap_opportunities": f"SELECT source_domain, dr, competitors, CASE WHEN competitors >= 2 THEN 'high' WHEN dr >= 50 THEN 'medium' ELSE 'low' END AS priority FROM {_GAP} WHERE side = 'only_theirs' ORDER BY dr DESC, source_domain LIMIT 20",
    "anchor_naturalness": "SELECT round(off, 1) AS deviation, round(greatest(0.0::DOUBLE, 100.0::DOUBLE - 1.5::DOUBLE * off), 1) AS score FROM (SELECT " + " + ".join(f"abs(coalesce(max(percent) FILTER (WHERE class = '{k}'), 0.0::DOUBLE) - {v}::DOUBLE)" for k, v in (("branded", 40.0), ("exact_match", 5.0), ("generic", 15.0), ("url", 20.0), ("other", 15.0), ("empty", 5.0))) + f" AS off FROM {_AMIX})",
    "link_rollup_by_nation": "SELECT n_name, count(*) AS links, count(DISTINCT l_suppkey) AS domains, count(DISTINCT l_partkey) AS targets FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1",
    "assertion_eval": f"SELECT assert_id, kind, count(*) AS turns, count(*) FILTER (WHERE ok) AS passed, bool_and(ok) AS all_passed FROM (SELECT a.assert_id, a.kind, CASE a.kind WHEN 'contains_any' THEN hits > 0 WHEN 'contains_all' THEN hits = len(string_split(terms, '|')) WHEN 'not_contains_any' THEN hits = 0 WHEN 'contains_pattern' THEN regexp_matches(text, '(?is)' || replace(terms, '(?i)', '')) ELSE NOT regexp_matches(text, '(?is)' || replace(terms, '(?i)', '')) END AS ok FROM (SELECT a.*, c.text, len(list_filter(string_split(terms, '|'), lambda x: contains(c.text, x))) AS hits FROM {lit('assertion')} a JOIN conversations c USING (role)) a) GROUP BY 1, 2".replace("{lit('assertion')}", lit("assertion")),
    "overall_score": f"SELECT site, sections, weight, overall, CASE WHEN overall >= 90 THEN 'A' WHEN overall >= 80 THEN 'B' WHEN overall >= 70 THEN 'C' WHEN overall >= 60 THEN 'D' WHEN overall >= 50 THEN 'E' ELSE 'F' END AS letter FROM (SELECT site, count(w) AS sections, coalesce(sum(w), 0)::BIGINT AS weight, coalesce(round(sum(score * w) / sum(w)), 0)::BIGINT AS overall FROM (SELECT site, score, CASE WHEN score IS NOT NULL THEN CASE section " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in dims.SECTION_WEIGHTS.items()) + f" END END AS w FROM {lit('section_score')}) GROUP BY 1)",
    "weighted_grade": f"""SELECT *, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 60 THEN 'fair' WHEN score >= 40 THEN 'weak' ELSE 'poor' END AS band FROM (SELECT page, kind, raw, dims, vetoed, CASE WHEN vetoed > 0 THEN least(raw, 60.0::DOUBLE) ELSE raw END AS score FROM (SELECT page, kind, round(10.0::DOUBLE * sum(mean * weight) / sum(weight), 2) AS raw, count(*) AS dims FROM (SELECT page, dim, avg(v) AS mean FROM {_GR} GROUP BY 1, 2 HAVING count(*) FILTER (WHERE grade = 'N') * 2 <= count(*) AND avg(v) IS NOT NULL) JOIN {lit('grade_weight')} USING (dim) GROUP BY 1, 2)
      JOIN (SELECT page, count(*) FILTER (WHERE item IN ('T4', 'C1', 'R10') AND grade = 'F') AS vetoed FROM {_GR} GROUP BY 1) USING (page))""",
    "diagnosis_matrix": f"SELECT page, content, trust, CASE WHEN coalesce(content >= 75, false) AND coalesce(trust >= 75, false) THEN 'lead' WHEN coalesce(content >= 75, false) THEN 'build_trust' WHEN coalesce(trust >= 75, false) THEN 'improve_content' ELSE 'rebuild' END AS cell FROM (SELECT page, round(avg(v * 10) FILTER (WHERE dim IN ('C', 'O')), 2) AS content, round(avg(v * 10) FILTER (WHERE dim IN ('R', 'E')), 2) AS trust FROM {_GR} GROUP BY 1)",
    "keyword_opportunity": f"SELECT keyword, intent, CASE WHEN intent IN ('transactional', 'local') THEN 'bottom' WHEN intent = 'commercial' THEN 'middle' ELSE 'top' END AS funnel, score, CASE WHEN score >= 150 THEN 'P0' WHEN score >= 80 THEN 'P1' WHEN score >= 20 THEN 'P2' ELSE 'P3' END AS priority FROM (SELECT *, round(volume * CASE WHEN intent = 'transactional' THEN 1.5 WHEN intent IN ('commercial', 'local') THEN 1.2 WHEN intent = 'navigational' THEN 0.5 ELSE 1.0 END::DOUBLE / greatest(difficulty, 1), 2) AS score FROM (SELECT *, {_SEG} AS intent FROM (SELECT *, lower(keyword) AS c FROM {lit('keyword')})))",
    "ctr_band_join": f"SELECT keyword, ctr, expected_ctr, CASE WHEN expected_ctr IS NULL THEN 'no_band' WHEN ctr < expected_ctr * 0.5::DOUBLE THEN 'low' WHEN ctr > expected_ctr * 1.5::DOUBLE THEN 'high' ELSE 'normal' END AS verdict FROM (SELECT keyword, round(clicks::DOUBLE / impressions, 4) AS ctr, expected_ctr FROM {lit('keyword')} k LEFT JOIN {lit('ctr_band')} b ON k.position >= b.lo AND k.position < b.hi)",
    "query_triage": f"SELECT keyword, CASE WHEN position BETWEEN 4 AND 15 THEN 'quick_win' WHEN impressions > 3000 AND clicks::DOUBLE / impressions < 0.02 THEN 'rewrite_snippet' WHEN position <= 3 THEN 'defend' ELSE 'watch' END AS action, CASE WHEN position <= 3 THEN '1-3' WHEN position <= 10 THEN '4-10' WHEN position <= 20 THEN '11-20' ELSE '21+' END AS bucket FROM {lit('keyword')}",
    "traffic_drop_7d": f"SELECT day, week, before, floor((20000 * (week - before) + before)::DOUBLE / (2 * before)) / 10000 AS change, (before - week) * 20 > before * 3 AS alert FROM (SELECT day, (sum(events) OVER (ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW))::BIGINT AS week, (sum(events) OVER p)::BIGINT AS before, count(*) OVER p AS n FROM {_DAYS} WINDOW p AS (ORDER BY day RANGE BETWEEN INTERVAL 13 DAYS PRECEDING AND INTERVAL 7 DAYS PRECEDING)) WHERE n = 7",
    "content_decay": "SELECT event_type, earlier, later, CASE WHEN earlier > 0 THEN floor((20000 * (later - earlier) + earlier)::DOUBLE / (2 * earlier)) / 10000 ELSE later END AS change, (earlier - later) * 5 > earlier AS decayed FROM (SELECT event_type, count(*) FILTER (WHERE epoch_us(ts) * 2 < s) AS earlier, count(*) FILTER (WHERE epoch_us(ts) * 2 >= s) AS later FROM events, (SELECT epoch_us(min(ts)) + epoch_us(max(ts)) AS s FROM events) GROUP BY 1)",
    "velocity_cv": f"SELECT n::INT AS days, round(avg(events), 4) AS mean, round(stddev_pop(events) / avg(events), 4) AS cv FROM {_DAYS}, (VALUES (10), (20), (30)) v(n), (SELECT max(day) AS last FROM {_DAYS}) WHERE date_diff('day', day, last) < n GROUP BY 1",
    "sessions": f"SELECT * FROM {_SESS}", "engaged_sessions": f"SELECT engaged, count(*) AS sessions, round(avg(events), 4) AS avg_events FROM {_SESS} GROUP BY 1",
    "event_log_report": "SELECT weekday, event_type, events, round(events::DOUBLE / sum(events) OVER (PARTITION BY weekday), 4) AS share FROM (SELECT (dayofweek(ts) + 1)::BIGINT AS weekday, event_type, count(*) AS events FROM events GROUP BY 1, 2)",
    "event_value_p75": "SELECT event_type, round(quantile_cont(value, 0.75), 4) AS p75, count(value) AS n FROM events GROUP BY 1",
    "route_request": "SELECT CASE WHEN regexp_matches(lower(text), '\\b(error|broken|fail|bug)') THEN 'technical' WHEN regexp_matches(lower(text), '\\b(price|cost|buy|pay)') THEN 'commercial' WHEN regexp_matches(lower(text), '\\b(how|why|what|explain)') THEN 'content' WHEN regexp_matches(lower(text), '\\b(list|table|compare)') THEN 'report' ELSE 'general' END AS route, count(*) AS turns FROM conversations WHERE role = 'user' GROUP BY 1",
}
