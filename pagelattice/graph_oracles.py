"""DuckDB SQL of operators on groups, links and frontiers of pages, by recursion over all pairs or links."""

from __future__ import annotations

from . import oracle as O
from .operators.documents import coefficients
from .oracles import _COEF, _EDGES, _SH, ORACLES, _facts
from .plans import dims

_TEXT = O.visible("coalesce(html, '')")

_TITLE = O.elements("coalesce(html, '')", "title")
_SOFT = " OR ".join(f"contains(lower(coalesce(({_TITLE})[1], '')), {O.q(x)})" for x in dims.SOFT_404_OF_LINKS)


def _crawl(depth: int, most: int) -> str:
    """Levels one after the other: each takes, of a host's new targets, those of least rank that its quota leaves room for."""
    rank = "('0x' || substr(md5(node), 1, 15))::BIGINT"
    out = f"""WITH e AS MATERIALIZED (SELECT DISTINCT {O.normal_b('p.url')} AS src, g.target AS dst FROM {_EDGES} g JOIN pages p USING (page_id)),
      v0 AS MATERIALIZED (SELECT node, {O.host('node')} AS host, 0::BIGINT AS depth FROM (SELECT DISTINCT min({O.normal_b('url')}) AS node FROM pages GROUP BY {O.host('url')}) QUALIFY row_number() OVER (PARTITION BY {O.host('node')} ORDER BY {rank}, node) <= {most})"""
    for d in range(1, depth + 1):
        out += f""", v{d} AS MATERIALIZED (SELECT * FROM v{d - 1} UNION ALL SELECT node, c.host, {d}::BIGINT FROM (SELECT node, {O.host('node')} AS host FROM (SELECT DISTINCT dst AS node FROM v{d - 1} JOIN e ON src = node WHERE depth = {d - 1}) WHERE node NOT IN (SELECT node FROM v{d - 1})) c
          LEFT JOIN (SELECT host, count(*) AS used FROM v{d - 1} GROUP BY 1) u ON u.host = c.host QUALIFY row_number() OVER (PARTITION BY c.host ORDER BY {rank}, node) <= {most} - coalesce(used, 0))"""
    return out + f" SELECT * FROM v{depth}"


_PAIRS = ", ".join(f"({i}, {a}::BIGINT, {b}::BIGINT)" for i, (a, b) in enumerate(coefficients(256)))

_AUDIT = f"""WITH f0 AS (SELECT row_number() OVER () AS r, {O.host('url')} AS site, {O.host('url')} || {O.template('url')} AS pattern, {O.normal_b('url')} AS norm, url, html, page_id, {_TEXT} AS text FROM pages),
  pf AS (SELECT page_id AS r, title, meta_description, first_h1, n_canonicals FROM {_facts('(SELECT r AS page_id, html FROM f0)')}),
  f AS (SELECT f0.r, site, pattern, norm, page_id, text, len({O.words('text')}) AS words, {O.ascii_words('text')} AS w, coalesce(title, '') AS title, meta_description AS d, first_h1 AS h1, n_canonicals = 0 AS bare FROM f0 JOIN pf USING (r)),
  g AS (SELECT site, pattern, count(*) AS pages, count(*) FILTER (words < 300) AS thin, count(DISTINCT title) AS titles, count(DISTINCT d) AS descriptions, count(d) AS described, count(DISTINCT h1) AS h1s, count(h1) AS headed, count(*) FILTER (bare) AS without_canonical FROM f GROUP BY 1, 2 HAVING count(*) >= 3),
  s AS (SELECT r, pattern, x, len(sh) AS n FROM (SELECT r, pattern, sh, unnest(sh) AS x FROM (SELECT r, pattern, {_SH(5)} AS sh FROM f))), c AS (SELECT s.pattern, x FROM s JOIN g USING (pattern) GROUP BY 1, 2, pages HAVING count(*) >= greatest(2.0, 0.8 * pages)),
  u AS (SELECT s.pattern, s.r, round(100.0::DOUBLE - 100.0::DOUBLE * count(c.x) / min(n), 6) AS pct FROM s LEFT JOIN c ON c.pattern = s.pattern AND c.x = s.x GROUP BY 1, 2),
  uu AS (SELECT pattern, count(*) AS worded, count(*) FILTER (pct < 30) AS stopped, count(*) FILTER (pct >= 30 AND pct < 40) AS warned FROM u GROUP BY 1),
  x AS (SELECT a.pattern, count(DISTINCT a.r) AS cross_linked FROM f a JOIN {_EDGES} e ON e.page_id = a.page_id JOIN f b ON b.norm = e.target AND b.pattern = a.pattern WHERE e.target <> a.norm GROUP BY 1),
  j AS (SELECT g.*, coalesce(stopped, 0) + pages - coalesce(worded, 0) AS hard_stop, coalesce(warned, 0) AS warned, coalesce(cross_linked, 0) AS cross_linked FROM g LEFT JOIN uu USING (pattern) LEFT JOIN x USING (pattern)),
  k AS (SELECT site, pattern, pages, thin, titles, hard_stop, warned, described, headed, without_canonical, cross_linked, (thin * 2 > pages)::INT + (hard_stop > 0)::INT + (titles * 10 < pages * 8)::INT AS critical,
    (thin > 0 AND thin * 2 <= pages)::INT + (warned > 0)::INT + (titles < pages AND titles * 10 >= pages * 8)::INT + (described < pages)::INT + (descriptions < described)::INT + (headed < pages)::INT + (h1s < headed)::INT + (without_canonical > 0)::INT + ((pages - cross_linked) * 2 > pages)::INT AS warnings FROM j)"""

PAGE_GROUPS = {
    "duplicate_pages": f"""WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, page_id, {_TEXT} AS text FROM pages), p AS (SELECT r, page_id, len({O.words('text')})::BIGINT AS words, CASE WHEN text <> '' THEN sha256({O.normalised('text')}) END AS exact, {O.ascii_words('text')} AS w FROM t),
      s AS (SELECT r, exact, page_id, {_SH(5)} AS sh FROM p), g AS (SELECT r, exact, list_transform({_COEF}, lambda c: list_min(list_transform(h, lambda x: (x * c[1] + c[2]) % 2147483647))) AS sig FROM (SELECT r, exact, list_transform(sh, lambda x: ('0x' || substr(md5(x), 1, 15))::BIGINT % 2147483647) AS h FROM s WHERE len(sh) > 0)),
      f AS (SELECT r, unnest(range(1, 101)) AS i, unnest(sig) AS v FROM g), near AS (SELECT a.r AS a, b.r AS b FROM f a JOIN f b ON a.i = b.i AND a.v = b.v AND a.r < b.r GROUP BY 1, 2 HAVING count(*) >= 85),
      e AS (SELECT a, b FROM near UNION SELECT b, a FROM near UNION SELECT x.r, y.r FROM p x JOIN p y ON x.exact = y.exact AND x.r <> y.r), reached(a, z) AS (SELECT r, r FROM p WHERE exact IS NOT NULL UNION SELECT reached.a, e.b FROM reached JOIN e ON e.a = reached.z),
      m AS (SELECT a, min(q.page_id) AS group_id, count(*) AS group_pages FROM reached JOIN p q ON q.r = z GROUP BY a), x AS (SELECT exact, min(page_id) AS exact_id, count(*) AS exact_pages FROM p WHERE exact IS NOT NULL GROUP BY 1)
      SELECT p.page_id, words, CASE WHEN words < 100 THEN 'critical' WHEN words < 300 THEN 'warning' END AS thin, exact_id, exact_pages, group_id, group_pages FROM p LEFT JOIN x USING (exact) LEFT JOIN m ON m.a = p.r""",
    "linked_pages": f"""WITH own AS (SELECT {O.normal_b('url')} AS target, max(CASE WHEN {_SOFT} THEN 'soft_404' END) AS c FROM pages GROUP BY 1)
      SELECT CASE WHEN own.target IS NULL THEN 'missing' ELSE coalesce(c, 'crawled') END AS class, e.target, count(DISTINCT page_id) AS linking_pages, array_to_string((list(DISTINCT page_id ORDER BY page_id))[1:5], ',') AS examples FROM {_EDGES} e LEFT JOIN own ON own.target = e.target GROUP BY 1, 2""",
    "crawl_budget": _crawl(3, 5),
    "fetch_offline": f"""WITH u AS (SELECT DISTINCT target AS url FROM {_EDGES} UNION SELECT url FROM pages WHERE url IS NOT NULL), s AS (SELECT {O.normal_b('url')} AS key, min(coalesce(html, '')) AS html FROM pages WHERE url IS NOT NULL GROUP BY 1)
      SELECT {O.host('url')} AS host, CASE WHEN s.key IS NULL THEN '404' ELSE '200' END AS outcome, count(*) AS urls, sum(coalesce(length(s.html), 0))::BIGINT AS chars FROM u LEFT JOIN s ON s.key = {O.normal_b('url')} GROUP BY 1, 2""",
    "source_similarity": f"""WITH s AS (SELECT source, {_SH(5)} AS sh FROM (SELECT source, {O.ascii_words('text')} AS w FROM documents)), h AS (SELECT DISTINCT source, ('0x' || substr(md5(x), 1, 15))::BIGINT % 2147483647 AS h FROM (SELECT source, unnest(sh) AS x FROM s WHERE source IS NOT NULL)),
      m AS (SELECT source, c.i, min((h * c.a + c.b) % 2147483647) AS v FROM h, (VALUES {_PAIRS}) c(i, a, b) GROUP BY 1, 2) SELECT x.source AS a, y.source AS b, count(*) / 256.0::DOUBLE AS similarity FROM m x JOIN m y ON x.i = y.i AND x.v = y.v AND x.source < y.source GROUP BY 1, 2""",
    "seeded_signatures": f"""SELECT item_id AS doc_id, string_agg(v, ',' ORDER BY i) AS sig FROM (SELECT item_id, i, min(md5(concat(i, ':', x))) AS v FROM (SELECT item_id, unnest({_SH(5)}) AS x FROM (SELECT item_id, {O.ascii_words('text')} AS w FROM benchmark)), range(100) r(i) GROUP BY 1, 2) GROUP BY 1""",
    "template_uniqueness": f"""WITH t AS (SELECT row_number() OVER () AS r, {O.host('url')} || {O.template('url')} AS pattern, {_TEXT} AS text FROM pages), p AS (SELECT r, pattern, len({O.words('text')}) AS words, {O.ascii_words('text')} AS w FROM t),
      s AS (SELECT r, pattern, x, len(sh) AS n FROM (SELECT r, pattern, sh, unnest(sh) AS x FROM (SELECT r, pattern, {_SH(5)} AS sh FROM p))), d AS (SELECT pattern, x, count(*) AS df, min(n) AS n FROM s GROUP BY 1, 2),
      u AS (SELECT pattern, count(*) AS shingles, count(*) FILTER (df = 1) AS unique_shingles, sum(1.0::DOUBLE / n) FILTER (df = 1) AS parts FROM d GROUP BY 1), g AS (SELECT pattern, count(*) AS pages, round(avg(words), 1) AS avg_words, count(*) FILTER (len(w) > 0) AS worded FROM p GROUP BY 1 HAVING count(*) >= 3),
      j AS (SELECT pattern, pages, avg_words, coalesce(shingles, 0) AS shingles, coalesce(unique_shingles, 0) AS unique_shingles, round(coalesce(parts, 0.0::DOUBLE) / greatest(worded, 1), 4) AS uniqueness FROM g LEFT JOIN u USING (pattern))
      SELECT *, CASE WHEN uniqueness < 0.3 OR (pages >= 500 AND uniqueness < 0.4) THEN 'stop' WHEN uniqueness < 0.4 OR avg_words < 300 OR pages >= 100 THEN 'warn' ELSE 'pass' END AS gate FROM j""",
    "template_audit": f"{_AUDIT} SELECT *, CASE WHEN critical > 0 THEN 'high' WHEN warnings > 2 THEN 'medium' ELSE 'low' END AS risk FROM k",
    "site_audit": f"{_AUDIT} SELECT *, CASE WHEN critical > 0 THEN 'high' WHEN warnings > 3 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT site, count(*) AS groups, sum(pages)::BIGINT AS pages, sum(critical)::BIGINT AS critical, sum(warnings)::BIGINT AS warnings FROM k GROUP BY 1)",
    "stream_drop_alerts": ORACLES["traffic_drop_7d"],
    "polite_frontier": f"""WITH a AS (SELECT host, url, min(page_id) AS arrival FROM (SELECT {O.host('url')} AS host, {O.normal_b('url')} AS url, page_id FROM pages WHERE url IS NOT NULL AND page_id IS NOT NULL) GROUP BY 1, 2), i AS (SELECT *, row_number() OVER w - 1 AS i FROM a WINDOW w AS (PARTITION BY host ORDER BY arrival, url))
      SELECT host, url, arrival, greatest(arrival, max(arrival - i * 600) OVER (PARTITION BY host ORDER BY arrival, url ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + i * 600 - 600)::BIGINT AS release FROM i""",
}
