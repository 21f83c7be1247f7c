"""All queries of the engine's own operators: name -> (spark, sf_dir) -> DataFrame, with their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audit_oracles import AUDITS
from .operators import articles as A
from .operators import audits as U
from .operators import backlinks as B
from .operators import documents as D
from .operators import duplicates as C
from .operators import findings as N
from .operators import hosts as S
from .operators import links as L
from .operators import models as M
from .operators import pages as P
from .operators import rollups as G
from .operators import scoring as R
from .oracles import ORACLES
from .graph_oracles import PAGE_GROUPS
from .page_audit_oracle import PAGE_AUDIT
from .plans import dims
from .scoring_oracles import SCORING
from .sources import fetching
from .sources.tables import literal, load
from .streaming import finite

Query = Callable[[SparkSession, str], DataFrame]


def _on(table: str, f: Callable[..., DataFrame]) -> Query:
    return lambda spark, d: f(load(spark, d, table))


def _lit(f: Callable[..., DataFrame], *names: str) -> Query:
    return lambda spark, d: f(*(literal(spark, n) for n in names))


def _findings_of_pages(pages: DataFrame) -> DataFrame:
    return P.length_findings(pages).select("severity").unionByName(P.thin_content(pages).select("severity")).unionByName(P.schema_findings(pages).select("severity"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Links between pages of a folder, as (src, dst) of URLs."""
    pages = load(spark, d, "pages")
    return L.edges(pages).join(pages.select("page_id", F.lit(1).alias("x")), "page_id").join(pages.select("page_id", L.U.normal_b(F.col("url")).alias("src")), "page_id").select("src", F.col("target").alias("dst"))


def reach_depth(spark: SparkSession, d: str) -> DataFrame:
    """Least number of links from the lowest URL of each host, as deep as links lead."""
    pages = load(spark, d, "pages")
    seeds = pages.groupBy(L.U.host(F.col("url"))).agg(F.min(L.U.normal_b(F.col("url"))).alias("node"))
    return L.reach(_edges(spark, d), seeds, None).groupBy("depth").agg(F.count("*").alias("nodes"))


def fetch_offline(spark: SparkSession, d: str) -> DataFrame:
    """Answers by host and outcome to all links and URLs of pages, from the pages themselves."""
    pages = load(spark, d, "pages")
    urls = L.edges(pages).select(F.col("target").alias("url")).unionByName(pages.select("url"))
    return fetching.answer_mix(fetching.fetched(urls, "offline", pages=pages))


def crawl_budget(spark: SparkSession, d: str) -> DataFrame:
    """A crawl from the lowest URL of each host over 3 links and 5 URLs a host, with the URLs it visits."""
    pages = load(spark, d, "pages")
    seeds = pages.groupBy(L.U.host(F.col("url"))).agg(F.min(L.U.normal_b(F.col("url"))).alias("node"))
    return L.crawl(_edges(spark, d), seeds, 3, 5)


def onpage_overall(spark: SparkSession, d: str) -> DataFrame:
    """Section scores of each host from its pages, and their weighted mean."""
    pages = load(spark, d, "pages")
    host = pages.select("page_id", L.U.host(F.col("url")).alias("site"))
    parts = {"onpage": P.onpage_scores, "image_seo": P.image_scores, "social": P.social_scores, "schema_validation": P.schema_scores, "local_signals": P.local_scores}
    rows = None
    for section, f in parts.items():
        one = f(pages).select("page_id", F.lit(section).alias("section"), F.col("score").cast("double").alias("score"))
        rows = one if rows is None else rows.unionByName(one)
    s = rows.join(host, "page_id").groupBy("site", "section").agg(F.round(F.avg("score"), 6).alias("score"))
    return N.overall(s)


QUERIES: dict[str, Query] = {
    # pages
    "thin_content": _on("pages", P.thin_content), "host_word_stats": _on("pages", P.host_word_stats), "page_facts": _on("pages", P.facts), "title_meta_lengths": _on("pages", P.length_findings), "length_scores": _on("pages", P.length_scores), "onpage_scores": _on("pages", P.onpage_scores),
    "title_uniqueness": _on("pages", lambda p: P.uniqueness(p, "title")), "h1_uniqueness": _on("pages", lambda p: P.uniqueness(p, "first_h1")), "template_groups": _on("pages", P.template_groups), "severity_totals": _on("pages", lambda p: N.severity_totals(_findings_of_pages(p))),
    "platform_detection": _on("pages", P.platforms), "soft_404_pages": _on("pages", lambda p: S.soft_404(P.facts(p))), "onpage_overall": onpage_overall,
    # page rules on literal heads, which have what crawled pages lack
    "head_facts": _lit(lambda h: P.facts(h), "head_html"), "image_list": _lit(P.images, "head_html"), "image_scores": _lit(P.image_scores, "head_html"), "social_checks": _lit(P.social_checks, "head_html"), "social_scores": _lit(P.social_scores, "head_html"), "social_previews": _lit(P.social_previews, "head_html"),
    "json_ld_objects": _lit(lambda h: P.json_ld(h).drop("raw"), "head_html"), "schema_findings": _lit(P.schema_findings, "head_html"), "schema_scores": _lit(P.schema_scores, "head_html"), "local_scores": _lit(P.local_scores, "head_html"), "platform_hints": _lit(P.platforms, "page_html_hint"),
    # URLs and links
    "url_parts": _on("pages", L.url_parts), "url_normal_forms": _on("pages", L.url_normal_forms), "url_hygiene_classes": _on("pages", L.hygiene_classes), "url_standards": _on("pages", L.url_standards), "http_vs_https": _on("pages", L.scheme_mix), "www_overlap": _on("pages", L.www_overlap),
    "link_edges": _on("pages", L.edges), "anchor_top20": _on("pages", L.anchor_top), "out_degree_stats": _on("pages", L.out_degree_stats), "in_out_degree": _on("pages", L.degrees), "orphans_zero_in": _on("pages", L.unlinked), "orphans_le1": _on("pages", lambda p: L.orphans(p, 1)), "dead_ends": _on("pages", L.dead_ends),
    "top_linked": _on("pages", L.top_linked), "broken_targets": _on("pages", L.broken_targets), "external_domains": _on("pages", L.external_domains), "anchor_diversity": _on("pages", L.anchor_diversity), "template_cross_links": _on("pages", L.template_cross_links), "reach_depth": reach_depth, "redirect_chains": _lit(L.chains, "redirect"),
    # documents
    "exact_dups": _on("documents", D.exact_groups), "thin_texts": _on("documents", D.thin_texts), "near_dups_minhash": _on("documents", D.near_pairs), "boilerplate_ratio": _on("documents", D.boilerplate), "readability_a": _on("documents", D.readability_a), "readability_b": _on("documents", D.readability_b), "reading_levels": _on("documents", D.reading_levels),
    "keyword_ngrams": _on("documents", D.keywords), "long_sentences_topk": _on("documents", D.long_sentences), "sentence_rewrites": _on("documents", D.sentence_rewrites), "citable_passages": _on("documents", D.citable_passages), "keyword_density": _on("documents", D.keyword_density),
    "benchmark_overlap": lambda spark, d: D.shingle_overlap(load(spark, d, "documents"), load(spark, d, "benchmark")), "quality_by_readability": lambda spark, d: D.quality_by_readability(load(spark, d, "documents"), load(spark, d, "labels")),
    # hosts
    "robots_parse": _lit(S.robots_rules, "robots_txt"), "ai_crawler_status": _lit(S.ai_crawler_status, "robots_txt"), "robots_scores": _lit(S.robots_scores, "robots_txt"), "crawl_delays": _lit(S.crawl_delays, "robots_txt"), "sitemap_locs": _lit(S.sitemap_locs, "sitemap_xml"), "sitemap_pages": _lit(S.sitemap_pages, "sitemap_xml"),
    "sitemap_hygiene": _lit(S.sitemap_hygiene, "sitemap_xml"), "sitemap_vs_crawl": lambda spark, d: S.sitemap_gaps(literal(spark, "sitemap_xml"), load(spark, d, "pages")), "url_health": _lit(S.url_health_summary, "url_status"), "broken_link_score": _lit(S.broken_link_score, "url_status"), "llms_items": _lit(S.llms_items, "llms_txt"), "llms_scores": _lit(S.llms_scores, "llms_txt"),
    "security_scores": _lit(S.security_scores, "http_response"), "redirect_findings": _lit(S.redirect_findings, "http_response"), "redirect_map_check": _lit(S.redirect_map_check, "redirect_map"), "canonical_audit": _lit(S.canonical_audit, "canonical_page", "http_response"), "canonical_scores": _lit(S.canonical_scores, "canonical_page", "http_response"), "canonical_groups": _lit(S.canonical_groups, "canonical_page"),
    "hreflang_codes": _lit(S.hreflang_codes, "hreflang"), "hreflang_return_tags": _lit(S.hreflang_return_tags, "hreflang"), "hreflang_pages": _lit(S.hreflang_pages, "hreflang"), "cwv_p75_rating": _lit(S.vitals_p75, "cwv"), "psi_facts": _lit(S.psi_facts, "psi"), "same_as_platforms": _lit(S.same_as, "entity"), "entity_scores": _lit(S.entity_scores, "entity"), "indexnow_scores": _lit(S.indexnow_scores, "indexnow"),
    # backlinks
    "backlink_overview": _lit(B.overview, "backlink"), "dr_buckets": _lit(B.dr_buckets, "backlink"), "anchor_mix": _lit(B.anchor_mix, "backlink"), "top_anchors": _lit(B.top_anchors, "backlink"), "tld_mix": _lit(B.tld_mix, "backlink"), "domain_ratings": _lit(B.domain_ratings, "backlink"), "top_targets": _lit(B.top_targets, "backlink"),
    "toxic_links": _lit(B.toxic_links, "backlink"), "toxic_ratio": _lit(B.toxic_ratio, "backlink"), "backlink_health": _lit(B.health, "backlink"), "backlink_issues": _lit(B.health_issues, "backlink"), "disavow_lines": _lit(B.disavow, "backlink"), "anchor_naturalness": _lit(B.anchor_naturalness, "backlink"),
    "competitor_gap": _lit(B.competitor_gap, "backlink", "competitor_backlink"), "gap_opportunities": _lit(B.gap_opportunities, "backlink", "competitor_backlink"), "link_rollup_by_nation": lambda spark, d: M.gap_by_region(load(spark, d, "supplier"), load(spark, d, "nation"), load(spark, d, "lineitem")),
    # findings and scores
    "verify_findings": _lit(N.verified, "finding", "metric_context"), "assertion_eval": lambda spark, d: N.assertion_results(load(spark, d, "conversations"), literal(spark, "assertion")), "overall_score": _lit(N.overall, "section_score"), "weighted_grade": _lit(N.weighted_grades, "grade", "grade_weight"), "diagnosis_matrix": _lit(N.diagnosis, "grade", "grade_weight"),
    # models
    "keyword_opportunity": _lit(M.keyword_opportunity, "keyword"), "ctr_band_join": _lit(M.ctr_gap, "keyword", "ctr_band"), "query_triage": _lit(M.query_triage, "keyword"), "traffic_drop_7d": _on("events", M.traffic_drops), "content_decay": _on("events", M.content_decay), "velocity_cv": _on("events", M.velocity_cv),
    "sessions": _on("events", M.sessions), "engaged_sessions": _on("events", M.engagement), "event_log_report": _on("events", M.event_log_report), "event_value_p75": _on("events", M.value_p75), "route_request": _on("conversations", M.routed),
}

QUERIES |= {
    # sections and indexes
    "section_scores": _lit(R.section_scores, "audit_metrics"),
    "audit_overall": _lit(lambda m: N.overall(R.section_scores(m)), "audit_metrics"),
    "sitemap_scores": _lit(R.sitemap_scores, "sitemap_summary"),
    "eeat_index": _lit(lambda p: R.weighted_index(p, dims.EEAT_WEIGHTS), "index_part"),
    "content_index": _lit(lambda p: R.weighted_index(p, dims.CONTENT_WEIGHTS), "index_part"),
    "answer_index": _lit(lambda p: R.weighted_index(p, dims.ANSWER_WEIGHTS), "index_part"),
    "site_health": _lit(R.site_health, "health_signal"),
    "image_index": _lit(R.image_index, "site_count"),
    # content
    "word_floors": _lit(R.word_floors, "content_page"),
    "freshness": _lit(R.freshness, "content_page"),
    "content_actions": _lit(R.content_actions, "content_page"),
    "traffic_diagnosis": _lit(R.traffic_diagnosis, "content_page"),
    "answer_shapes": _lit(R.answer_shapes, "answer_block"),
    "paragraphs": _on("documents", R.paragraphs),
    # crawls, indexes and URLs
    "header_alternates": _lit(R.header_alternates, "link_header"),
    "indexation_bands": _lit(R.indexation, "site_count"),
    "missing_url_fixes": _lit(R.missing_url_fixes, "missing_url"),
    "crawl_waste": _lit(R.crawl_waste, "waste_url"),
    "crawl_waste_of_pages": _on("pages", R.crawl_waste),
    "redirect_tiers": _lit(R.redirect_tiers, "old_url"),
    "sitemap_sample": _on("pages", R.sitemap_sample),
    "ungrouped_pages": _on("pages", lambda p: R.ungrouped(p, P.template_groups(p))),
    "canonical_summary": _lit(R.canonical_summary, "canonical_page"),
    "soft_404_title_and_body": _lit(R.soft_404_by_title_and_body, "answer_page"),
    "links_with_subdomains": _on("pages", L.links_with_subdomains),
    "links_by_absolute_url": _on("pages", L.links_by_absolute_url),
    "link_set": _on("pages", L.link_set),
    # links, gates and plans
    "gap_scores": _lit(R.gap_scores, "gap_domain"),
    "modal_target": _lit(R.modal_target, "backlink"),
    "image_weights": _lit(R.image_weights, "image_size"),
    "programmatic_gates": _lit(R.programmatic_gates, "page_plan"),
    "location_gates": _lit(R.location_gates, "site_count"),
    "roadmap": _lit(R.roadmap, "task"),
    "audit_confidence": _lit(R.audit_confidence, "site_count"),
    "return_on_search": _lit(R.return_on_search, "channel"),
}

QUERIES |= {
    # duplicates of pages
    "duplicate_pages": _on("pages", C.duplicate_report),
    # rolled-up signatures and vocabularies
    "source_similarity": _on("documents", lambda d: G.group_similarity(d, F.col("source"))),
    "seeded_signatures": _on("benchmark", lambda b: D.signatures(b.withColumnRenamed("item_id", "doc_id"), seeded_md5=True).select("doc_id", F.array_join("sig", ",").alias("sig"))),
    "template_uniqueness": _on("pages", G.template_uniqueness),
    "vocabulary_rollup": _on("pages", G.vocabulary_rollup),
    "template_audit": _on("pages", G.template_audit),
    "site_audit": _on("pages", G.site_audit),
    # streams run to their end
    "stream_drop_alerts": lambda spark, d: finite.drops_of(spark, f"{d}/events.parquet"),
    "polite_frontier": lambda spark, d: finite.frontier_of(spark, f"{d}/pages.parquet"),
    # fetching by a backend
    "fetch_offline": fetch_offline,
    # links by class, and a crawl with budgets
    "linked_pages": _on("pages", L.linked_pages),
    "crawl_budget": crawl_budget,
    # articles
    "article_facts": _on("pages", A.article_facts),
    "article_findings": _lit(A.article_findings, "article_fact"),
    "page_paragraphs": _on("pages", A.page_paragraphs),
    "visible_lines": _on("pages", A.visible_lines),
    "navigation_noise": _on("documents", A.navigation_noise),
    "navigation_noise_cases": _lit(A.navigation_noise, "noise_text"),
    "page_entities": _lit(A.page_entities, "entity_html"),
    "entity_names": _lit(A.entity_names, "entity_html"),
    "contact_signals": _lit(A.contact_signals, "entity_html"),
    # audits
    "audit_findings": _on("pages", U.audit_findings),
    "site_risk": _lit(U.site_risk, "template_count"),
    "thin_pages_first": _on("pages", U.thin_pages_first),
    "largest_groups": _on("pages", lambda p: U.largest_groups(P.template_groups(p))),
    "self_canonical_pairs": _lit(U.self_canonical_pairs, "near_pair", "canonical_page"),
    "canonical_filled": _lit(lambda p: U.with_canonical(p, p), "canonical_page"),
    "environment_fixes": _lit(U.environment_fixes, "site_metrics"),
    "raw_html_notice": _lit(U.raw_html_notice, "site_runtime"),
    "masked_keys": _lit(U.masked_keys, "site_key"),
    "sitemap_candidates": _lit(U.sitemap_candidates, "robots_txt"),
    "sitemap_languages": _lit(U.sitemap_languages, "sitemap_alternates"),
    "soft_404_of_links": _lit(U.soft_404_by_wide_title, "answer_page"),
    # rule tables
    "domain_index": _lit(U.domain_index, "domain_rating"),
    "item_priorities": _lit(lambda g: U.item_priorities(g, dims.ITEM_WEIGHTS), "grade"),
    "recognition": _lit(U.recognition, "recognition_answer"),
    "review_bands": _lit(U.review_bands, "review_stat"),
    "business_kinds": _lit(U.business_kinds, "business_page"),
    "business_kinds_of_pages": _on("pages", U.business_kinds),
    "content_pages": _lit(U.content_pages, "task_page"),
    "passage_blocks": _on("documents", U.passage_blocks),
    "passage_cases": _lit(U.passage_blocks, "passage"),
    "link_health": _lit(U.link_health, "link_stat"),
}

ORACLES = ORACLES | SCORING | AUDITS | PAGE_AUDIT | PAGE_GROUPS
