"""Command line: ``python -m pagelattice COMMAND --pages DIR ... --out DIR``; every command writes one folder a sheet.

Tables are Parquet; backlinks and competitor are CSV exports, sites are the columns of the rule tables. ``--help`` lists the commands.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import articles as A
from .operators import audits as U
from .operators import backlinks as B
from .operators import documents as D
from .operators import findings as N
from .operators import hosts as S
from .operators import links as L
from .operators import pages as P
from .sources import sinks
from .sources.files import backlink_csv

Sheet = tuple[Callable[..., DataFrame], tuple[str, ...]]

#: command -> sheet -> (operator, tables that it takes)
COMMANDS: dict[str, dict[str, Sheet]] = {
    "article": {"facts": (A.article_facts, ("pages",)), "paragraphs": (A.page_paragraphs, ("pages",)), "keywords": (D.keywords, ("documents",))},
    "backlinks": {
        "overview": (B.overview, ("backlinks",)), "ratings": (B.dr_buckets, ("backlinks",)), "anchors": (B.anchor_mix, ("backlinks",)), "toxic": (B.toxic_links, ("backlinks",)),
        "health": (B.health, ("backlinks",)), "issues": (B.health_issues, ("backlinks",)), "disavow": (B.disavow, ("backlinks",)),
    },
    "backlink-gap": {"gap": (B.competitor_gap, ("backlinks", "competitor")), "opportunities": (B.gap_opportunities, ("backlinks", "competitor"))},
    "broken-links": {"targets": (L.broken_targets, ("pages",)), "soft_404": (lambda p: S.soft_404(P.facts(p)), ("pages",)), "health": (S.url_health_summary, ("statuses",))},
    "canonical": {"audit": (S.canonical_audit, ("canonicals", "responses")), "groups": (S.canonical_groups, ("canonicals",))},
    "duplicates": {"exact": (D.exact_groups, ("documents",)), "near": (D.near_pairs, ("documents",)), "thin": (D.thin_texts, ("documents",))},
    "entity": {"entities": (A.page_entities, ("pages",)), "names": (A.entity_names, ("pages",)), "contact": (A.contact_signals, ("pages",))},
    "findings": {"verified": (N.verified, ("findings", "contexts"))},
    "hreflang": {"codes": (S.hreflang_codes, ("alternates",)), "returns": (S.hreflang_return_tags, ("alternates",)), "pages": (S.hreflang_pages, ("alternates",))},
    "images": {"images": (P.images, ("pages",)), "scores": (P.image_scores, ("pages",))},
    "meta-lengths": {"findings": (P.length_findings, ("pages",)), "scores": (P.length_scores, ("pages",))},
    "indexnow": {"scores": (S.indexnow_scores, ("indexnow",))},
    "internal-links": {"degrees": (L.degrees, ("pages",)), "orphans": (L.unlinked, ("pages",)), "dead_ends": (L.dead_ends, ("pages",)), "anchors": (L.anchor_top, ("pages",))},
    "link-profile": {"external": (L.external_domains, ("pages",)), "linked": (L.top_linked, ("pages",)), "diversity": (L.anchor_diversity, ("pages",))},
    "robots": {"rules": (S.robots_rules, ("robots",)), "crawlers": (S.ai_crawler_status, ("robots",)), "scores": (S.robots_scores, ("robots",))},
    "llms": {"items": (S.llms_items, ("llms",)), "scores": (S.llms_scores, ("llms",))},
    "security": {"scores": (S.security_scores, ("responses",))},
    "social": {"checks": (P.social_checks, ("pages",)), "scores": (P.social_scores, ("pages",)), "previews": (P.social_previews, ("pages",))},
    "local": {"scores": (P.local_scores, ("pages",))},
    "pages": {"facts": (P.facts, ("pages",)), "platforms": (P.platforms, ("pages",))},
    "readability": {"readability": (D.readability_a, ("documents",)), "noise": (A.navigation_noise, ("documents",)), "rewrites": (D.sentence_rewrites, ("documents",))},
    "schema": {"findings": (P.schema_findings, ("pages",)), "scores": (P.schema_scores, ("pages",))},
    "performance": {"facts": (S.psi_facts, ("psi",))},
    "programmatic": {"groups": (P.template_groups, ("pages",)), "cross_links": (L.template_cross_links, ("pages",))},
    "redirects": {"findings": (S.redirect_findings, ("responses",))},
    "assertions": {"results": (N.assertion_results, ("conversations", "assertions"))},
    "sitemap": {"pages": (S.sitemap_pages, ("sitemaps",)), "hygiene": (S.sitemap_hygiene, ("sitemaps",)), "gaps": (S.sitemap_gaps, ("sitemaps", "pages"))},
    "report": {"findings": (U.audit_findings, ("pages",)), "words": (P.host_word_stats, ("pages",)), "schema": (P.schema_scores, ("pages",))},
}
CSV = ("backlinks", "competitor")


def run(spark: SparkSession, command: str, paths: dict[str, str], out: str, kind: str = "parquet") -> list[str]:
    """Write the sheets of a command whose tables are given, and return their names; none given is an error."""
    sheets = {name: s for name, s in COMMANDS[command].items() if all(paths.get(t) for t in s[1])}
    if not sheets:
        need = sorted({t for _, ts in COMMANDS[command].values() for t in ts})
        raise ValueError(f"{command} takes these tables: {', '.join(need)}")
    tables = {t: backlink_csv(spark, paths[t]) if t in CSV else spark.read.parquet(paths[t]) for _, ts in sheets.values() for t in ts}
    frames = {name: f(*(tables[t] for t in ts)) for name, (f, ts) in sheets.items()}
    if kind == "json":
        for name, df in frames.items():
            sinks.json_rows(df, f"{out}/{name}")
    else:
        sinks.report({name: df.select(*(F.to_json(c).alias(c) if kind == "csv" and t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes)) for name, df in frames.items()}, out, kind)
    return sorted(frames)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagelattice", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    for t in sorted({t for s in COMMANDS.values() for _, ts in s.values() for t in ts}):
        p.add_argument(f"--{t}", metavar="PATH")
    p.add_argument("--out", required=True)
    p.add_argument("--format", dest="kind", choices=("parquet", "json", "csv"), default="parquet")
    return p


def main(argv: list[str] | None = None) -> None:
    given = vars(parser().parse_args(argv))
    command, out, kind = (given.pop(k) for k in ("command", "out", "kind"))
    spark = SparkSession.builder.appName(f"pagelattice {command}").getOrCreate()
    for name in run(spark, command, given, out, kind):
        print(f"{out}/{name}")


if __name__ == "__main__":
    main()
