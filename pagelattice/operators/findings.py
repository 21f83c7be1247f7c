"""Findings: verification and merging, assertions on transcripts, roll-ups, section and overall scores, weighted grades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import dims
from ..plans.stage import small

#: Prefix of a finding's key and the pattern whose first group follows it.
KEYS = (
    ("missing-required:", r"missing required (?:repository )?(?:file|artifact):\s*([^.\n]+)"), ("missing-recommended:", r"missing recommended (?:trust|community) artifact:\s*([^.\n]+)"),
    ("community-profile-missing:", r"missing community profile component:\s*([^.\n]+)"), ("community-profile-missing:", "remote community profile marks [`']?([^`'.\\n]+)[`']? as missing"),
)
#: Text of a finding and the metric that refutes it.
REFUTED = (("no code examples detected", "code_block_count > 0"), ("readme should contain exactly one h1 heading", "h1_count = 1"), ("installation/quickstart section is missing", "has_install_section"), ("readme sectioning is shallow", "heading_count >= 4"))


def canonical_key(text):
    t = T.normalised(F.coalesce(text, F.lit("")))
    base = F.substring(F.regexp_replace(t, r"[^a-z0-9\s:_\-]", ""), 1, 160)
    return F.coalesce(*(F.when(t.rlike(p), F.concat(F.lit(k), F.trim(F.regexp_extract(t, p, 1)))) for k, p in KEYS), base)


def _in_context(findings: DataFrame, context: DataFrame) -> DataFrame:
    """Findings with the metrics that they are checked against: those of their site where both have a site, else of all contexts; of several the greatest values."""
    metrics = [c for c in context.columns if c != "site" and c not in findings.columns]
    most = [F.max(c).alias(c) for c in metrics]
    if "site" in context.columns and "site" in findings.columns:
        return findings.join(context.groupBy("site").agg(*most), "site", "left")
    return findings.crossJoin(F.broadcast(context.agg(*most)))  # one row


def verified(findings: DataFrame, context: DataFrame) -> DataFrame:
    """One row a canonical key: the strongest severity, its earliest text, sources and count; refuted findings left out."""
    t = T.normalised(F.coalesce("finding", F.lit("")))
    j = _in_context(findings, context)
    refuted = reduce(lambda a, b: a | b, (t.contains(s) & F.coalesce(F.expr(c), F.lit(False)) for s, c in REFUTED))
    j = j.where(~refuted).withColumn("key", canonical_key(F.col("finding")))
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in dims.SEVERITY_FOUR.items() for x in kv))[F.coalesce("severity", F.lit("Info"))], F.lit(9))
    j = j.withColumn("rank", rank)
    g = j.groupBy("key").agg(F.min_by(F.struct("severity", "finding"), F.struct("rank", "seq")).alias("f"), F.count("*").alias("merged"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), F.min("rank").alias("sev_rank"))
    return g.select("key", "f.severity", "f.finding", "merged", "sources", F.col("sev_rank").cast("long").alias("sev_rank"))


def assertion_results(turns: DataFrame, asserts: DataFrame) -> DataFrame:
    """Of each assertion: turns of its role it was checked on and passed on; contains kinds are case-sensitive, patterns aren't."""
    terms = F.split("terms", r"\|")
    j = turns.select("role", "text").join(small(asserts), "role")
    any_, all_ = F.exists(terms, lambda x: F.contains(F.col("text"), x)), F.forall(terms, lambda x: F.contains(F.col("text"), x))
    pat = F.regexp_like("text", F.concat(F.lit("(?is)"), F.regexp_replace("terms", r"^\(\?i\)", "")))
    ok = F.when(F.col("kind") == "contains_any", any_).when(F.col("kind") == "contains_all", all_).when(F.col("kind") == "not_contains_any", ~any_).when(F.col("kind") == "contains_pattern", pat).otherwise(~pat)
    return j.groupBy("assert_id", "kind").agg(F.count("*").alias("turns"), F.count_if(ok).alias("passed"), F.coalesce(F.bool_and(ok), F.lit(True)).alias("all_passed"))


def collapse(severity):
    """Report form of a severity: critical, warning, info."""
    return F.when(severity.isin("critical", "high"), "critical").when(severity.isin("warning", "medium"), "warning").otherwise("info")


def severity_totals(findings: DataFrame) -> DataFrame:
    return findings.groupBy(collapse(F.col("severity")).alias("severity")).agg(F.count("*").alias("findings"))


def overall(scores: DataFrame) -> DataFrame:
    """By site: scored sections, weight, and the weighted mean; sections without a score or a weight don't count. With its letter."""
    w = F.create_map(*(F.lit(x) for kv in dims.SECTION_WEIGHTS.items() for x in kv))[F.col("section")]
    s = scores.withColumn("w", F.when(F.col("score").isNotNull(), w))
    g = s.groupBy("site").agg(F.count("w").alias("sections"), F.coalesce(F.sum("w"), F.lit(0)).cast("long").alias("weight"), F.sum(F.col("score") * F.col("w")).alias("x"))
    o = F.when(F.col("weight") > 0, F.round(F.col("x") / F.col("weight"))).otherwise(0).cast("long")
    g = g.select("site", "sections", "weight", o.alias("overall"))
    return g.withColumn("letter", F.when(F.col("overall") >= 90, "A").when(F.col("overall") >= 80, "B").when(F.col("overall") >= 70, "C").when(F.col("overall") >= 60, "D").when(F.col("overall") >= 50, "E").otherwise("F"))


def weighted_grades(grades: DataFrame, weights: DataFrame, vetoes: tuple = ("T4", "C1", "R10"), cap: float = 60.0) -> DataFrame:
    """Items graded P, A (partial), F or N: means by dimension, weights shared again where over half of a dimension is N, and a cap for failed veto items."""
    v = F.when(F.col("grade") == "P", 10.0).when(F.col("grade") == "A", 5.0).when(F.col("grade") == "F", 0.0)
    d = grades.withColumn("v", v).groupBy("page", "dim").agg(F.avg("v").alias("mean"), F.count("*").alias("n"), F.count_if(F.col("grade") == "N").alias("na"))
    veto = grades.groupBy("page").agg(F.count_if(F.col("item").isin(*vetoes) & (F.col("grade") == "F")).alias("vetoed"))
    j = d.where((F.col("na") * 2 <= F.col("n")) & F.col("mean").isNotNull()).join(F.broadcast(weights), "dim")
    g = j.groupBy("page", "kind").agg(F.round(F.lit(10.0) * F.sum(F.col("mean") * F.col("weight")) / F.sum("weight"), 2).alias("raw"), F.count("*").alias("dims"))
    g = g.join(veto, "page").withColumn("score", F.when(F.col("vetoed") > 0, F.least("raw", F.lit(cap))).otherwise(F.col("raw")))
    return g.withColumn("band", F.when(F.col("score") >= 90, "excellent").when(F.col("score") >= 75, "good").when(F.col("score") >= 60, "fair").when(F.col("score") >= 40, "weak").otherwise("poor"))


def diagnosis(grades: DataFrame, weights: DataFrame) -> DataFrame:
    """Content (C, O) against trust (R, E) at 75: one of four cells a page."""
    d = grades.withColumn("v", F.when(F.col("grade") == "P", 100.0).when(F.col("grade") == "A", 50.0).when(F.col("grade") == "F", 0.0))
    g = d.groupBy("page").agg(F.round(F.avg(F.when(F.col("dim").isin("C", "O"), F.col("v"))), 2).alias("content"), F.round(F.avg(F.when(F.col("dim").isin("R", "E"), F.col("v"))), 2).alias("trust"))
    hi = lambda c: F.coalesce(F.col(c) >= 75, F.lit(False))
    return g.withColumn("cell", F.when(hi("content") & hi("trust"), "lead").when(hi("content"), "build_trust").when(hi("trust"), "improve_content").otherwise("rebuild"))
