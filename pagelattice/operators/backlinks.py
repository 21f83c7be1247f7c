"""Backlink profiles: overview, anchors, domains, toxic links, targets, gaps to competitors, health, disavow lists.

A profile is a table (seq, source_url, source_domain, target_url, anchor, follow, dr, tld); seq is the order
of the export, which decides where first or last rows count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans import dims


def dr_bucket(dr: Column) -> Column:
    return F.when(dr <= 20, "0-20").when(dr <= 40, "21-40").when(dr <= 60, "41-60").when(dr <= 80, "61-80").otherwise("81-100")


def overview(b: DataFrame) -> DataFrame:
    """Totals, follow ratio, mean and upper median of the domain rating. The median comes from counts by rating, not from a list."""
    t = b.agg(F.count("*").alias("backlinks"), F.countDistinct("source_domain").alias("domains"), F.count_if("follow").alias("follow"), F.round(F.avg("dr"), 1).alias("avg_dr"))
    c = b.groupBy("dr").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.orderBy("dr"))
    med = c.withColumn("upto", upto).withColumn("total", F.sum("n").over(W.partitionBy())).where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min("dr").alias("upper_median_dr"))
    return t.crossJoin(F.broadcast(med)).withColumn("follow_ratio", F.round(F.col("follow") / F.greatest("backlinks", F.lit(1)), 3))


def dr_buckets(b: DataFrame) -> DataFrame:
    return b.groupBy(dr_bucket(F.col("dr")).alias("bucket")).agg(F.count("*").alias("backlinks"))


def brand_terms(b: DataFrame) -> DataFrame:
    host = F.regexp_replace(F.lower(F.regexp_extract("target_url", "^[a-z]+://([^/?#]+)", 1)), r"^www\.", "")
    return b.select(F.substring_index(host, ".", 1).alias("term")).where("term <> ''").distinct()


def anchor_classes(b: DataFrame) -> DataFrame:
    """seq, anchor, class: empty, branded, url, generic, exact_match or other; brand terms are few and come as one array."""
    terms = brand_terms(b).agg(F.collect_set("term").alias("terms"))
    a = F.trim(F.lower(F.coalesce("anchor", F.lit(""))))
    c = (
        F.when(a == "", "empty").when(F.exists("terms", lambda t: a.contains(t)), "branded").when(a.rlike(r"^https?://|^www\.|\.com|\.org|\.net|\.io"), "url").when(a.isin(*dims.GENERIC_ANCHORS), "generic")
        .when((F.size(F.split(a, r"\s+")) <= 5) & ~a.rlike("[!@#$%]"), "exact_match").otherwise("other")
    )
    return b.crossJoin(F.broadcast(terms)).select("seq", "anchor", c.alias("class"))


def anchor_mix(b: DataFrame) -> DataFrame:
    """class, links, percent, and up to five first anchors."""
    c = anchor_classes(b).withColumn("rn", F.row_number().over(W.partitionBy("class").orderBy("seq")))
    g = c.groupBy("class").agg(F.count("*").alias("links"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("rn") <= 5, F.struct("rn", F.coalesce("anchor", F.lit("")).alias("a"))))), lambda x: x["a"]), "|").alias("examples"))
    return g.withColumn("percent", F.round(F.lit(100.0) * F.col("links") / F.sum("links").over(W.partitionBy()), 1))


def top_anchors(b: DataFrame, k: int = 15) -> DataFrame:
    return b.where("anchor is not null and anchor <> ''").groupBy("anchor").agg(F.count("*").alias("links")).orderBy(F.col("links").desc(), "anchor").limit(k)


def tld_mix(b: DataFrame, k: int = 20) -> DataFrame:
    return b.where("tld <> ''").groupBy("tld").agg(F.count("*").alias("links")).orderBy(F.col("links").desc(), "tld").limit(k)


def domain_ratings(b: DataFrame) -> DataFrame:
    """Rating of each domain by its last row, and its bucket."""
    return b.where("source_domain <> ''").groupBy("source_domain").agg(F.max_by("dr", "seq").alias("dr")).withColumn("bucket", dr_bucket(F.col("dr")))


def top_targets(b: DataFrame) -> DataFrame:
    return b.groupBy("target_url").agg(F.count("*").alias("backlinks"), F.countDistinct("source_domain").alias("domains"), F.count_if("follow").alias("follow"), F.count_if(~F.col("follow")).alias("nofollow"))


def toxic_links(b: DataFrame, target_tld: str = ".com") -> DataFrame:
    """First link of each (rule, domain) that a rule holds for: rule, tier, source_domain, seq, link_id. Rules are conditions of one projection."""
    dom, anc = F.lower("source_domain"), F.lower(F.trim(F.coalesce("anchor", F.lit(""))))
    x = b.withColumn("same", F.count("*").over(W.partitionBy("source_domain", "anchor"))).withColumn("of_domain", F.count("*").over(W.partitionBy("source_domain"))).withColumn("lo", F.min(F.coalesce("anchor", F.lit(""))).over(W.partitionBy("source_domain"))).withColumn("hi", F.max(F.coalesce("anchor", F.lit(""))).over(W.partitionBy("source_domain")))

    def holds(kind: str, p: str) -> Column:
        return {
            "low_dr_follow": lambda: (F.col("dr") < float(p)) & F.col("follow"), "repeat_anchor": lambda: (F.col("same") > int(p)) & (anc != ""), "uniform_anchor": lambda: (F.col("of_domain") >= int(p)) & (F.col("lo") == F.col("hi")), "domain": lambda: dom.rlike(p),
            "anchor": lambda: anc.rlike(p), "tld": lambda: F.col("tld").isin(*p.split("|")) & F.lit(target_tld not in p.split("|")), "long_domain": lambda: F.length("source_domain") > int(p), "emd_low_dr": lambda: (F.size(F.split(F.substring_index("source_domain", ".", 1), "-")) >= 3) & (F.col("dr") < float(p)),
        }[kind]()

    each = F.filter(F.array(*(F.when(holds(k, p), F.struct(F.lit(r).alias("rule"), F.lit(t).alias("tier"))) for r, t, k, p in dims.TOXIC_RULES)), lambda z: z.isNotNull())
    h = x.select("seq", "source_url", "source_domain", "target_url", "anchor", F.explode(each).alias("r")).select("*", "r.rule", "r.tier")
    first = h.withColumn("rn", F.row_number().over(W.partitionBy("rule", "source_domain").orderBy("seq"))).where("rn = 1")
    return first.select("rule", "tier", "source_domain", "seq", F.substring(F.md5(F.concat_ws("|", "source_url", "target_url", F.coalesce("anchor", F.lit(""))).cast("binary")), 1, 12).alias("link_id"))


def toxic_ratio(b: DataFrame) -> DataFrame:
    t = toxic_links(b).agg(F.count_if(F.col("tier") == "high").alias("high"), F.count_if(F.col("tier") == "medium").alias("medium"), F.countDistinct("source_domain").alias("toxic_domains"))
    return t.crossJoin(F.broadcast(b.agg(F.countDistinct("source_domain").alias("domains")))).withColumn("ratio", F.round(F.col("toxic_domains") / F.greatest("domains", F.lit(1)), 3))


def competitor_gap(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Every domain of either side: shared, only_mine or only_theirs, with the competitor's rating."""
    a = mine.select("source_domain").distinct().withColumn("m", F.lit(True))
    t = theirs.groupBy("source_domain").agg(F.max_by("dr", "seq").alias("dr"), F.countDistinct("competitor").alias("competitors"))
    j = a.join(t, "source_domain", "full")
    side = F.when(F.col("m").isNull(), "only_theirs").when(F.col("competitors").isNull(), "only_mine").otherwise("shared")
    return j.select("source_domain", side.alias("side"), "dr", F.coalesce("competitors", F.lit(0)).alias("competitors"))


def gap_opportunities(mine: DataFrame, theirs: DataFrame, k: int = 20) -> DataFrame:
    """Best domains of competitors that link to none of mine: by rating; high priority if two or more competitors have them."""
    g = competitor_gap(mine, theirs).where("side = 'only_theirs'")
    return g.orderBy(F.col("dr").desc(), "source_domain").limit(k).select("source_domain", "dr", "competitors", F.when(F.col("competitors") >= 2, "high").when(F.col("dr") >= 50, "medium").otherwise("low").alias("priority"))


def health(b: DataFrame) -> DataFrame:
    """Component scores and their weighted sum; one row."""
    o = overview(b).select("domains", "avg_dr", "follow_ratio")
    t = toxic_ratio(b).select(F.col("ratio").alias("toxic"))
    a = anchor_mix(b).agg(F.coalesce(F.max(F.when(F.col("class") == "exact_match", F.col("percent"))), F.lit(0.0)).alias("exact"), F.coalesce(F.max(F.when(F.col("class") == "branded", F.col("percent"))), F.lit(0.0)).alias("branded"))
    l_ = b.where("tld <> ''").agg(F.countDistinct("tld").alias("tlds"), F.count_if(F.col("tld").isin(".edu", ".gov")).alias("edu_gov"))
    x = o.crossJoin(F.broadcast(t)).crossJoin(F.broadcast(a)).crossJoin(F.broadcast(l_))
    steps = lambda c, pairs, end: reduce(lambda w, p: w.when(p[0], p[1]), pairs[1:], F.when(*pairs[0])).otherwise(end).cast("double")
    c = F.col
    parts = {
        "referring_domain_count": steps(None, [(c("domains") >= 50, 100), (c("domains") >= 20, 70), (c("domains") >= 10, 50), (c("domains") >= 5, 30)], 10),
        "domain_quality": F.least(F.lit(100.0), F.greatest(F.lit(0.0), c("avg_dr") * 1.2)),
        "toxic_ratio": steps(None, [(c("toxic") <= 0.05, 100), (c("toxic") <= 0.10, 75), (c("toxic") <= 0.20, 50), (c("toxic") <= 0.35, 25)], 0),
        "anchor_naturalness": steps(None, [((c("exact") <= 10) & (c("branded") >= 30), 100), ((c("exact") <= 15) & (c("branded") >= 20), 75), (c("exact") <= 20, 50), (c("exact") <= 30, 25)], 0),
        "geographic_relevance": F.least(F.lit(100.0), steps(None, [(c("tlds") >= 5, 80), (c("tlds") >= 3, 60)], 40) + F.when(c("edu_gov") > 0, 20).otherwise(0)),
        "velocity": F.lit(50.0),
        "follow_ratio": steps(None, [(c("follow_ratio").between(0.60, 0.85), 100), (c("follow_ratio").between(0.50, 0.90), 70), (c("follow_ratio").between(0.40, 0.95), 40)], 15),
    }
    s = x.select(*(v.alias(k) for k, v in parts.items()))
    return s.withColumn("score", F.round(reduce(lambda p, q: p + q, (F.col(k) * F.lit(w) for k, w in dims.HEALTH_WEIGHTS.items())), 1))


def health_issues(b: DataFrame) -> DataFrame:
    """Component scores that call for action, as rows: component, score, severity."""
    s = health(b)
    pairs = F.array(*(F.struct(F.lit(k).alias("component"), F.col(k).alias("score")) for k in dims.HEALTH_WEIGHTS))
    return s.select(F.explode(pairs).alias("p")).select("p.component", "p.score").where("score < 60").withColumn("severity", F.when(F.col("score") < 25, "critical").when(F.col("score") < 50, "warning").otherwise("info"))


def disavow(b: DataFrame, whole: int = 3) -> DataFrame:
    """Lines of a disavow file: a domain: line for domains with ``whole`` or more toxic links, else one line a URL."""
    bad = toxic_links(b).where("tier = 'high'").select("source_domain").distinct()
    t = b.join(bad, "source_domain", "left_semi").select("source_domain", "source_url").distinct()
    n = t.withColumn("n", F.count("*").over(W.partitionBy("source_domain")))
    return n.select(F.when(F.col("n") >= whole, F.concat(F.lit("domain:"), "source_domain")).otherwise(F.col("source_url")).alias("line")).distinct()


def anchor_naturalness(b: DataFrame) -> DataFrame:
    """100 less 1.5 for each percent that classes are away from the middle of their usual range."""
    mid = {"branded": 40.0, "exact_match": 5.0, "generic": 15.0, "url": 20.0, "other": 15.0, "empty": 5.0}
    m = anchor_mix(b).groupBy().agg(*(F.coalesce(F.max(F.when(F.col("class") == k, F.col("percent"))), F.lit(0.0)).alias(k) for k in mid))
    off = reduce(lambda p, q: p + q, (F.abs(F.col(k) - v) for k, v in mid.items()))
    return m.select(F.round(off, 1).alias("deviation"), F.round(F.greatest(F.lit(0.0), F.lit(100.0) - F.lit(1.5) * off), 1).alias("score"))
