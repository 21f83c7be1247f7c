"""Rule models on keywords, traffic and events: intent, opportunity, CTR gaps, decay, drops, sessions, velocity, log reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.quantiles import quantiles
from ..plans.stage import small


def intent(col):
    c = F.lower(col)
    return (
        F.when(c.rlike(r"\b(buy|price|cheap|order|deal|coupon|shop)\b"), "transactional").when(c.rlike(r"\b(best|top|review|reviews|compare|vs)\b"), "commercial").when(c.rlike(r"\b(login|sign in|official|website)\b"), "navigational")
        .when(c.rlike(r"\bnear me\b"), "local").when(c.rlike(r"^(how|what|why|when|where|who)\b|\b(guide|tutorial)\b"), "informational").otherwise("unclear")
    )


def keyword_opportunity(k: DataFrame) -> DataFrame:
    """volume * intent weight / difficulty, its funnel stage and priority."""
    i = k.withColumn("intent", intent(F.col("keyword")))
    w = F.when(F.col("intent") == "transactional", 1.5).when(F.col("intent").isin("commercial", "local"), 1.2).when(F.col("intent") == "navigational", 0.5).otherwise(1.0)
    i = i.withColumn("score", T.rounded(F.col("volume") * w / F.greatest("difficulty", F.lit(1)), 2))
    return i.select("keyword", "intent", F.when(F.col("intent").isin("transactional", "local"), "bottom").when(F.col("intent") == "commercial", "middle").otherwise("top").alias("funnel"), "score", F.when(F.col("score") >= 150, "P0").when(F.col("score") >= 80, "P1").when(F.col("score") >= 20, "P2").otherwise("P3").alias("priority"))


def ctr_gap(k: DataFrame, bands: DataFrame) -> DataFrame:
    """Keywords against the expected click rate of their position: a range join with a small dimension."""
    j = k.join(small(bands), (F.col("position") >= F.col("lo")) & (F.col("position") < F.col("hi")), "left")
    ctr = T.rounded(F.col("clicks") / F.col("impressions"), 4)
    return j.select("keyword", ctr.alias("ctr"), "expected_ctr", F.when(F.col("expected_ctr").isNull(), "no_band").when(ctr < F.col("expected_ctr") * 0.5, "low").when(ctr > F.col("expected_ctr") * 1.5, "high").otherwise("normal").alias("verdict"))


def query_triage(k: DataFrame) -> DataFrame:
    ctr = F.col("clicks") / F.col("impressions")
    c = F.when(F.col("position").between(4, 15), "quick_win").when((F.col("impressions") > 3000) & (ctr < 0.02), "rewrite_snippet").when(F.col("position") <= 3, "defend").otherwise("watch")
    b = F.when(F.col("position") <= 3, "1-3").when(F.col("position") <= 10, "4-10").when(F.col("position") <= 20, "11-20").otherwise("21+")
    return k.select("keyword", c.alias("action"), b.alias("bucket"))


def daily(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))


def _change(now, before):
    """(now - before) / before to four digits, half away from minus infinity: from whole numbers, so that every engine rounds alike."""
    return F.floor((F.lit(20_000) * (now - before) + before).cast("double") / (F.lit(2) * before)) / F.lit(10_000.0)


def traffic_drops(events: DataFrame, days: int = 7, percent: int = 15) -> DataFrame:
    """Days whose trailing week has over ``percent`` percent fewer events than the week before."""
    d = daily(events).withColumn("n", F.datediff("day", F.lit("2000-01-01")))
    # days are few: one row each, whatever the number of events
    now, then = W.orderBy("n").rangeBetween(-(days - 1), 0), W.orderBy("n").rangeBetween(-(2 * days - 1), -days)
    d = d.withColumn("week", F.sum("events").over(now)).withColumn("before", F.sum("events").over(then)).withColumn("full", F.count("*").over(then))
    d = d.where(F.col("full") == days)
    alert = F.lit(100) * (F.col("before") - F.col("week")) > F.lit(percent) * F.col("before")
    return d.select("day", "week", "before", _change(F.col("week"), F.col("before")).alias("change"), alert.alias("alert"))


def content_decay(events: DataFrame, percent: int = 20) -> DataFrame:
    """Event types that lose over ``percent`` percent between the first and the second half of the time covered."""
    span = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    late = F.expr("timestampdiff(MICROSECOND, a, ts) >= timestampdiff(MICROSECOND, ts, b)")
    g = events.crossJoin(F.broadcast(span)).groupBy("event_type").agg(F.count_if(~late).alias("earlier"), F.count_if(late).alias("later"))
    decayed = F.lit(100) * (F.col("earlier") - F.col("later")) > F.lit(percent) * F.col("earlier")
    return g.withColumn("change", F.when(F.col("earlier") > 0, _change(F.col("later"), F.col("earlier"))).otherwise(F.col("later").cast("double"))).withColumn("decayed", decayed)


def velocity_cv(events: DataFrame, windows: tuple = (10, 20, 30)) -> DataFrame:
    """Variation of daily counts over the last days: mean, deviation and their ratio by length of the window."""
    d = daily(events).select("day", "events")
    last = d.agg(F.max("day").alias("last"))
    x = d.crossJoin(F.broadcast(last)).withColumn("days", F.explode(F.array(*map(F.lit, windows)))).where(F.datediff("last", "day") < F.col("days"))
    return x.groupBy("days").agg(T.rounded(F.avg("events"), 4).alias("mean"), T.rounded(F.stddev_pop("events") / F.avg("events"), 4).alias("cv"))


def sessions(events: DataFrame, gap_minutes: int = 30, engaged_seconds: int = 10) -> DataFrame:
    """Sessions of a user by gaps: user_id, session, events, seconds, engaged (longer than ten seconds or two events and more)."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = events.withColumn("before", F.lag("ts").over(w))
    new = F.expr(f"before is null or timestampdiff(MICROSECOND, before, ts) > {gap_minutes * 60 * 1_000_000}").cast("long")
    s = e.withColumn("new", new).withColumn("session", F.sum("new").over(w))
    g = s.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.expr("timestampdiff(MICROSECOND, min(ts), max(ts)) div 1000000").alias("seconds"))
    return g.withColumn("engaged", (F.col("seconds") > engaged_seconds) | (F.col("events") >= 2))


def engagement(events: DataFrame) -> DataFrame:
    return sessions(events).groupBy("engaged").agg(F.count("*").alias("sessions"), T.rounded(F.avg("events"), 4).alias("avg_events"))


def event_log_report(events: DataFrame) -> DataFrame:
    """Mix of event types by day of week: share of the day's events."""
    g = events.groupBy(F.dayofweek("ts").cast("long").alias("weekday"), "event_type").agg(F.count("*").alias("events"))
    return g.withColumn("share", T.rounded(F.col("events") / F.sum("events").over(W.partitionBy("weekday")), 4))


def value_p75(events: DataFrame) -> DataFrame:
    """event_type, the exact third quartile of its values, and their number."""
    kinds = events.groupBy("event_type").agg(F.count("value").alias("n"))
    q = quantiles(events, "event_type", "value", 0.75).select(F.col("event_type").alias("kind"), T.rounded(F.col("quantile"), 4).alias("p75"))
    return kinds.join(q, F.col("event_type").eqNullSafe(F.col("kind")), "left").select("event_type", "p75", "n")


#: Requests by topic: pattern and route, the first that matches.
ROUTES = ((r"\b(error|broken|fail|bug)", "technical"), (r"\b(price|cost|buy|pay)", "commercial"), (r"\b(how|why|what|explain)", "content"), (r"\b(list|table|compare)", "report"))


def routed(turns: DataFrame) -> DataFrame:
    """Turns of users by route."""
    t = F.lower("text")
    c = F.when(t.rlike(ROUTES[0][0]), ROUTES[0][1])
    for p, r in ROUTES[1:]:
        c = c.when(t.rlike(p), r)
    return turns.where("role = 'user'").groupBy(c.otherwise("general").alias("route")).agg(F.count("*").alias("turns"))


def gap_by_region(supplier: DataFrame, nation: DataFrame, lineitem: DataFrame) -> DataFrame:
    """A volume stand-in for backlink rollups: suppliers as linking domains, parts as targets, by nation. It exercises the plans at size."""
    j = lineitem.join(supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey")), "l_suppkey").join(small(nation.select("n_nationkey", "n_name")), "n_nationkey")
    return j.groupBy("n_name").agg(F.count("*").alias("links"), F.countDistinct("l_suppkey").alias("domains"), F.countDistinct("l_partkey").alias("targets"))
