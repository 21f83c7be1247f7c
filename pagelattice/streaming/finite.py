"""Streams over tables that end: a frontier that paces hosts, and drop alerts by chained windows, each run to its end and read as a table.

A table is read as a stream of its files. When it has been read, markers with times far in the future move the watermark on, so
that all state is released; they themselves are never part of a result. What comes later than the watermark allows is dropped, as on any stream.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import urls as U
from ..plans.stage import scratch

#: Seconds from the epoch to the second 0 of arrivals: what is at or before the first watermark, the epoch, is late.
ORIGIN = 946_684_800
#: Times of markers, in years after which no row is expected.
MARKERS = ("2200-01-01", "2220-01-01", "2240-01-01")


@contextmanager
def _settings(spark: SparkSession, **new: str) -> Iterator[None]:
    """Session settings for the time of a run."""
    old = {k: spark.conf.get(k, None) for k in new}
    try:
        for k, v in new.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def run_to_end(spark: SparkSession, path: str, rows: Callable[[DataFrame], DataFrame], build: Callable[[DataFrame], DataFrame], files: int | None = None, markers: int = 1) -> DataFrame:
    """What ``build`` makes of the stream of a Parquet table, after all of it was read and all state was released.

    rows: from the table's stream to what ``build`` takes, with a timestamp ``ts``; markers are rows with null in all other columns.
    files: most files of a micro-batch. markers: one for each operator with state that follows on another, and one more. State, markers and results are under the shared folder, so a run that is
    restarted by another driver could go on from there.
    """
    base = f"{scratch(spark)}/{uuid.uuid4().hex}"
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    # as a pattern, for a stream's own path must be a folder and the table may be a single file
    table = rows((source.option("maxFilesPerTrigger", files) if files else source).parquet(f"{path[:-1]}[{path[-1]}]"))
    marker = spark.createDataFrame([], table.schema)
    marker.write.parquet(f"{base}/markers")
    both = build(table.unionByName(spark.readStream.schema(table.schema).parquet(f"{base}/markers")))

    def run() -> None:
        both.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).queryName(f"r{uuid.uuid4().hex}").start().awaitTermination()

    # changes alone are written after a batch, not all state, and no more batches are kept than a restart needs
    store = {"stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "stateStore.rocksdb.changelogCheckpointing.enabled": "true", "minBatchesToRetain": "2"}
    with _settings(spark, **{f"spark.sql.streaming.{k}": v for k, v in store.items()}):
        run()
        for at in MARKERS[:markers]:  # chained operators pass the watermark on one after the other
            one = spark.range(1).select(*(F.lit(at if f.name == "ts" else None).cast(f.dataType).alias(f.name) for f in table.schema))
            one.write.mode("append").parquet(f"{base}/markers")
            run()
    return spark.read.schema(both.schema).parquet(f"{base}/out")


# --- drop alerts -----------------------------------------------------------------------------------------


def drop_alerts(events: DataFrame, days: int = 7, percent: int = 15, late: str = "1 day") -> DataFrame:
    """day, week, before, change and alert of every day with events whose ``days`` days before the last ``days`` all have events.

    A stream with a timestamp ``ts``: daily counts, then sliding windows of twice ``days`` over them, both kept by event time; rows up to ``late`` behind count.
    """
    daily = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(F.count("kind").alias("n")).select(F.window_time("window").alias("at"), F.col("window.start").alias("day"), "n")
    last = F.date_sub(F.to_date("both.end"), 1)
    recent = F.col("day") >= F.col("both.start") + F.expr(f"INTERVAL {days} DAYS")
    d = daily.where("n > 0").select(F.window("at", f"{2 * days} days", "1 day").alias("both"), "day", "n")
    d = d.groupBy("both").agg(F.coalesce(F.sum(F.when(recent, F.col("n"))), F.lit(0)).alias("week"), F.sum(F.when(~recent, F.col("n"))).alias("before"), F.count_if(~recent).alias("full"), F.max("day").alias("newest"))
    d = d.where((F.col("full") == days) & (F.to_date("newest") == last))
    change = F.floor((F.lit(20_000) * (F.col("week") - F.col("before")) + F.col("before")).cast("double") / (F.lit(2) * F.col("before"))) / F.lit(10_000.0)
    return d.select(last.alias("day"), "week", "before", change.alias("change"), (F.lit(100) * (F.col("before") - F.col("week")) > F.lit(percent) * F.col("before")).alias("alert"))


def drops_of(spark: SparkSession, path: str, late: str = "1 day", files: int | None = None) -> DataFrame:
    """Drop alerts of a table of events, as a stream."""
    return run_to_end(spark, path, lambda e: e.select(F.col("ts").cast("timestamp").alias("ts"), F.lit("event").alias("kind")), lambda e: drop_alerts(e, late=late), files, markers=3)


def log_mix(events: DataFrame, late: str = "1 day") -> DataFrame:
    """start, event_type, events and users (at least ``late`` behind the newest row): a monitored log's mix by day, each window once."""
    return events.where("event_type is not null or ts >= '2200-01-01'").withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("events")).where("event_type is not null").select(F.col("window.start").alias("start"), "event_type", "events")


# --- a frontier that paces hosts -------------------------------------------------------------------------


def paced(arrivals: DataFrame, delay: int, burst: int) -> DataFrame:
    """host, url, arrival, release (seconds) by windows over a whole table: the batch form of ``polite``.

    A URL counts at its first arrival; a host starts with ``burst`` tokens and gets one every ``delay`` seconds; URLs are released in the order of arrival and URL.
    """
    first = arrivals.where("host is not null and url is not null").groupBy("host", "url").agg(F.min("arrival").alias("arrival"))
    order = W.partitionBy("host").orderBy("arrival", "url")
    p = first.withColumn("i", F.row_number().over(order) - 1)
    due = F.max(F.col("arrival") - F.col("i") * delay).over(order.rowsBetween(W.unboundedPreceding, -1)) + F.col("i") * delay
    return p.select("host", "url", "arrival", F.greatest(F.col("arrival"), due - (burst - 1) * delay).alias("release"))


def polite(arrivals: DataFrame, delay: int, burst: int, late: str, slot: int = 3600) -> DataFrame:
    """host, url, arrival and release of a stream of arrivals (host, url, arrival in seconds, ts = ORIGIN + arrival): no host faster than its tokens allow.

    State by host: the time at which its next token is due, the URLs seen, and arrivals by slots of ``slot`` seconds. A slot has an event-time timer;
    when the watermark has passed it, its arrivals are released in order. So arrivals may come in any order within ``late``.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Pace(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.due = handle.getValueState("due", "due long")
            self.seen = handle.getMapState("seen", "url string", "release long")
            self.waiting = handle.getMapState("waiting", "slot long", "at array<long>, url array<string>")

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802  the interface's name
            import pandas as pd

            by: dict[int, tuple[list[int], list[str]]] = {}
            for frame in rows:
                frame = frame[frame["url"].notna()]
                for at, url in zip(frame["arrival"].tolist(), frame["url"].tolist(), strict=True):
                    held = by.setdefault(int(at) // slot, ([], []))
                    held[0].append(int(at))
                    held[1].append(url)
            for s, (at, url) in by.items():
                if self.waiting.containsKey((s,)):
                    old = self.waiting.getValue((s,))
                    at, url = [*old[0], *at], [*old[1], *url]
                else:
                    self.handle.registerTimer((ORIGIN + (s + 1) * slot) * 1000)
                self.waiting.updateValue((s,), (at, url))
            yield pd.DataFrame({"host": pd.Series([], dtype=str), "url": pd.Series([], dtype=str), "arrival": pd.Series([], dtype="int64"), "release": pd.Series([], dtype="int64")})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
            import pandas as pd

            s = (expiredTimerInfo.getExpiryTimeInMs() // 1000 - ORIGIN) // slot - 1
            at, urls = self.waiting.getValue((s,))
            self.waiting.removeKey((s,))
            due = self.due.get()[0] if self.due.exists() else None
            out = []
            for a, u in sorted(set(zip(at, urls, strict=True))):
                if self.seen.containsKey((u,)):
                    continue
                go = a if due is None else max(a, due - (burst - 1) * delay)
                due = max(a, a if due is None else due) + delay
                self.seen.updateValue((u,), (go,))
                out.append((key[0], u, a, go))
            if out:
                self.due.update((due,))
            yield pd.DataFrame(out, columns=["host", "url", "arrival", "release"]).astype({"arrival": "int64", "release": "int64"})

        def close(self) -> None:
            pass

    keyed = arrivals.where("host is not null and url is not null and arrival is not null or ts >= '2200-01-01'").withColumn("host", F.coalesce("host", F.lit(""))).withWatermark("ts", late)
    # markers reach the state, as a filter on them would be moved before the watermark
    return keyed.groupBy("host").transformWithStateInPandas(statefulProcessor=Pace(), outputStructType="host string, url string, arrival long, release long", outputMode="Append", timeMode="EventTime")


def frontier_of(spark: SparkSession, path: str, delay: int = 600, burst: int = 2, late: str = "36500 days", files: int | None = None) -> DataFrame:
    """The URLs of a table of pages as a crawl's frontier: page n arrives in the second n, and hosts are paced."""

    def rows(pages: DataFrame) -> DataFrame:
        u = U.normal_b(F.col("url"))
        return pages.select(U.host(F.col("url")).alias("host"), u.alias("url"), F.col("page_id").cast("long").alias("arrival"), F.timestamp_seconds(F.col("page_id") + ORIGIN).alias("ts"))

    return run_to_end(spark, path, rows, lambda a: polite(a, delay, burst, late), files)
