"""Event-time operators on streams: windowed counts, sliding drops, sessions, de-duplication of a crawl frontier, a stateful back-off.

All work on batch frames too (a batch is a finite stream), which is how they are tested against the batch models.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, a bounded number of files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def timed(events: DataFrame) -> DataFrame:
    """Event time as a timestamp with time zone, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, length: str = "1 day", late: str = "1 day") -> DataFrame:
    """Tumbling windows: events and users (approximate) by type; rows later than ``late`` are dropped."""
    w = timed(events).withWatermark("ts", late).groupBy(F.window("ts", length), "event_type")
    return w.agg(F.count("*").alias("events"), F.approx_count_distinct("user_id").alias("users")).select(F.col("window.start").alias("start"), "event_type", "events", "users")


def sliding_counts(events: DataFrame, length: str = "7 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    """Sliding windows, the base of week-over-week drop alerts."""
    w = timed(events).withWatermark("ts", late).groupBy(F.window("ts", length, step))
    return w.agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "events")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Session windows of a user; engaged: two events or more."""
    w = timed(events).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap))
    return w.agg(F.count("*").alias("events")).select("user_id", F.col("session_window.start").alias("start"), "events", (F.col("events") >= 2).alias("engaged"))


def unseen(links: DataFrame, key: str = "url", late: str = "1 day") -> DataFrame:
    """Each key once within the watermark: the growing seen-set of a crawl frontier."""
    return timed(links).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def backoff(failures: DataFrame, base_seconds: int = 3, most: int = 6) -> DataFrame:
    """Seconds to wait after each failure of a host, doubling up to ``most`` times, by state per host: host, failures, wait_seconds."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator, state: GroupState):
        import pandas as pd

        n = state.get[0] if state.exists else 0
        for f in frames:
            for ok in f["ok"]:
                n = 0 if ok else min(n + 1, most)
        state.update((n,))
        yield pd.DataFrame({"host": [key[0]], "failures": [n], "wait_seconds": [base_seconds * 2 ** (n - 1) if n else 0]})

    return failures.groupBy("host").applyInPandasWithState(step, "host string, failures int, wait_seconds int", "failures int", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all there is and return its result as a table in memory; for tests and small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
