"""Staging of results that several branches of a plan read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder name under the shared folder of ``spark.checkpoint.dir``.

    Where that is unset a temporary folder is taken in local mode; on a cluster, where machines share no such folder, it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/pagelattice-{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Most bytes of an Arrow batch of whole texts, as far as one row isn't larger.
BATCH_BYTES = 1 << 20


def in_batches(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow(f, schema)`` in batches of BATCH_BYTES, so that a worker's memory doesn't grow with the rows of its task.

    A lower bound that the session has already stays; the bound stays set, as plans run after this returns.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(name, str(2**31 - 1)).lower().removesuffix("b")
    if not now.isdecimal() or int(now) > BATCH_BYTES:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(f, schema)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it was counted and has at most ``rows`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if len(df.columns) < 64 and df.limit(rows + 1).count() <= rows else df
