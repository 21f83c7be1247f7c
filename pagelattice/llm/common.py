"""Shared pieces of the training-data operators: reading tables, staging, size-checked joins, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of the contracts: maximal runs of characters that are not one of these six.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: A side of a join is broadcast only when it was counted and its rows take at most this many bytes, by the default
#: sizes of its types, a string taken as long as STRING_BYTES and each row with ROW_BYTES more for its place in the hash table.
BROADCAST_BYTES = 48 << 20
STRING_BYTES, ROW_BYTES = 64, 32


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder name under the shared folder that ``spark.checkpoint.dir`` names.

    Where that is unset a temporary folder is taken in local mode, as driver and tasks share the machine; on a
    cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/pagelattice-{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def staged(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Most bytes of an Arrow batch of whole texts, as far as one row isn't larger.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of the session's Arrow batches, so that a batch of long texts fits a worker.

    A lower bound that the session has already stays; the bound stays set, as plans run after this returns.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, str(2**31 - 1)).lower().removesuffix("b")
    if not now.isdecimal() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def row_bytes(kind) -> int:
    """Estimated bytes of a value of a type; arrays and maps are not bounded by their type and may not be broadcast."""
    if isinstance(kind, T.StructType):
        return 16 + sum(row_bytes(f.dataType) for f in kind)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        raise ValueError("a side with arrays has no bound by its number of rows")
    return STRING_BYTES if isinstance(kind, (T.StringType, T.BinaryType)) else 8


def checked_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if a count shows that it takes few bytes (or ``rows`` rows at most); otherwise as it is, for a shuffled join.

    ``df`` is to be a staged table: it is counted here and read again by the join.
    """
    most = BROADCAST_BYTES // (ROW_BYTES + row_bytes(df.schema))
    return F.broadcast(df) if df.count() <= min(most, rows or most) else df


def private(df: DataFrame, *plain: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with all columns but ``plain`` renamed, so that they clash with no working column, and the new name of each."""
    names = {c: c if c in plain else f"_in{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the fold that no training step may read."""
    return (F.crc32(doc_id.cast("string")) % 5) == 0


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


#: Edges that one task joins to a forest.
EDGES = 2_000_000


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches over links i - j."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """Each task's edges as links of every node to the least one that it reaches within the task."""

    def run(batches):
        held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
        if held:
            u, v = (np.concatenate(x) for x in zip(*held, strict=True))
            names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            label = forest(len(names), at[: len(u)], at[len(u) :])
            child = np.flatnonzero(label != np.arange(len(names)))
            yield pa.RecordBatch.from_arrays([pa.array(names[child], pa.int64()), pa.array(names[label[child]], pa.int64())], names=["u", "v"])

    return edges.coalesce(tasks).mapInArrow(run, "u long, v long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components by a distributed union-find: (id, component) for every node of an edge between different nodes.

    ``edges`` has long columns u, v in any direction, with repeats allowed; component is the least node
    reachable. No edges: no rows. Edges are dealt to as many tasks as hold EDGES each, which join their own to
    forests. What several tasks found is merged by alternating large-star and small-star joins: each round is one
    staged table, so that lineage stays short; a hub's edges are aggregated map-side and its join may be split
    by adaptive execution.
    """
    e = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v"))
    tasks = -(-e.count() // EDGES)
    if tasks:
        e = staged(_contracted(e, tasks))
    if tasks > 1:
        e = _merged(e, rounds)
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _merged(e: DataFrame, rounds: int) -> DataFrame:
    """Links of each node to the least one that it reaches, by star joins until nothing changes."""
    seen = _summary(e)
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        e = staged(small)
        now = _summary(e)
        if now == seen:
            return e
        seen = now
    raise RuntimeError(f"components did not settle within {rounds} rounds")
