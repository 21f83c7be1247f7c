"""Near-duplicate vectors by PCA-ordered tiled comparison.

Equal vectors of a label are one item with a count. Items of a label are cut into tiles along the first
principal axis; tiles are compared if their stretches on that axis are close enough for the threshold. In a
pair of tiles inner products are accumulated over leading principal dimensions first: what the remaining
dimensions can add is bounded by the product of the suffix norms, and a pair is dropped once that can't reach
the threshold. Pairs that are left are decided by the cosine of the given vectors in double precision.

The axes come from a bounded sample of the items; they decide on the work alone, not on the result.
A pair of tiles returns a number of links for each item and a spanning forest, never the links themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checked_broadcast, components, forest, staged

THRESHOLD = 0.93
#: Items of a tile, items that the axes are fitted on, and pairs that are finished at once.
TILE, SAMPLE, PART = 1024, 4096, 100_000
#: Width of a bin of the first axis' histogram.
BIN = 1 / 256
#: Leading dimensions after which pairs are dropped.
LEADS = (8, 16, 32, 64, 128, 256, 512, 1024, 2048)
#: Slack of the bounds for rounding.
EPS = 1e-9


def axes(sample: np.ndarray) -> np.ndarray:
    """Orthonormal columns by falling variance of the directions in ``sample``."""
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    return np.linalg.eigh(x.T @ x)[1][:, ::-1]


def linked(x: np.ndarray, y: np.ndarray, rotation: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of rows with a cosine of at least ``threshold``; of i < j only where x is y (``same``)."""
    nx, ny = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", y, y))
    rx, ry = (x / nx[:, None]) @ rotation, (y / ny[:, None]) @ rotation
    d = x.shape[1]
    cuts = [c for c in LEADS if c < d] or [d]
    tail = lambda r: np.sqrt(np.maximum(0, np.cumsum((r * r)[:, ::-1], axis=1)[:, ::-1]))
    tx, ty = (np.concatenate([tail(r), np.zeros((len(r), 1))], axis=1) for r in (rx, ry))
    out_i, out_j = [], []
    k = cuts[0]
    rows = max(1, 2_000_000 // max(1, len(y)))
    for a in range(0, len(x), rows):
        lead = rx[a : a + rows, :k] @ ry[:, :k].T
        near = lead + tx[a : a + rows, k, None] * ty[None, :, k] >= threshold - EPS
        if same:
            near &= np.arange(len(y))[None, :] > np.arange(a, min(a + rows, len(x)))[:, None]
        i_all, j_all = np.nonzero(near)
        sums = lead[i_all, j_all]
        i_all = i_all + a
        for s in range(0, len(i_all), PART):
            i, j, total = i_all[s : s + PART], j_all[s : s + PART], sums[s : s + PART]
            for lo, hi in zip(cuts, [*cuts[1:], d], strict=True):
                if hi >= d or not len(i):
                    break
                total = total + np.einsum("ij,ij->i", rx[i, lo:hi], ry[j, lo:hi])
                stay = total + tx[i, hi] * ty[j, hi] >= threshold - EPS
                i, j, total = i[stay], j[stay], total[stay]
            if len(i):
                yes = np.einsum("ij,ij->i", x[i], y[j]) / (nx[i] * ny[j]) >= threshold
                out_i.append(i[yes])
                out_j.append(j[yes])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_i]), np.concatenate([none, *out_j])


def _usable():
    e = F.col("embedding")
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.col("label").isNotNull() & e.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(e, lambda v: v != 0)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Rows with a null label and vectors that are null, empty, zero or hold null or non-finite components have
    no links and are their own component; so have vectors whose copies all have a null vec_id. Vectors of
    different length are never linked. Copies count as links of each other. Rows that share a vec_id are vectors of their
    own: items are told apart by label and vector alone, so an id under two labels links nothing. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    v = vectors.select("vec_id", "label", "embedding", F.coalesce(_usable(), F.lit(False)).alias("_ok"))
    classes = v.where("_ok").groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).where("id is not null").withColumn("dim", F.size("embedding"))
    classes = staged(classes.withColumn("key", F.monotonically_increasing_id()))  # written with the keys, which so stay what they are
    sizes = classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dim").limit(1).collect()
    main = sizes[0]["dim"] if sizes else 0
    sample = classes.where(F.col("dim") == main).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").collect()
    shared = spark.sparkContext.broadcast(axes(np.array([r[0] for r in sample], np.float64)) if sample else np.zeros((0, 0)))

    def rotation(d: int) -> np.ndarray:
        return shared.value if shared.value.shape[0] == d else np.eye(d)

    def place(batches):
        for b in batches:
            size, axis = b.column("dim").to_numpy(), np.zeros(b.num_rows)
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                x = b.column("embedding").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                axis[at] = (x @ rotation(d)[:, 0]) / np.linalg.norm(x, axis=1)
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("label", "dim", "key", "n", "embedding")), pa.array(axis)], names=["label", "dim", "key", "n", "embedding", "axis"])

    kinds = dict(classes.dtypes)
    e = classes.select("label", "dim", "key", "n", "embedding").mapInArrow(place, f"label {kinds['label']}, dim int, key long, n long, embedding {kinds['embedding']}, axis double")
    e = staged(e.withColumn("bin", F.floor(F.col("axis") / BIN)))
    bins = e.groupBy("label", "dim", "bin").agg(F.count("*").alias("c"), F.min("axis").alias("lo"), F.max("axis").alias("hi"))
    before = F.sum("c").over(W.partitionBy("label", "dim").orderBy("bin")) - F.col("c")
    bins = staged(bins.withColumn("tile", F.floor(before / TILE)).withColumn("subs", F.greatest(F.lit(1), F.ceil(F.col("c") / TILE)).cast("int")))
    tiles = bins.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).groupBy("label", "dim", "tile", "sub").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    tiles = staged(tiles)
    # linked directions are at most this far apart on any axis
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6)
    a, b = tiles.alias("a"), tiles.alias("b")
    order = (F.col("a.tile") < F.col("b.tile")) | ((F.col("a.tile") == F.col("b.tile")) & (F.col("a.sub") <= F.col("b.sub")))
    pairs = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.dim") == F.col("b.dim")) & order & (F.col("b.lo") - F.col("a.hi") <= reach) & (F.col("a.lo") - F.col("b.hi") <= reach))
    pairs = pairs.select(F.col("a.label").alias("label"), F.col("a.dim").alias("dim"), *(F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("tile", "sub")))
    pairs = staged(pairs.withColumn("pair", F.xxhash64("label", "dim", "tile_a", "sub_a", "tile_b", "sub_b")))
    sides = pairs.select("label", "dim", F.col("tile_a").alias("tile"), F.col("sub_a").alias("sub"), "pair", F.lit(0).alias("side"))
    sides = sides.union(pairs.where("tile_a <> tile_b or sub_a <> sub_b").select("label", "dim", "tile_b", "sub_b", "pair", F.lit(1)))
    rows = e.join(checked_broadcast(bins.select("label", "dim", "bin", "tile", "subs")), ["label", "dim", "bin"]).withColumn("sub", F.pmod(F.xxhash64("key"), F.col("subs")).cast("int"))
    rows = rows.join(checked_broadcast(sides), ["label", "dim", "tile", "sub"]).select("pair", "side", "dim", "key", "n", "embedding")

    def compare(t: pa.Table) -> pa.Table:
        side, d = t.column("side").to_numpy(), t.column("dim")[0].as_py()
        ids, n = t.column("key").to_numpy(), t.column("n").to_numpy()
        x = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        at_a, at_b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = not len(at_b)
        i, j = linked(x[at_a], x[at_a if same else at_b], rotation(d), threshold, same)
        i, j = at_a[i], (at_a if same else at_b)[j]
        count = np.bincount(i, n[j], len(ids)) + np.bincount(j, n[i], len(ids))
        label = forest(len(ids), i, j)
        has, child = np.flatnonzero(count), np.flatnonzero(label != np.arange(len(ids)))
        u = np.concatenate([ids[has], ids[child]])
        v = pa.array(np.concatenate([ids[has], ids[label[child]]]), pa.int64(), mask=np.arange(len(u)) < len(has))
        return pa.table({"u": pa.array(u, pa.int64()), "v": v, "links": pa.array(np.concatenate([count[has], np.zeros(len(child))]).astype(np.int64))})

    found = staged(rows.groupBy("pair").applyInArrow(compare, "u long, v long, links long"))
    links = found.groupBy("u").agg(F.sum("links").alias("links"))
    comp = components(found.where("v is not null").select("u", "v"))
    c = classes.select("label", "embedding", "key", "id", "n").join(links.withColumnRenamed("u", "key"), "key", "left").join(comp.withColumnRenamed("id", "key"), "key", "left").withColumn("root", F.coalesce("component", "key"))
    least = c.where("component is not null").groupBy("root").agg(F.min("id").alias("least"))
    c = c.join(least, "root", "left")
    c = c.select(F.col("label").alias("_l"), F.col("embedding").alias("_e"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    done = v.where("_ok").join(c, (F.col("label") == F.col("_l")) & (F.col("embedding") == F.col("_e")), "left")
    done = done.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    done = done.unionByName(v.where("not _ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return done.withColumn("kept", F.col("vec_id") == F.col("component_id"))


#: All pairs within a label in SQL, and components by recursion.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings WHERE label IS NOT NULL),
e AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_inner_product(a.x, b.x) / (a.n * b.n) >= 0.93),
r(a, z) AS (SELECT u, v FROM e UNION SELECT r.a, e.v FROM r JOIN e ON r.z = e.u),
c AS (SELECT a AS vec_id, min(z) AS least FROM r GROUP BY a), l AS (SELECT u AS vec_id, count(*) AS links FROM e GROUP BY u)
SELECT vec_id, coalesce(links, 0)::BIGINT AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM embeddings LEFT JOIN l USING (vec_id) LEFT JOIN c USING (vec_id)
"""
