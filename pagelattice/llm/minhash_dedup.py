"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

A document's set holds its distinct five-word shingles, each as two independent 64-bit hashes: the first orders and
sketches the sets (within a set of n shingles two have it in common with a probability under n * n / 2**65), and
shingles are the same only where both agree. Fewer words are one shingle; no words, no set. Equal sets are
one item, told apart by two 64-bit fingerprints, one of each hash: where two different sets have the first in common, the second
is their id. Sets are
linked if 100 * intersection >= 75 * union, always decided on the full sets. A pair at the threshold is no
candidate with a probability of (1 - 0.75**5)**50, about one in a million.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, private, small_batches, staged
from .neardup import PACKED, fresh, link, packs, places_for
from .sketch import bands, distinct, mix, shingles, short, sketch, words

K, PERCENT = 5, 75
BANDS, ROWS = 50, 5
#: Sketch agreement below which a pair isn't verified: 5.5 standard deviations under 0.75 at 250 coordinates.
FLOOR = 0.6
#: Bytes of text that are handled at once; a longer text is handled alone.
CHUNK = 500_000


def _chunks(column: pa.Array):
    """(first row, row after the last, bytes, offsets) of stretches of a string column; null is an empty text."""
    column = column.fill_null("") if column.null_count else column
    wide = column.cast(pa.large_string())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2], np.uint8) if wide.buffers()[2] else np.zeros(0, np.uint8)
    a = 0
    while a < len(wide):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def _sets(data, offsets, k):
    """Two hashes of every distinct shingle, in ascending order of the first, and the offsets of texts."""
    one, at = shingles(*words(data, offsets), k)
    two, _ = shingles(*words(data, offsets, lane=7), k)
    places, new = distinct(one, at)
    return one[places], two[places], new


def _fingerprint(values, offsets, salt: int = 0):
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values + np.uint64(salt)), dtype=np.uint64)])
    return mix((total[offsets[1:]] - total[offsets[:-1]]) ^ np.diff(offsets).astype(np.uint64)).view(np.int64)


#: Added to the second hashes for the second fingerprint.
SALT = 0x5851F42D4C957F2D


def _vectors(column: pa.Array, rows: np.ndarray) -> pa.ListArray:
    flat = pa.array(rows.reshape(-1).view(np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), flat)


def items(docs: DataFrame, k: int = K, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, h, n_shingles, fp, fp2, bands, sk) of every document, h the hash of its text; fp, fp2, bands and sk are null for empty sets."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for lo, hi, data, offsets in _chunks(b.column(2)):
                values, second, at = _sets(data, offsets, k)
                n = np.diff(at)
                sk = sketch(values, at, n_bands * rows)
                void = pa.array(n == 0)
                none = lambda x: pa.compute.if_else(void, pa.scalar(None, x.type), x)
                sk8 = short(sk)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(c).slice(lo, hi - lo) for c in (0, 1)), pa.array(n, pa.int64()), none(pa.array(_fingerprint(values, at))), none(pa.array(_fingerprint(second, at, SALT))),
                        _vectors(b.column(0), bands(sk, rows)), pa.array([r.tobytes() for r in sk8], pa.binary()),
                    ],
                    names=["doc_id", "h", "n_shingles", "fp", "fp2", "bands", "sk"],
                )

    import pyarrow.compute  # noqa: F401

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, f"doc_id {kind}, h long, n_shingles long, fp long, fp2 long, bands array<long>, sk binary")


def _buckets(some: DataFrame, places: int) -> DataFrame:
    """Packed bands of items (fp, bands); each task makes those of an item once."""

    def keys(batches):
        seen: set = set()
        for b in batches:
            b = b.take(pa.array(fresh(b.column("fp").to_numpy(), seen)))
            if b.num_rows:
                yield b.column("fp").to_numpy(), b.column("bands").flatten().to_numpy().reshape(b.num_rows, -1).view(np.uint64)

    return some.select("fp", "bands").mapInArrow(lambda batches: packs(keys(batches), places), PACKED)


def _payload(docs: DataFrame, by: DataFrame, k: int):
    """Full sets of given items, as the first hashes in ascending order and then the second ones, each made from one document that has it, which ``by`` names."""

    def sets(ids: DataFrame) -> DataFrame:
        wanted = by.join(checked_broadcast(staged(ids)), "fp").select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), F.col("fp").alias("id"), "fp1", "fp2")
        found = docs.select("doc_id", "text").withColumn("h", F.xxhash64("text"))
        chosen = found.join(checked_broadcast(staged(wanted)), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h"))).select("id", "fp1", "fp2", "text")

        def run(batches):
            for b in batches:
                for lo, hi, data, offsets in _chunks(b.column(3)):
                    values, second, at = _sets(data, offsets, k)
                    right = (_fingerprint(values, at) == b.column(1).slice(lo, hi - lo).to_numpy()) & (_fingerprint(second, at, SALT) == b.column(2).slice(lo, hi - lo).to_numpy())
                    part = pa.array([values[x:y].tobytes() + second[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), part], names=["fp", "payload"]).filter(pa.array(right))

        return chosen.mapInArrow(run, "fp long, payload binary").dropDuplicates(["fp"])

    return sets


def _numbers(payloads: list[bytes]) -> list[np.ndarray]:
    """The first hashes of sets."""
    return [np.frombuffer(x, np.uint64)[: len(x) // 16] for x in payloads]


def alike(percent: int):
    """Tells for sets, as ``_payload`` gives them, whether 100 * intersection >= percent * union; shingles are the same if both hashes are."""

    def run(left: list[bytes], right: list[bytes]) -> list[bool]:
        out = []
        for x, y in zip(left, right, strict=True):
            a, b = np.frombuffer(x, np.uint64).reshape(2, -1), np.frombuffer(y, np.uint64).reshape(2, -1)
            n, m, both = a.shape[1], b.shape[1], 0
            if 100 * min(n, m) >= percent * max(n, m):
                _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
                both = int((a[1][i] == b[1][j]).sum())
            out.append(100 * both >= percent * (n + m - both))
        return out

    return run


def _roots(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Staged (doc_id, h, n_shingles, root) of every row; root is the same for linked documents, null without shingles."""
    all_ = staged(items(docs, k))
    some = all_.where("fp is not null")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    best = staged(some.groupBy("fp").agg(F.min(F.struct(place.alias("p"), "fp2")).alias("m"), F.min("fp2").alias("a"), F.max("fp2").alias("b")))
    bad = staged(best.where("a <> b").select("fp"))
    if bad.isEmpty():
        by = best.select("fp", "m.p.doc_id", "m.p.h", F.col("fp").alias("fp1"), "m.fp2")
        named = some
    else:  # different sets with one fingerprint: expected from some billions of documents on
        tagged = all_.join(checked_broadcast(bad.withColumn("_bad", F.lit(True))), "fp", "left").withColumn("fp1", F.col("fp"))
        all_ = staged(tagged.withColumn("fp", F.when(F.col("_bad"), F.col("fp2")).otherwise(F.col("fp"))).drop("_bad"))
        named = all_.where("fp is not null")
        by = named.groupBy("fp").agg(F.min(F.struct(place.alias("p"), "fp1", "fp2")).alias("m")).select("fp", "m.p.doc_id", "m.p.h", "m.fp1", "m.fp2")
        by = staged(by)

    def sketches(ids: DataFrame) -> DataFrame:
        return named.join(checked_broadcast(staged(ids)), "fp", "left_semi").groupBy("fp").agg(F.first("sk").alias("sk"))

    found = link(_buckets(named, places_for(named.count(), BANDS)), _payload(docs, by, k), alike(percent), _numbers, percent, FLOOR, sketches, estimate=True)
    d = all_.select("doc_id", "h", "n_shingles", "fp").join(checked_broadcast(found).withColumnRenamed("id", "fp"), "fp", "left")
    return staged(d.select("doc_id", "h", "n_shingles", F.coalesce("component", "fp").alias("root")))


def near_duplicates(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Null and empty texts have no shingles and are linked with nothing. Rows that share a doc_id are taken as
    one document each; all are returned. A null doc_id is never the least of a component unless all are
    null. Equal sets are one item, so thousands of copies cost no more than one. Empty table: no rows. Other
    columns are not read.
    """
    d = _roots(docs, k, percent)
    least = d.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    j = d.join(checked_broadcast(staged(least)), "root", "left")
    return j.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), (F.col("doc_id") == F.coalesce("least", "doc_id")).alias("kept"))


def deduplicated(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: the least by doc_id (null last), then by hash of the text.

    Rows are told apart by doc_id and text: of rows equal in both one stays, also where the id is null. Rows
    without shingles all stay. Columns of any name are passed on.
    """
    d = _roots(docs, k, percent).where("root is not null")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    least = d.groupBy("root").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("root", "first")
    j = staged(d.join(checked_broadcast(staged(least)), "root").withColumn("is_first", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h").eqNullSafe(F.col("first"))))
    gone = staged(j.where("not is_first").select(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).distinct())
    many = staged(j.where("is_first").groupBy(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).count().where("count > 1").select("_d", "_h"))
    left, names = private(docs, "doc_id", "text")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_h"))
    left = left.join(checked_broadcast(gone), same, "left_anti")
    if not many.isEmpty():
        few = checked_broadcast(many)
        left = left.join(few, same, "left_anti").unionByName(left.join(few, same, "left_semi").dropDuplicates(["doc_id", "text"]))
    return left.select(*(F.col(names[c]).alias(c) for c in docs.columns))


#: All pairs by shared shingles in SQL, and components by recursion.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r(a, z) AS (SELECT u, v FROM b UNION SELECT r.a, b.v FROM r JOIN b ON r.z = b.u),
c AS (SELECT a AS doc_id, min(z) AS least FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(c.least, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(c.least, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
