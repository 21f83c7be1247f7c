"""Fuzzy line dedup by MinHash: one line of each component of near-equal lines stays.

Lines are compared in lower case and without blanks at their ends (the six characters that part words). Equal
lines are one item, told apart by two 64-bit hashes; the set of an item holds its character shingles. Fast similarity sketches are banded for high recall, candidates are decided by the exact
Jaccard similarity of the shingles, and a distributed union-find gives the components. Of each component the
first line by document and place stays, whatever the number of its copies; blank lines are left alone.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, private, small_batches, staged
from .neardup import PACKED, fresh, link, packs, places_for
from .sketch import bands, mix, short, sketch

#: Characters of a shingle and the least Jaccard similarity of linked lines, in percent. One edited character in a
#: line of 40 has (36 - 5) / (36 + 5), just over 0.75; longer shingles or a higher threshold would lose it.
K, PERCENT = 5, 75
#: A pair at the threshold is no candidate with a probability of (1 - 0.75**7)**24, 3 in 100; at 0.8 it is 4 in 1,000 and at 0.85 2 in 10,000.
#: Fewer rows a band would let lines that are half alike share buckets.
BANDS, ROWS = 24, 7
#: Agreement of 168 coordinates below which lines of a crowded bucket aren't verified: 5 standard deviations under 0.75.
FLOOR = 0.58
#: Blanks at the ends of a line, as Spark's btrim takes them.
ENDS = " \t\n\x0b\x0c\r"
#: Characters that are hashed at once: few enough for a processor's cache.
CHUNK = 80_000

#: Powers of an odd base for the characters of a shingle.
_BASE = 0x9E3779B97F4A7C15


def shingles(lines: list[str], k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-character shingles of the lines, with repeats, and offsets by line; shorter lines are one shingle."""
    size = np.array([len(x) for x in lines], np.int64)
    # NUL characters after the last line fill up shingles that reach beyond it; shorter lines get theirs below
    code = np.frombuffer(("".join(lines) + "\0" * k).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(code) - k, np.uint64)
    for j in range(k):
        h *= np.uint64(_BASE)
        h += code[j : j + len(h)]
    h = mix(h)
    made = np.where(size >= k, size - k + 1, np.minimum(size, 1))
    offsets = np.concatenate([[0], np.cumsum(made)])
    begin = np.cumsum(size) - size
    values = h[np.repeat(begin - offsets[:-1], made) + np.arange(offsets[-1])]
    for i in np.flatnonzero((size > 0) & (size < k)).tolist():
        x = int(size[i])
        for c in lines[i]:
            x = (x * _BASE + ord(c) + 1) % 2**64
        values[offsets[i]] = mix(np.array([x], np.uint64))[0]
    return values, offsets


def _chunks(lines: list[str]):
    """Places of the lines in chunks of about CHUNK characters, in order of length: lines of one length fill their sketches in as many rounds, so that few short ones don't keep a chunk going."""
    size = np.array([len(x) for x in lines], np.int64)
    order = np.argsort(size, kind="stable")
    if len(order):
        yield from np.split(order, np.flatnonzero(np.diff(np.cumsum(size[order]) // CHUNK)) + 1)


def _starts(line):
    return reduce(or_, (line.startswith(c) for c in ENDS))


def _solid(line):
    """Whether a line is not blank; told by the first character where it can be."""
    return ((line != "") & ~_starts(line)) | (F.btrim(line, F.lit(ENDS)) != "")


def _first_hash():
    return F.xxhash64("line")


def _split(docs: DataFrame, *keep, bad: DataFrame | None = None) -> DataFrame:
    """(keep, pos, fp, fp2, line) of lines that are not blank, as they are compared; ids in ``bad`` are replaced by the second hash."""
    # the outer form: else the optimizer would split once more to filter on the number of lines
    d = docs.select(*keep, F.posexplode_outer(F.split("text", "\n", -1)).alias("pos", "line"))
    # a filter on the line as it is compared would make that line once more for every row; most lines have no blank at their ends
    ends = _starts(F.col("line")) | reduce(or_, (F.col("line").endswith(c) for c in ENDS))
    d = d.where(_solid(F.col("line"))).withColumn("line", F.lower(F.when(ends, F.btrim("line", F.lit(ENDS))).otherwise(F.col("line"))))
    d = d.withColumns({"fp": _first_hash(), "fp2": F.xxhash64(F.lit(1), "line")})
    if bad is not None:
        d = d.join(checked_broadcast(bad.withColumn("_bad", F.lit(True))), "fp", "left").withColumn("fp", F.when(F.col("_bad"), F.col("fp2")).otherwise(F.col("fp"))).drop("_bad")
    return d


def buckets(lines: DataFrame, places: int, k: int = K, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Packed bands of (fp, line); a task makes the sketch of a line once."""

    def keys(batches):
        seen: set = set()
        for b in batches:
            b = b.take(pa.array(fresh(b.column("fp").to_numpy(), seen)))
            text, fp = b.column("line").to_pylist(), b.column("fp").to_numpy()
            for at in _chunks(text):
                yield fp[at], bands(sketch(*shingles([text[i] for i in at.tolist()], k), n_bands * rows), rows)

    return lines.select("fp", "line").mapInArrow(lambda batches: packs(keys(batches), places), PACKED)


def _sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles of each line."""
    values, at = shingles([t.decode("utf-8", "replace") for t in texts], k)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        x = np.sort(values[a:b])
        out.append(x[np.append(True, x[1:] != x[:-1])] if b > a else x)
    return out


def alike(k: int, percent: int):
    """Tells for lines whether 100 * intersection >= percent * union of their character shingles, as 64-bit hashes.

    Within lines of n shingles two collide with a probability under n * n / 2**65.
    """

    def run(left: list[bytes], right: list[bytes]) -> list[bool]:
        texts = list(dict.fromkeys(left + right))
        held = dict(zip(texts, _sets(texts, k), strict=True))
        out = []
        for x, y in zip(left, right, strict=True):
            a, b = held[x], held[y]
            if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                out.append(False)
                continue
            both = np.sort(np.concatenate([a, b]))
            n = int(np.count_nonzero(both[1:] == both[:-1]))
            out.append(100 * n >= percent * (len(both) - n))
        return out

    return run


def _one(at: DataFrame) -> DataFrame:
    """Of each item its first place and number of places, and the range of the second hash."""
    place = F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "pos", "h")
    return at.groupBy("fp").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.min("fp2").alias("a"), F.max("fp2").alias("b"))


def dropped(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(doc_id, h, drop): places of the lines of a document that are not kept; h tells apart documents that share an id."""
    small_batches(docs.sparkSession)
    where = ("doc_id", F.xxhash64("text").alias("h"))
    # texts are split once: the lines are staged, and what follows reads the columns it needs
    at = staged(_split(docs, *where), "zstd")
    one = staged(_one(at))
    bad = staged(one.where("a <> b").select("fp"))
    if not bad.isEmpty():  # different lines with one hash: expected from some billions of lines on
        at = staged(_split(docs, *where, bad=bad), "zstd")
        one = staged(_one(at))

    def payload(ids: DataFrame) -> DataFrame:
        seen = at.select("fp", "line").join(checked_broadcast(staged(ids)), "fp")
        return seen.groupBy("fp").agg(F.min("line").alias("line")).select("fp", F.col("line").cast("binary").alias("payload"))

    def sketches(sets: DataFrame) -> DataFrame:
        def run(batches):
            for b in batches:
                if b.num_rows:
                    text, made = [t.decode("utf-8", "replace") for t in b.column("payload").to_pylist()], np.empty((b.num_rows, BANDS * ROWS), np.uint8)
                    for at in _chunks(text):
                        made[at] = short(sketch(*shingles([text[i] for i in at.tolist()], k), BANDS * ROWS))
                    yield pa.RecordBatch.from_arrays([b.column("fp"), pa.array([r.tobytes() for r in made], pa.binary())], names=["fp", "sk"])

        return sets.select("fp", "payload").mapInArrow(run, "fp long, sk binary")

    found = link(buckets(at, places_for(at.count(), BANDS), k), payload, alike(k, percent), lambda texts: _sets(texts, k), percent, FLOOR, sketches, estimate=False)
    known = one.select("fp", "first", "n").join(checked_broadcast(found).withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    alone = known.where("component is null and n > 1").select("fp", "first")
    group = staged(known.where("component is not null").select("fp", "root", "first"))
    least = group.groupBy("root").agg(F.min("first").alias("first"))
    act = staged(alone.unionByName(group.select("fp", "root").join(checked_broadcast(staged(least)), "root").select("fp", "first")))
    out = at.join(checked_broadcast(act), "fp").where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos")) & (F.col("h") == F.col("first.h"))))
    return out.groupBy("doc_id", "h").agg(F.collect_set("pos").alias("drop"))


def deduplicated(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the kept lines as text, and n_lines and n_dropped (lines that are not blank, before and of them dropped).

    Every row stays, if need be with an empty text; a null text stays null with 0 lines. Rows that are equal
    in id and text are one document and keep the same lines. A null id comes before all others. An empty
    table gives an empty one; other columns of any name are passed on, but n_lines and n_dropped are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    d, names = private(docs.select(*kept), "doc_id", "text")
    gone = staged(dropped(docs.select("doc_id", "text"), k, percent)).select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), F.col("drop").alias("_drop"))
    places = gone.agg(F.coalesce(F.sum(F.size("_drop")), F.lit(0))).first()[0]
    side = F.broadcast(gone) if places <= 2_000_000 and gone.count() <= 500_000 else gone
    d = d.join(side, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_h")), "left")
    # places that stay by a hashed difference, so that documents of very many lines take linear time
    d = d.withColumn("_parts", F.split("text", "\n", -1)).withColumn("_stay", F.when(F.col("_drop").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), "_drop")))
    left = F.when(F.col("_drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform("_stay", lambda i: F.get("_parts", i)), "\n"))
    count = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.filter("_parts", _solid))).cast("long")
    back = [left.alias("text") if c == "text" else F.col(names[c]).alias(c) for c in kept]
    return d.select(*back, count.alias("n_lines"), F.when(F.col("_drop").isNull(), F.lit(0)).otherwise(F.size("_drop")).cast("long").alias("n_dropped"))
