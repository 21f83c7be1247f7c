"""Linking near-equal sets from their sketches: banding, exact verification, components.

Items are sets with a 64-bit id (equal sets are one item). Buckets of a band are never expanded into pairs:

1. Tasks drop items that they have seen and pack the (bucket, item) pairs of many items into binaries by place, a
   stretch of buckets; a bucket that several items of a pack share sends one pair, and its items go elsewhere
   with the least of them, so that a bucket which many items share is no hot place. One shuffle of these few
   large rows brings a place together, where pairs are sorted in memory: places are as many as keep each small.
2. Every item is compared with the least item of its bucket (or of its batch's part of the bucket). What passes on
   the full sets is joined to components.
3. In buckets that still hold different components, items of different components are compared by their
   sketches, in blocks of bounded size. Components that come near the threshold form clusters, and items of
   different components of a cluster are compared on the full sets, in pairs of blocks of a bounded number of items
   and bytes. Tasks return spanning links, never all pairs.

So each pair that shares a bucket is either in one component already or has been compared.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, components, forest, staged
from .sketch import mix

#: Items of a bucket that one task compares with each other at most; larger buckets go in pairs of blocks.
BLOCK = 256
#: Bytes of the sets in a block at most, as far as one set isn't larger.
BYTES = 32 << 20
#: The same for sketches, which are shorter.
SKETCHES = 512
#: Columns of a membership matrix that are multiplied at once.
WIDE = 8192
#: Items that a task remembers to have seen; pairs that it packs at once; most pairs of a packed row; pairs of a place.
SEEN, PACK, PIECE, PLACE = 300_000, 1_000_000, 4096, 500_000
PACKED = "place int, home binary, extra binary"


def fresh(fp: np.ndarray, seen: set) -> np.ndarray:
    """Places of the first of equal ids that are not in ``seen``, which is updated and emptied when it is full."""
    if len(seen) > SEEN:
        seen.clear()
    out = []
    for i, x in enumerate(fp.tolist()):
        if x not in seen:
            seen.add(x)
            out.append(i)
    return np.array(out, np.int64)


def _packed(key: np.ndarray, *ids: np.ndarray) -> np.ndarray:
    """Rows of bytes: the upper 48 bits of a key, which tell buckets of a place apart, and ids. Equal prefixes of different buckets only add candidates."""
    return np.concatenate([np.ascontiguousarray(key).view(np.uint8).reshape(-1, 8)[:, 2:], *(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8) for x in ids)], axis=1)


def _unpacked(data: bytes, n: int) -> list[np.ndarray]:
    """Key (lower 16 bits zero) and n ids of packed rows."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, 6 + 8 * n)
    key = np.zeros((len(rows), 8), np.uint8)
    key[:, 2:] = rows[:, :6]
    return [key.reshape(-1).view(np.uint64), *(np.ascontiguousarray(rows[:, 6 + 8 * i : 14 + 8 * i]).reshape(-1).view(np.int64) for i in range(n))]


def _place(key: np.ndarray, places: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(places) >> np.uint64(32)).astype(np.int64)


def _pieces(place: np.ndarray, rows: np.ndarray):
    """(place, bytes) of rows that are in order of places."""
    if not len(place):
        return
    cut = np.flatnonzero(np.diff(place, prepend=-1))
    for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(place)], strict=True):
        for i in range(a, z, PIECE):
            yield int(place[a]), rows[i : min(z, i + PIECE)].tobytes()


def pack(fp: np.ndarray, keys: np.ndarray, places: int) -> pa.RecordBatch:
    """Packed pairs of different items with a row of keys each."""
    k, f = keys.reshape(-1), np.repeat(fp, keys.shape[1])
    order = np.argsort(k)
    k, f = k[order], f[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    starts = np.flatnonzero(first)
    count = np.diff(np.append(starts, len(k)))
    low, many = np.minimum.reduceat(f, starts), np.repeat(count > 1, count)
    place = _place(k[starts], places)
    out = [(p, data, None) for p, data in _pieces(place, _packed(k[starts], low))]
    mk, mf, ml = k[many], f[many], np.repeat(low, count)[many]
    place = _place(mix(mk ^ mf.view(np.uint64)), places)
    order = np.argsort(place, kind="stable")
    out += [(p, None, data) for p, data in _pieces(place[order], _packed(mk[order], ml[order], mf[order]))]
    cols = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["place", "home", "extra"])


def packs(source, places: int):
    """Packed batches from an iterable of (fp, keys) of items that the task sees for the first time."""
    held, n = [], 0
    for fp, keys in source:
        if len(fp):
            held.append((fp, keys))
            n += keys.size
        if n >= PACK:
            yield pack(*(np.concatenate(x) for x in zip(*held, strict=True)), places)
            held, n = [], 0
    if held:
        yield pack(*(np.concatenate(x) for x in zip(*held, strict=True)), places)


def places_for(items: int, n_bands: int) -> int:
    """How many places hold at most about PLACE pairs each, for a number of items (repeats may be counted)."""
    return max(1, -(-items * n_bands // PLACE))


def shared(packed: DataFrame) -> DataFrame:
    """(key, low, fp): items of buckets that several items share, each with the least item it is to be compared with."""

    def settle(home: list[bytes], extra: list[bytes]) -> pa.RecordBatch:
        k, f = _unpacked(b"".join(home), 1)
        order = np.argsort(k)
        k, f = k[order], f[order]
        same = np.zeros(len(k) + 1, bool)
        same[1:-1] = k[1:] == k[:-1]
        use = same[1:] | same[:-1]
        k, f = k[use], f[use]
        order = np.lexsort((f, k))
        k, f = k[order], f[order]
        first = np.ones(len(k), bool)
        first[1:] = k[1:] != k[:-1]
        low = f[first][np.cumsum(first) - 1] if len(k) else f
        last = np.append(np.flatnonzero(first)[1:], len(k)) - 1 if len(k) else np.zeros(0, np.int64)
        several = (f[last] != f[first])[np.cumsum(first) - 1] if len(k) else first
        ek, el, ef = _unpacked(b"".join(extra), 2)
        cols = (np.concatenate([k[several].view(np.int64), ek.view(np.int64)]), np.concatenate([low[several], el]), np.concatenate([f[several], ef]))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["key", "low", "fp"])

    def run(batches):
        at, home, extra = None, [], []
        for b in batches:
            for place, x, y in zip(*(b.column(c).to_pylist() for c in ("place", "home", "extra")), strict=True):
                if place != at and at is not None:
                    yield settle(home, extra)
                    home, extra = [], []
                at = place
                if x is not None:
                    home.append(x)
                if y is not None:
                    extra.append(y)
        if at is not None:
            yield settle(home, extra)

    return packed.repartition("place").sortWithinPartitions("place").mapInArrow(run, "key long, low long, fp long").distinct()


def _estimate(pairs: DataFrame, one: DataFrame, floor: float) -> DataFrame:
    """Pairs whose short sketches, ``one`` (fp, sk), agree in at least ``floor`` of the coordinates."""
    j = pairs.join(one.select(F.col("fp").alias("u"), F.col("sk").alias("su")), "u").join(one.select(F.col("fp").alias("v"), F.col("sk").alias("sv")), "v")

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("su", "sv"))
            near = (x == y).mean(axis=1) >= floor
            yield b.select(["u", "v"]).filter(pa.array(near))

    return j.select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def _close(rows: DataFrame, floor: float) -> DataFrame:
    """Links (u, v) that span the components which may be near each other: items of both share a bucket and their sketches agree in ``floor`` of the coordinates.

    rows: key, fp, component, sk, block, other. Rows of one (key, pair of blocks) are neighbours; they are
    compared with the next one, the one after it, and so on, all groups of a batch at once.
    """
    grouped = rows.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    grouped = grouped.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "fp").select("key", "lo", "hi", "block", "component", "sk")

    def spans(t: pa.Table) -> pa.RecordBatch:
        k, lo, hi, block, comp = (t.column(c).to_numpy() for c in ("key", "lo", "hi", "block", "component"))
        sk = np.frombuffer(b"".join(t.column("sk").to_pylist()), np.uint8).reshape(len(k), -1)
        names, c = np.unique(comp, return_inverse=True)
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        starts = np.flatnonzero(new)
        ends = np.repeat(np.append(starts[1:], len(k)), np.diff(np.append(starts, len(k))))
        label, i, lag = np.arange(len(names)), np.arange(len(k)), 1
        while len(i := i[i + lag < ends[i]]):
            for part in np.array_split(i, len(i) // 20_000 + 1):
                j = part + lag
                ask = (label[c[part]] != label[c[j]]) & ((lo[part] == hi[part]) | (block[part] != block[j]))
                x, y = part[ask], j[ask]
                near = (sk[x] == sk[y]).mean(axis=1) >= floor if len(x) else np.zeros(0, bool)
                if near.any():
                    label = forest(len(names), np.concatenate([np.arange(len(names)), c[x[near]]]), np.concatenate([label, c[y[near]]]))
            lag += 1
        child = np.flatnonzero(label != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[child], pa.int64()), pa.array(names[label[child]], pa.int64())], names=["u", "v"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) < 4 * SKETCHES:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            k, lo, hi = (t.column(c).to_numpy() for c in ("key", "lo", "hi"))
            last = int(np.flatnonzero((k != k[-1]) | (lo != lo[-1]) | (hi != hi[-1])).max(initial=-1)) + 1  # the last group may go on
            if last:
                yield spans(t.slice(0, last))
            held = t.slice(last).combine_chunks().to_batches()
        if held:
            yield spans(pa.Table.from_batches(held))

    return grouped.mapInArrow(run, "u long, v long")


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether each two of some sets have 100 * intersection >= percent * union, from exact counts by matrix products."""
    n = np.array([len(x) for x in sets], np.int64)
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    rank = np.cumsum(times > 1) - 1  # values that one set alone has are in no intersection
    use = times[column] > 1
    row, at = row[use], rank[column[use]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    both = np.zeros((len(sets), len(sets)), np.float64)
    for lo in range(0, int(rank[-1]) + 1 if len(rank) else 0, WIDE):
        a, b = np.searchsorted(at, [lo, lo + WIDE])
        x = np.zeros((len(sets), WIDE), np.float32)
        x[row[a:b], at[a:b] - lo] = 1
        both += x @ x.T
    return 100 * both >= percent * (n[:, None] + n[None, :] - both)


def _tiles(members: DataFrame, sets: DataFrame, sets_of: Callable[[list], list], percent: int) -> DataFrame:
    """Spanning links (u, v) between items of different components of a cluster, decided on the full sets.

    members: cluster, component, fp, bytes. Items are dealt into blocks; a large component has blocks of its own,
    which need no comparison with each other, so that work grows with what isn't linked yet.
    """
    members = members.withColumn("load", F.lit(1.0 / BLOCK) + F.col("bytes") / F.lit(float(BYTES)))
    c = members.groupBy("cluster", "component").agg(F.sum("load").alias("n"))
    few = c.where(F.col("n") < 1).groupBy("cluster").agg(F.sum("n").alias("few"))
    m = members.join(c, ["cluster", "component"]).join(few, "cluster", "left")
    share = lambda col, n: F.pmod(F.xxhash64(col), F.ceil(n).cast("long"))
    big = F.col("n") >= 1
    m = staged(m.select("cluster", "component", "fp", F.when(big, F.col("component")).alias("own"), F.when(big, F.xxhash64("component", share("fp", F.col("n")))).otherwise(share("component", F.col("few"))).alias("block")))
    b = staged(m.select("cluster", "block", "own").distinct())
    x, y = b.alias("x"), b.alias("y")
    pairs = x.join(y, (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.block") <= F.col("y.block")) & ~F.coalesce(F.col("x.own") == F.col("y.own"), F.lit(False)))
    pairs = pairs.select("x.cluster", F.explode(F.array_distinct(F.array("x.block", "y.block"))).alias("block"), F.xxhash64("x.cluster", "x.block", "y.block").alias("pair"))
    rows = m.join(pairs, ["cluster", "block"]).join(sets, "fp").select("pair", "fp", "component", "payload")

    def run(t: pa.Table) -> pa.Table:
        fp, comp = t.column("fp").to_numpy(), t.column("component").to_numpy()
        near = linked(sets_of(t.column("payload").to_pylist()), percent) & (comp[:, None] != comp[None, :])
        label = forest(len(fp), *np.nonzero(near))
        child = np.flatnonzero(label != np.arange(len(fp)))
        return pa.table({"u": pa.array(fp[child], pa.int64()), "v": pa.array(fp[label[child]], pa.int64())})

    return rows.groupBy("pair").applyInArrow(run, "u long, v long")


def _verified(pairs: DataFrame, sets: DataFrame, alike: Callable[[list, list], list]) -> DataFrame:
    """Pairs that pass on the full sets (fp, payload)."""
    j = pairs.join(sets.select(F.col("fp").alias("u"), F.col("payload").alias("pu")), "u").join(sets.select(F.col("fp").alias("v"), F.col("payload").alias("pv")), "v")

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield b.select(["u", "v"]).filter(pa.array(alike(b.column("pu").to_pylist(), b.column("pv").to_pylist()), pa.bool_()))

    return j.select("u", "v", "pu", "pv").mapInArrow(run, "u long, v long")


def link(rows: DataFrame, payload: Callable[[DataFrame], DataFrame], alike: Callable[[list, list], list], sets_of: Callable[[list], list], percent: int, floor: float, sketches: Callable[[DataFrame], DataFrame], estimate: bool) -> DataFrame:
    """Components of near-equal items: (id, component), for items that have a link.

    rows: what ``packs`` makes. payload(ids) gives (fp, payload binary), one row a given fp, and is called
    once, for the items of shared buckets. sketches(payloads) gives (fp, sk binary) for (a part of) that table.
    alike(list, list) tells for payloads of pairs whether they are linked; sets_of(list) gives the payloads' sets
    as numbers, for the same rule by ``percent``. floor: agreement of sketches under which a pair isn't verified;
    far enough below the threshold that a linked pair comes under it with a probability below one in a million.
    estimate: whether sketches are compared before sets in the second step too, for sets that are large.
    """
    members = staged(shared(rows))
    stars = staged(members.where("fp <> low").select(F.col("low").alias("u"), F.col("fp").alias("v")).distinct())
    sk = None
    if estimate:
        sk = staged(sketches(members.select("fp").distinct()))
        stars = staged(_estimate(stars, sk, floor))
        wanted = stars.select(F.explode(F.array("u", "v")).alias("fp")).distinct()
        first = staged(_verified(stars, staged(payload(wanted)), alike))
    else:
        pool = staged(payload(members.select("fp").distinct()))
        first = staged(_verified(stars, pool, alike))
    found = components(first)
    c = members.select("key", "fp").distinct().join(checked_broadcast(found).withColumnRenamed("id", "fp"), "fp", "left").select("key", "fp", F.coalesce("component", "fp").alias("component"))
    c = staged(c)
    mixed = c.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n")).where("a < b and n > 2").select("key", "n")
    blocks = F.ceil(F.col("n") / SKETCHES).cast("int")
    open_ = staged(c.join(checked_broadcast(staged(mixed)), "key"))
    if open_.isEmpty():
        return found
    ids = open_.select("fp").distinct()
    one = sk.join(ids, "fp", "left_semi") if estimate else sketches(pool.join(ids, "fp", "left_semi"))
    dealt = open_.join(one, "fp").withColumn("block", F.pmod(F.xxhash64("fp"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    clusters = components(_close(dealt, floor)).select(F.col("id").alias("component"), F.col("component").alias("cluster"))
    near = staged(open_.select("component", "fp").distinct().join(checked_broadcast(clusters), "component").select("cluster", "component", "fp"))
    if near.isEmpty():
        return found
    sets = staged(payload(near.select("fp").distinct())) if estimate else pool.join(near.select("fp").distinct(), "fp", "left_semi")
    near = near.join(sets.select("fp", F.octet_length("payload").alias("bytes")), "fp")
    second = staged(_tiles(near, sets, sets_of, percent))
    return components(first.union(second))
