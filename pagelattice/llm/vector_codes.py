"""Product codes of vectors: every part gets the index of its codebook's nearest entry; codebooks are trained by filtering Lloyd.

Every task cuts its rows into blocks of bounded bytes and builds a kd-tree over each part of a block once: bounding boxes, counts and sums of
all nodes are kept. A round walks the trees from the top with the codebook's entries as candidates: an entry that is farther than
another one from the whole box is dropped for the node and all below, and a node with one entry left is assigned
at once by its cached sum and count. Only points of the lowest nodes that several entries still claim are compared one by one.
Rounds send on sums and counts by entry, which the codebook's size bounds; no row leaves its task before the result.

All arithmetic is on integers, so results don't depend on how rows are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, private, small_batches, staged

#: Parts of a vector, entries of a codebook, rounds of training, integer steps of 1.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Bytes of a block's components as 32-bit integers, most rows of a block, and points of a lowest node at most.
BLOCK_BYTES, BLOCK_ROWS, LEAF = 2 << 20, 1 << 13, 16
#: Components of this size and beyond can't be coded: squared distances of parts of up to 64 components would leave 64 bits.
LIMIT = float(1 << 18)


def usable(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """vec_id, label, embedding of rows that can be coded.

    Rows go whose vector is null or has null or non-finite components, or components of LIMIT and more; and those of another length than the row with the
    least vec_id (nulls last) that has a length of a multiple of ``parts``.
    """
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT)
    v = vectors.select("vec_id", "label", "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0) & F.forall("embedding", fine))
    first = v.orderBy(F.col("vec_id").asc_nulls_last(), F.size("embedding")).select(F.size("embedding")).first()
    return v.where(F.size("embedding") == (first[0] if first else 0))


def integers(embedding: pa.ListArray, dim: int) -> np.ndarray:
    flat = embedding.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(-1, dim)


class Tree:
    """A kd-tree over points of one part: a complete binary tree in level order, as arrays.

    order: points by lowest node; edge: first place of each node of each level; per node the box, the sum and the count.
    """

    def __init__(self, x: np.ndarray):
        n = len(x)
        self.depth = max(0, int(np.ceil(np.log2(max(1, n / LEAF)))))
        order = np.arange(n)
        self.lo, self.hi, self.sums, self.edges = [], [], [], []
        for level in range(self.depth + 1):
            edges = np.arange((1 << level) + 1, dtype=np.int64) * n >> level
            at, p = edges[:-1], x[order]
            lo, hi = np.minimum.reduceat(p, at), np.maximum.reduceat(p, at)
            self.edges.append(edges)
            self.lo.append(lo)
            self.hi.append(hi)
            self.sums.append(np.add.reduceat(p, at))
            if level < self.depth:
                # halves at the median of the widest side; places of halves follow from the edges alone
                node = np.repeat(np.arange(1 << level), np.diff(edges))
                order = order[np.lexsort((p[np.arange(n), (hi - lo).argmax(axis=1)[node]], node))]
        self.order = order

    def filtered(self, x: np.ndarray, book: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first places, ends, sums, entries) of what is assigned: whole nodes level by level, then single points.

        An entry z is dropped where another one, the nearest to the box's middle, is nearer to the corner that suits z best, or as
        near with a lower index: then it is so for every point in the box.
        """
        k, d = book.shape
        nodes, alive = np.zeros(1, np.int64), np.ones((1, k), bool)
        index = np.arange(k)
        for level in range(self.depth + 1):
            lo, hi = self.lo[level][nodes], self.hi[level][nodes]
            # distances from twice the middle to twice the entry stay integers
            middle = np.zeros((len(nodes), k), np.int64)
            for c in range(d):
                middle += (lo[:, c, None] + hi[:, c, None] - 2 * book[:, c]) ** 2
            middle[~alive] = np.iinfo(np.int64).max
            best = middle.argmin(axis=1)
            z = book[best]
            more = np.zeros((len(nodes), k), np.int64)  # distance of the entry less that of the nearest one, at the corner that suits it best
            for c in range(d):
                corner = np.where(book[:, c] > z[:, c, None], hi[:, c, None], lo[:, c, None])
                more += (corner - book[:, c]) ** 2 - (corner - z[:, c, None]) ** 2
            alive &= (more < 0) | ((more == 0) & (index <= best[:, None]))
            one = alive.sum(axis=1) == 1
            edges = self.edges[level]
            if one.any():
                done = nodes[one]
                yield edges[done], edges[done + 1], self.sums[level][done], alive[one].argmax(axis=1)
            nodes, alive = nodes[~one], alive[~one]
            if not len(nodes):
                return
            if level < self.depth:
                nodes = np.stack([2 * nodes, 2 * nodes + 1], axis=1).ravel()
                alive = np.repeat(alive, 2, axis=0)
        edges = self.edges[self.depth]
        size = edges[nodes + 1] - edges[nodes]
        at = np.repeat(edges[nodes] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        p, mine = x[self.order[at]], np.repeat(alive, size, axis=0)
        away = np.zeros(mine.shape, np.int64)
        for c in range(d):
            away += (p[:, c, None] - book[:, c]) ** 2
        away[~mine] = np.iinfo(np.int64).max
        yield at, at + 1, p, away.argmin(axis=1)


def _pack(trees: list[Tree]) -> bytes:
    """The trees of a block: orders as 32-bit integers, then boxes and sums of all levels as 64-bit ones."""
    return b"".join(t.order.astype("<u4").tobytes() for t in trees) + b"".join(np.concatenate([*t.lo, *t.hi, *t.sums]).astype("<i8").tobytes() for t in trees)


def _unpack(data: bytes, n: int, parts: int, d: int) -> list[Tree]:
    orders = np.frombuffer(data, "<u4", n * parts).reshape(parts, n)
    depth = max(0, int(np.ceil(np.log2(max(1, n / LEAF)))))
    nodes = (2 << depth) - 1
    kept = np.frombuffer(data, "<i8", offset=4 * n * parts).reshape(parts, 3, nodes, d) if n else np.zeros((parts, 3, nodes, d), np.int64)
    out = []
    for order, (lo, hi, sums) in zip(orders, kept, strict=True):
        t = Tree.__new__(Tree)
        t.depth, t.order = depth, order.astype(np.int64)
        cut = lambda a: np.split(a, np.cumsum([1 << level for level in range(depth)]))
        t.lo, t.hi, t.sums = cut(lo), cut(hi), cut(sums)
        t.edges = [np.arange((1 << level) + 1, dtype=np.int64) * n >> level for level in range(depth + 1)]
        out.append(t)
    return out


def blocks(vectors: DataFrame, dim: int, parts: int = PARTS) -> DataFrame:
    """A row a block: ids, labels, points (little-endian 32-bit integers, row by row) and trees. Nothing is shuffled."""
    small_batches(vectors.sparkSession)
    kinds = dict(vectors.dtypes)
    most = max(64, min(BLOCK_ROWS, BLOCK_BYTES // (4 * dim)))

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        x = integers(t.column("embedding").chunk(0), dim)
        trees = _pack([Tree(part) for part in np.split(x, parts, axis=1)])
        one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), t.column(c).chunk(0))
        return pa.RecordBatch.from_arrays([one("vec_id"), one("label"), pa.array([x.astype("<i4").tobytes()]), pa.array([trees])], names=["ids", "labels", "points", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            while b.num_rows:
                held.append(b.slice(0, most - rows))
                rows += held[-1].num_rows
                b = b.slice(held[-1].num_rows)
                if rows == most:
                    yield block(held)
                    held, rows = [], 0
        if rows:
            yield block(held)

    return vectors.mapInArrow(run, f"ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, points binary, trees binary")


def _points(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i4").astype(np.int64).reshape(-1, dim)


def moved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: every entry is the floor of its parts' mean; unused entries stay."""
    parts, _, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(books.shape, np.int64)
        count = np.zeros(books.shape[:2], np.int64)
        for b in batches:
            for points, packed in zip(*(b.column(c).to_pylist() for c in ("points", "trees")), strict=True):
                x = _points(points, parts * d)
                for p, tree in enumerate(_unpack(packed, len(x), parts, d)):
                    for begin, end, sums, entry in tree.filtered(x[:, p * d : p * d + d], books[p]):
                        np.add.at(total[p], entry, sums)
                        np.add.at(count[p], entry, end - begin)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    sent = blocks.select("points", "trees").mapInArrow(run, "part long, entry long, n long, sums array<long>")
    rows = sent.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(c))).alias(f"s{c}") for c in range(d))).collect()  # at most an entry's row each
    out = books.copy()
    for r in rows:
        out[r["part"], r["entry"]] = [r[f"s{c}"] // r["n"] for c in range(d)]
    return out


def codebooks(vectors: DataFrame, blocked: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) after ``rounds`` rounds from the parts of the ``entries`` rows with least vec_id (nulls last, ties by vector)."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    x = np.floor(np.array([list(r[0]) for r in first], np.float64) * SCALE).astype(np.int64)
    books = np.ascontiguousarray(x.reshape(len(x), parts, dim // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        books = moved(blocked, books)
    return books


def coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (a byte a part) and error of every row of the blocks."""
    parts, _, d = books.shape
    id_kind, label_kind = (dict(blocks.dtypes)[c].removeprefix("array<").removesuffix(">") for c in ("ids", "labels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (points, packed) in enumerate(zip(*(b.column(c).to_pylist() for c in ("points", "trees")), strict=True)):
                x = _points(points, parts * d)
                code, error = np.zeros((len(x), parts), np.int64), np.zeros(len(x), np.int64)
                for p, tree in enumerate(_unpack(packed, len(x), parts, d)):
                    own = x[:, p * d : p * d + d]
                    for begin, end, _, entry in tree.filtered(own, books[p]):
                        size = end - begin
                        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
                        code[tree.order[at], p] = np.repeat(entry, size)
                    error += ((own - books[p][code[:, p]]) ** 2).sum(axis=1)
                raw = code.astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays([b.column("ids")[k].values, b.column("labels")[k].values, pa.array([raw[i : i + parts] for i in range(0, len(raw), parts)], pa.binary()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"vec_id {id_kind}, label {label_kind}, code binary, error long")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, with commas between."""
    return sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every row that can be coded, and the codebooks.

    Repeated rows and ids are rows of their own; fewer rows than entries make shorter codebooks; an empty table gives no rows.
    Vectors need ``entries`` of at most 256. Other columns aren't read.
    """
    v = usable(vectors, parts)
    dim = len((v.select("embedding").first() or [()])[0])
    if not dim:
        return v.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    b = staged(blocks(v, dim, parts))
    books = codebooks(v, b, dim, parts, entries, rounds)
    return coded(b, books), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """The codes with label_error, the sum of errors of equal labels (nulls are equal). Sums are made before the shuffle."""
    c = staged(codes)
    sums = checked_broadcast(staged(c.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "l")))
    return c.join(sums, F.col("label").eqNullSafe(F.col("l"))).drop("l")


_N, _D = PARTS, "len(x) // 16"

ORACLE = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, part, x[part * ({_D}) + 1 : (part + 1) * ({_D})] AS y FROM v, range({_N}) r(part)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v QUALIFY e < 64),
b0 AS (SELECT part, e, y AS z FROM p JOIN first USING (vec_id)),
""" + "".join(
    f"""
a{r} AS (SELECT vec_id, label, p.part, arg_min(e, (dist, e)) AS e, min(dist) AS dist, first(y) AS y FROM (SELECT p.*, e, list_sum(list_transform(list_zip(y, z), lambda q: (q[1] - q[2]) * (q[1] - q[2])))::BIGINT AS dist FROM p JOIN b{r} b ON p.part = b.part) p GROUP BY vec_id, label, p.part),
"""
    + (
        f"""
m{r} AS (SELECT part, e, list(z ORDER BY i) AS z FROM (SELECT part, e, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS z FROM (SELECT part, e, i, sum(c)::BIGINT AS s, count(*) AS n FROM (SELECT part, e, unnest(y) AS c, unnest(range(len(y))) AS i FROM a{r}) GROUP BY part, e, i)) GROUP BY part, e),
b{r + 1} AS (SELECT part, e, coalesce(m.z, b.z) AS z FROM b{r} b LEFT JOIN m{r} m USING (part, e)),
"""
        if r < ROUNDS
        else ""
    )
    for r in range(ROUNDS + 1)
) + f"""
c AS (SELECT vec_id, label, string_agg(format('{{:02x}}', e), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id, label),
s AS (SELECT sha256(string_agg(t, ',' ORDER BY part, e)) AS h FROM (SELECT part, e, array_to_string(z, ',') AS t FROM b{ROUNDS}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM c, s
"""
