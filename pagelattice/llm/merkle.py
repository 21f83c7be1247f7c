"""A Merkle manifest of a table: leaves by row, trees by language, authentication paths by fractal traversal.

Leaves are put in order by a range shuffle (a hot language is many ranges; equal rows are dealt among them) and cut
into aligned blocks of ``2 ** BITS``. A first pass takes every block to its root; the trees above are built the
same way, block by block of block roots, in as many rounds as the blocks' bits fit the count. A second pass walks each
block by fractal traversal: stacked subtrees of ``STEP`` levels exist, the one that follows on each floor is built a
leaf at a time while paths are read from the present ones, and the path above the block is appended to each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checked_broadcast, staged

#: Levels of a block, levels of a stacked subtree, rows of a range when leaves are put in order.
BITS, STEP, RANGE = 12, 4, 1 << 15
#: Columns of a row that its leaf is made of, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts: bytes) -> bytes:
    """SHA-256 of the inputs one after the other, as lower-case hexadecimal text."""
    return sha256(b"".join(parts)).hexdigest().encode()


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value; integers in decimal."""
    s = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, lang, leaf, and the leaf that the row has after tampering (null where ``tampered`` isn't true): n_chars is one more."""
    leaf = lambda **new: F.unhex(F.sha2(F.concat(*(field(new.get(c, F.col(c))) for c in FIELDS)), 256))
    return docs.select("doc_id", "lang", leaf().alias("leaf"), F.when(tampered, leaf(n_chars=F.col("n_chars") + 1)).alias("other"))


def placed(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` (staged) with i, the place of a row in its group from 0, and n, the rows of the group. Nulls come first.

    Rows that are equal in ``order`` keep the order of the table's files. No group is one task's: rows are put in order by
    range, and only the counts of each range and group meet.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    s = df.withColumn("salt", F.monotonically_increasing_id())
    s = s.repartitionByRange(max(1, -(-df.count() // RANGE)), *keys, F.col("salt").asc()).sortWithinPartitions(*keys, "salt").drop("salt")
    s = staged(s.withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.shiftright("at", 33)))
    runs = s.groupBy("range", *group).agg(F.min("at").alias("first"), F.count("*").alias("m"))
    over = W.partitionBy(*group)
    runs = runs.withColumns({"n": F.sum("m").over(over), "before": F.coalesce(F.sum("m").over(over.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    runs = checked_broadcast(staged(runs.select(F.col("range").alias("r"), *(F.col(c).alias(f"g_{c}") for c in group), (F.col("before") - F.col("first")).alias("shift"), "n")))
    same = F.col("range") == F.col("r")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"g_{c}"))
    return s.join(runs, same).select(*df.columns, (F.col("at") + F.col("shift")).alias("i"), "n")


def height(n: int) -> int:
    """Levels that n nodes need until one remains."""
    return max(0, n - 1).bit_length()


class Subtree:
    """Nodes of the levels ``low`` to ``high`` - 1 under the node ``root`` of level ``high``, built a leaf at a time."""

    def __init__(self, leaf: Callable[[int], bytes | None], low: int, high: int, root: int):
        self.leaf, self.low, self.high, self.next, self.end = leaf, low, high, root << high, (root + 1) << high
        self.stack: list[tuple[int, bytes | None]] = []
        self.nodes: dict[tuple[int, int], bytes] = {}

    def advance(self) -> None:
        """Take in one leaf and join what it completes; leaves past the last one are absent, and so are nodes over them."""
        level, at, node = 0, self.next, self.leaf(self.next)
        self.next += 1
        while True:
            if node is not None and self.low <= level < self.high:
                self.nodes[level, at] = node
            if not (self.stack and self.stack[-1][0] == level):
                break
            left = self.stack.pop()[1]
            node = left if left is None else h(left, node or b"")
            level, at = level + 1, at >> 1
        self.stack.append((level, node))

    def whole(self) -> Subtree:
        while self.next < self.end:
            self.advance()
        return self

    def top(self) -> bytes | None:
        return self.stack[0][1]


def root_of(leaf: list[bytes], levels: int) -> bytes:
    """Root of a block after so many levels, by a stack of at most one node a level."""
    return Subtree(lambda j: leaf[j] if j < len(leaf) else None, 0, levels, 0).whole().top()


def paths(leaf: list[bytes], levels: int, step: int = STEP) -> Iterator[list[bytes | None]]:
    """Siblings of every leaf of a block from below, None where it has none, by fractal traversal.

    Held at a time: a subtree of ``step`` levels on each floor, the nodes so far of its right neighbour on each floor but the
    top one, and that one's stack. Every neighbour takes in a leaf for each path that is read, and so is whole when it's needed.
    """
    get = lambda j: leaf[j] if j < len(leaf) else None
    floors = [(low, min(low + step, levels)) for low in range(0, levels, step)]
    exist = [Subtree(get, low, high, 0).whole().nodes for low, high in floors]
    desired = [Subtree(get, low, high, 1) for low, high in floors[:-1]]
    for j in range(len(leaf)):
        yield [exist[level // step].get((level, (j >> level) ^ 1)) for level in range(levels)]
        for f, (low, high) in enumerate(floors[:-1]):
            d = desired[f]
            if d.end - (1 << high) < len(leaf):
                d.advance()
                if d.next == d.end:
                    exist[f], desired[f] = d.nodes, Subtree(get, low, high, d.end >> high)


def fold(leaf: bytes, i: int, siblings: list[bytes | None]) -> bytes:
    """The root that a leaf at place i leads to."""
    for s in siblings:
        leaf = h(s, leaf) if i & 1 and s else h(leaf, s or b"")
        i >>= 1
    return leaf


def _levels(n: int, bits: int) -> int:
    """Levels of a block of a tree of n nodes: all if it's the only one, else ``bits``, however few of its nodes are there."""
    return min(height(n), bits)


def _hex(packed: bytes) -> list[bytes]:
    return [packed[k : k + 32].hex().encode() for k in range(0, len(packed), 32)]


def _block_paths(nodes: DataFrame, bits: int) -> DataFrame:
    """Of nodes (g, i, node, n): g, i, n, root of the node's block, and the node's path in it ('' for no sibling)."""
    kind = dict(nodes.dtypes)["g"]

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by("i")
        leaf = [x.encode() for x in t.column("node").to_pylist()]
        levels = _levels(t.column("n")[0].as_py(), bits)
        root = root_of(leaf, levels).decode()
        up = [[(s or b"").decode() for s in p] for p in paths(leaf, levels)]
        return pa.table([t.column("g"), t.column("i"), t.column("n"), pa.array([root] * len(leaf)), pa.array(up, pa.list_(pa.string()))], names=["g", "i", "n", "root", "path"])

    return nodes.groupBy("g", F.shiftright("i", bits).alias("b")).applyInArrow(run, f"g {kind}, i long, n long, root string, path array<string>")


def tree(nodes: DataFrame, bits: int) -> DataFrame:
    """Of nodes (g, i, node, n; staged): g, i, path up to the root of g's tree, and root. A round for every ``bits`` levels."""
    low = staged(_block_paths(nodes, bits))
    most = low.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    if most <= 1 << bits:
        return low.select("g", "i", "path", "root")
    blocks = low.groupBy("g", F.shiftright("i", bits).alias("i")).agg(F.first("root").alias("node"), F.first("n").alias("n"))
    up = tree(staged(blocks.select("g", "i", "node", F.ceil(F.col("n") / (1 << bits)).cast("long").alias("n"))), bits)
    up = up.select(F.col("g").alias("ug"), F.col("i").alias("ui"), F.col("path").alias("upper"), F.col("root").alias("top"))
    j = low.join(up, F.col("g").eqNullSafe(F.col("ug")) & (F.shiftright("i", bits) == F.col("ui")))
    return staged(j.select("g", "i", F.concat("path", "upper").alias("path"), F.col("top").alias("root")))


def _packed(rows: DataFrame, bits: int) -> DataFrame:
    """A row a block: lang, b, n, its ids in order, leaves and tampered leaves as 32 bytes each (no tampering: 32 zero bytes), and root."""
    kinds = dict(rows.dtypes)
    void = bytes(32)

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by("i")
        leaf = b"".join(t.column("leaf").to_pylist())
        n, first = t.column("n")[0].as_py(), t.column("i")[0].as_py()
        ids = pa.array([t.column("doc_id").to_pylist()], pa.list_(t.schema.field("doc_id").type))
        other = b"".join(x or void for x in t.column("other").to_pylist())
        root = root_of(_hex(leaf), _levels(n, bits)).decode()
        cols = [t.column("lang").slice(0, 1), pa.array([first >> bits]), pa.array([n]), ids, pa.array([leaf]), pa.array([other]), pa.array([root])]
        return pa.table(cols, names=["lang", "b", "n", "ids", "leaves", "others", "root"])

    return rows.groupBy("lang", F.shiftright("i", bits).alias("b")).applyInArrow(run, f"lang {kinds['lang']}, b long, n long, ids array<{kinds['doc_id']}>, leaves binary, others binary, root string")


def proved(docs: DataFrame, tampered: Column, bits: int = BITS, with_paths: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row; siblings by level (null for none) if asked for.

    Of the fields, null is ``-``; null languages are a tree of their own, the first one; a null id comes first in its tree. Rows with one
    id are in the order of their leaves, and rows that are equal are leaves of their own. An empty table gives no rows.
    Columns other than FIELDS aren't read.
    """
    rows = placed(staged(leaves(docs.select(*FIELDS), tampered)), ["lang"], ["doc_id", "leaf"])
    blocks = staged(_packed(rows, bits))
    nodes = staged(blocks.select(F.col("lang").alias("g"), F.col("b").alias("i"), F.col("root").alias("node"), F.ceil(F.col("n") / (1 << bits)).cast("long").alias("n")))
    within = staged(tree(nodes, bits))
    trees = staged(within.where("i = 0").select(F.col("g").alias("lang"), F.col("root").alias("node")))
    langs = staged(placed(trees, [], ["lang"]).select(F.lit(0).alias("g"), "lang", "i", "node", "n"))
    top = tree(staged(langs.drop("lang")), bits).select(F.col("i").alias("ti"), F.col("path").alias("tp"), F.col("root").alias("tr"))
    over = staged(langs.join(top, F.col("i") == F.col("ti")).select(F.col("lang").alias("tl"), F.col("i").alias("at"), "tp", "tr"))
    up = within.join(over, F.col("g").eqNullSafe(F.col("tl"))).select("g", "i", F.col("path").alias("mid"), F.col("root").alias("subroot"), "at", "tp", "tr")
    whole = blocks.join(up, F.col("lang").eqNullSafe(F.col("g")) & (F.col("b") == F.col("i")))
    return _emitted(whole.select("ids", "leaves", "others", "b", "n", "mid", "subroot", "at", "tp", "tr"), bits, dict(rows.dtypes)["doc_id"], with_paths)


def _emitted(blocks: DataFrame, bits: int, kind: str, with_paths: bool) -> DataFrame:
    void = bytes(32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for k, r in enumerate(batch.drop_columns(["ids"]).to_pylist()):
                leaf, levels = _hex(r["leaves"]), _levels(r["n"], bits)
                mid, top = ([x.encode() or None for x in r[c]] for c in ("mid", "tp"))
                root, rows = r["tr"].encode(), []
                for j, path in enumerate(paths(leaf, levels)):
                    one = r["others"][32 * j : 32 * j + 32]
                    start = leaf[j] if one == void else one.hex().encode()
                    got = fold(fold(fold(start, j, path), r["b"], mid), r["at"], top)
                    siblings = path + mid + top
                    rows.append((leaf[j].decode(), h(*filter(None, siblings)).decode(), got.decode(), got == root, [s and s.decode() for s in siblings] if with_paths else None))
                cols = list(zip(*rows, strict=True))
                out = [ids[k].values, pa.array(cols[0]), pa.array([r["subroot"]] * len(rows)), pa.array([r["tr"]] * len(rows)), *map(pa.array, cols[1:4])]
                yield pa.RecordBatch.from_arrays([*out, pa.array(cols[4], pa.list_(pa.string()))][: 7 + with_paths], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "siblings"][: 7 + with_paths])

    return blocks.mapInArrow(run, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", siblings array<string>" * with_paths)


def tampered(doc_id: Column) -> Column:
    """Rows that the check tampers with: those whose id's checksum 7 divides; null ids aren't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE concat(octet_length(encode({0}::VARCHAR)), ':', {0}::VARCHAR) END"
_LEAF = "sha256(concat(" + ", ".join(_FIELD.format(c) for c in FIELDS) + "))"
_OTHER = "sha256(concat(" + ", ".join(_FIELD.format("(n_chars + 1)" if c == "n_chars" else c) for c in FIELDS) + "))"

ORACLE = f"""
WITH RECURSIVE byte AS (SELECT list(list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY k) AS t FROM range(256) r(k)),
crc AS (SELECT doc_id AS crc_id, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS crc
        FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), byte),
l AS (SELECT doc_id, lang, {_LEAF} AS leaf, CASE WHEN crc % 7 = 0 THEN {_OTHER} ELSE {_LEAF} END AS other FROM documents d LEFT JOIN crc ON doc_id = crc_id),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM l),
up AS (SELECT 0 AS level, lang, i, leaf AS node, n FROM p
       UNION ALL SELECT level + 1, lang, i // 2, sha256(string_agg(node, '' ORDER BY i)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY level, lang, i // 2, n),
sub AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS level, i, subroot AS node, n FROM sub
        UNION ALL SELECT level + 1, i // 2, sha256(string_agg(node, '' ORDER BY i)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY level, i // 2, n),
walk AS (SELECT doc_id, lang, leaf, i AS place, 0 AS level, i, n, other AS folded, '' AS proof FROM p
         UNION ALL SELECT w.doc_id, w.lang, w.leaf, w.place, w.level + 1, w.i // 2, (w.n + 1) // 2, sha256(CASE WHEN w.i % 2 = 1 THEN concat(s.node, folded) ELSE concat(folded, s.node) END), concat(proof, s.node)
         FROM walk w LEFT JOIN up s ON s.level = w.level AND s.lang IS NOT DISTINCT FROM w.lang AND s.i = xor(w.i, 1) WHERE w.n > 1),
walk2 AS (SELECT w.doc_id, w.lang, w.leaf, w.place, 0 AS level, s.i, s.n, folded, proof, subroot FROM walk w JOIN sub s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
          UNION ALL SELECT w.doc_id, w.lang, w.leaf, w.place, w.level + 1, w.i // 2, (w.n + 1) // 2, sha256(CASE WHEN w.i % 2 = 1 THEN concat(s.node, folded) ELSE concat(folded, s.node) END), concat(proof, s.node), subroot
          FROM walk2 w LEFT JOIN top s ON s.level = w.level AND s.i = xor(w.i, 1) WHERE w.n > 1)
SELECT doc_id, leaf, subroot, (SELECT node FROM top WHERE n = 1) AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = (SELECT node FROM top WHERE n = 1) AS verified FROM walk2 WHERE n = 1
"""
