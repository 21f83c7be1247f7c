"""Token ids of documents in raw binary shards, in ascending order of ids of documents, with a minimal perfect hash index for keyed reads.

A range shuffle puts the texts in order; every task encodes its range and writes shards under names of its own attempt. A shard is
MAGIC, the ids of its documents one after the other (little-endian, 16 bits where the vocabulary allows, else 32), the documents' bounds, and their number.

The index is dealt by hash to buckets of about KEYS keys. A bucket has a minimal perfect hash function: levels of bits, where a key sits at the
first level at which no other remaining key meets it; the number of bits set before is its slot. Slots have a
fingerprint of 32 bits (a key that isn't there passes with a probability of 2^-32) and the places of the key's documents: shard, first
ordinal, number. So a keyed read is a constant number of probes, one read of bounds and one of ids.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checked_broadcast, scratch, small_batches, staged
from .sketch import mix

MAGIC = b"PLIDS001"
#: Keys of a bucket on average; bits of a level for each key that is left; bytes of ids after which a shard ends, that one read fetches, and that a reading task gets.
KEYS, GAMMA, SHARD, READ, TASK = 1 << 10, 2, 1 << 30, 8 << 20, 16 << 20
#: Bytes of text that are encoded together: stretches between blanks are encoded once for all their places in it.
#: A worker keeps so many stretches that occurred more than once, and forgets all when more come.
TOGETHER, KNOWN = 8 << 20, 300_000
_LOADED: dict[str, Encoder] = {}


class Encoder:
    """The tokenizers library over many texts at once: each distinct stretch between single blanks is encoded once.

    The pre-tokenizer of a byte-level vocabulary starts a new piece at a blank between two characters that are no white space, so a text
    may be cut before such blanks. A text in which a blank touches other white space, or an end of the text, goes to the library whole.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_str(spec)
        self.model.no_truncation()
        self.model.no_padding()
        loaded = json.loads(spec)
        sizes = {i: len(t) for t, i in loaded["model"]["vocab"].items()} | {t["id"]: len(t["content"].encode()) for t in loaded.get("added_tokens", [])}
        self.bytes = np.zeros(max(sizes) + 1, np.int64)
        self.bytes[list(sizes)] = list(sizes.values())
        self.width = 2 if len(self.bytes) <= 1 << 16 else 4
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _keep(self, parts: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        if len(self.known) + len(parts) > KNOWN:
            self._forget()
        self.known.update(zip(parts, range(len(self.size), len(self.size) + len(parts)), strict=True))
        self.pool, self.size = np.concatenate([self.pool, ids.astype(np.int32)]), np.concatenate([self.size, sizes])

    @staticmethod
    def of(spec: str) -> Encoder:
        """One for a worker, kept from task to task."""
        key = f"{len(spec)}-{zlib.crc32(spec.encode())}"
        if key not in _LOADED:
            _LOADED[key] = Encoder(spec)
        return _LOADED[key]

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and each one's number of ids, by the library."""
        ids = [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum())), sizes

    def stretches(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``each`` for stretches with a blank before each, encoded as one text; their bytes tell where each one's ids end."""
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids, _ = self.each([" " + " ".join(parts)])
        ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum([1 + len(p.encode()) for p in parts])) + 1
        return ids, np.diff(ends, prepend=0)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none), each with ``end`` after them, and each one's number of ids."""
        texts = texts.fill_null("") if texts.null_count else texts
        n = len(texts)
        split = pc.split_pattern(texts, " ")
        off = split.offsets.to_numpy().astype(np.int64)
        off, coded = off - off[0], split.flatten().dictionary_encode()
        names, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        trimmed = pc.utf8_trim_whitespace(names)
        odd = ~pc.and_(pc.equal(trimmed, names), pc.not_equal(names, "")).to_numpy(zero_copy_only=False)
        whole = np.add.reduceat(odd[at], off[:-1]) > 0 if n else np.zeros(0, bool)
        first = pc.list_element(split, 0) if n else texts
        alone = pc.if_else(pa.array(whole), texts, first)
        # units: stretches known before, new ones, each text's beginning (or the whole of it), and the end
        rest = np.ones(len(at), bool)
        rest[off[:-1]] = False
        rest &= ~np.repeat(whole, np.diff(off))
        inner = at[rest]
        times = np.bincount(inner, minlength=len(names))
        used = np.flatnonzero(times)
        parts = names.take(pa.array(used)).to_pylist()
        old = np.fromiter(map(self.known.get, parts, repeat(-1)), np.int64, len(parts))
        fresh = np.flatnonzero(old < 0)
        new = [parts[i] for i in fresh.tolist()]
        ids, sizes = self.stretches(new)
        own, lengths = self.each(alone.to_pylist())
        m = len(self.size)
        old[fresh] = m + np.arange(len(fresh))
        number = np.zeros(len(names), np.int64)
        number[used] = old
        pool, size = np.concatenate([self.pool, ids, own, [end]]).astype(np.int32), np.concatenate([self.size, sizes, lengths, [1]])
        begin = np.cumsum(size) - size
        k = m + len(sizes)
        again = times[used][fresh] > 1
        self._keep([x for x, keep in zip(new, again.tolist(), strict=True) if keep], ids[np.repeat(again, sizes)], sizes[again])
        per = np.where(whole, 0, np.diff(off) - 1)
        stop = np.cumsum(per + 2)
        unit = np.full(int(stop[-1]) if n else 0, k + n, np.int64)
        unit[stop - per - 2] = k + np.arange(n)
        gap = np.repeat(stop - per - 1 - (np.cumsum(per) - per), per) + np.arange(per.sum())
        unit[gap] = number[inner]
        long = size[unit]
        total = np.cumsum(long)
        out = pool[np.repeat(begin[unit] - (total - long), long) + np.arange(total[-1] if n else 0)]
        return out, np.diff(total[stop - 1], prepend=0) if n else np.zeros(0, np.int64)


@dataclass
class IdFiles:
    """Shards under ``folder``, their table (shard, file, docs, tokens, before: ids in shards before) and the index of ``buckets`` buckets, both staged."""

    folder: str
    shards: DataFrame
    index: DataFrame
    buckets: int


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class _Shard:
    """A shard being written."""

    def __init__(self, files, path: str, width: int):
        self.name, self.width, self.bounds = f"{uuid.uuid4().hex}.ids", width, [0]
        self.out = files.open_output_stream(f"{path}/{self.name}", compression=None)
        self.out.write(MAGIC)

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.bounds += (self.bounds[-1] + np.cumsum(sizes)).tolist()

    def close(self) -> None:
        self.out.write(np.array([*self.bounds, self.width, len(self.bounds) - 1], "<i8").tobytes())
        self.out.close()


def _runs(ids: list, ordinal: int) -> list[tuple[int, int, int]]:
    """(position in ids, first ordinal, number) of each run of equal ids."""
    starts = [k for k in range(len(ids)) if not k or ids[k] != ids[k - 1]]
    return [(k, ordinal + k, e - k) for k, e in zip(starts, [*starts[1:], len(ids)], strict=True)]


def write(docs: DataFrame, spec: str, folder: str, end: int) -> DataFrame:
    """Write the shards and return the staged table of runs of equal ids: doc_id, shard, file, ordinal, rows, tokens.

    Ids ascend from null on; rows with one id go by a hash of their texts, and equal rows by their places in the input, so that a hot id fills many ranges.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    kind = dict(docs.dtypes)["doc_id"]
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("salt").asc()]
    d = docs.select("doc_id", "text").withColumn("salt", F.monotonically_increasing_id())
    d = d.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text", F.spark_partition_id().alias("range"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(shared.value)
        files, path = _files(folder)
        files.create_dir(path, recursive=True)
        shard, number, held, size = None, 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, number, held, size
            t = pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
            if shard is not None and shard.bounds[-1] * shard.width > SHARD:
                shard.close()
                shard, number = None, number + 1
            shard = shard or _Shard(files, path, encoder.width)
            ids, sizes = encoder.encode(t.column("text").chunk(0), end)
            ordinal = len(shard.bounds) - 1
            shard.add(ids, sizes)
            runs = _runs(t.column("doc_id").to_pylist(), ordinal)
            at = np.array([r[0] for r in runs])
            tokens = np.add.reduceat(sizes, at)
            m = len(runs)
            cols = [t.column("doc_id").chunk(0).take(pa.array(at)), pa.array([(t.column("range")[0].as_py() << 20) + number] * m), pa.array([shard.name] * m), *(pa.array([r[i] for r in runs], pa.int64()) for i in (1, 2)), pa.array(tokens)]
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "shard", "file", "ordinal", "rows", "tokens"])

        try:
            for b in batches:
                if b.num_rows:
                    held.append(b)
                    size += b.nbytes
                if size > TOGETHER:
                    yield flush()
            if held:
                yield flush()
        finally:
            if shard is not None:
                shard.close()

    return staged(d.mapInArrow(run, f"doc_id {kind}, shard long, file string, ordinal long, rows long, tokens long"))


# --- the minimal perfect hash function of a bucket -------------------------------------------------------


def _places(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(a ^ mix(b + np.uint64(level + 1))) % np.uint64(size)).astype(np.int64)


def build(a: np.ndarray, b: np.ndarray) -> tuple[list[int], bytes, np.ndarray]:
    """Sizes of levels, their bits, and the slot of each key; a and b are two hashes of 64 bits, and no two keys have both in common."""
    left, sizes, bits, place = np.arange(len(a)), [], [], np.zeros(len(a), np.int64)
    done = 0
    while len(left):
        size = max(64, -(-GAMMA * len(left) // 64) * 64)
        at = _places(a[left], b[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        ok = alone[at]
        place[left[ok]] = done + (np.cumsum(alone) - 1)[at[ok]]
        done += int(alone.sum())
        sizes.append(size)
        bits.append(np.packbits(alone))
        left = left[~ok]
        if len(sizes) > 200:
            raise ValueError("two keys with equal hashes of 128 bits")
    return sizes, b"".join(x.tobytes() for x in bits), place


def slots(a: np.ndarray, b: np.ndarray, sizes: list[int], bits: bytes) -> np.ndarray:
    """Slot of each key; -1 for one that no level has."""
    out, left, done, begin = np.full(len(a), -1, np.int64), np.arange(len(a)), 0, 0
    for level, size in enumerate(sizes):
        alone = np.unpackbits(np.frombuffer(bits, np.uint8, size // 8, begin)).astype(bool)
        at = _places(a[left], b[left], level, size)
        ok = alone[at]
        out[left[ok]] = done + (np.cumsum(alone) - 1)[at[ok]]
        done, begin, left = done + int(alone.sum()), begin + size // 8, left[~ok]
    return out


def _hashed(keys: DataFrame, buckets: int) -> DataFrame:
    """Two hashes of 64 bits and the bucket of each key."""
    return keys.withColumns({"a": F.xxhash64("doc_id"), "b": F.xxhash64(F.lit("key"), "doc_id")}).withColumn("bucket", F.pmod("a", F.lit(buckets)))


def _u64(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def indexed(runs: DataFrame) -> tuple[DataFrame, int]:
    """The staged index of runs, a row a bucket, and the number of buckets. A key's runs are as many as the shards it's in, at most."""
    buckets = max(1, -(-runs.count() // KEYS))

    def run(table: pa.Table) -> pa.Table:
        a, b = _u64(table.column("a")), _u64(table.column("b"))
        order = np.lexsort((table.column("shard").to_numpy(), b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first = np.flatnonzero(new)
        sizes, bits, slot = build(a[first], b[first])
        at = np.argsort(slot)
        many = np.diff(np.append(first, len(a)))[at]
        rows = order[np.repeat(first[at] - (np.cumsum(many) - many), many) + np.arange(len(a))]
        prints = mix(b[first][at]).astype(np.uint32).astype("<u4").tobytes()
        packed = [pa.array([table.column(c).to_numpy()[rows].astype("<i8").tobytes()]) for c in ("shard", "ordinal", "rows")]
        return pa.table([table.column("bucket").slice(0, 1), pa.array([sizes], pa.list_(pa.int32())), pa.array([bits]), pa.array([prints]), pa.array([many.astype("<i4").tobytes()]), *packed], names=["bucket", "sizes", "bits", "prints", "many", "shard", "ordinal", "rows"])

    keyed = _hashed(runs.select("doc_id", "shard", "ordinal", "rows"), buckets).drop("doc_id")
    return staged(keyed.groupBy("bucket").applyInArrow(run, "bucket long, sizes array<int>, bits binary, prints binary, many binary, shard binary, ordinal binary, rows binary")), buckets


def located(files: IdFiles, keys: DataFrame) -> DataFrame:
    """doc_id, shard, ordinal and rows of the places of every key (column doc_id) that the index has; repeated keys count once."""
    kind = dict(keys.dtypes)["doc_id"]

    def run(asked: pa.Table, found: pa.Table) -> pa.Table:
        if not len(asked) or not len(found):
            return pa.table({"doc_id": asked.column("doc_id").slice(0, 0), **{c: pa.array([], pa.int64()) for c in ("shard", "ordinal", "rows")}})
        r = found.to_pylist()[0]
        a, b = _u64(asked.column("a")), _u64(asked.column("b"))
        slot = slots(a, b, r["sizes"], r["bits"])
        prints, many = np.frombuffer(r["prints"], "<u4"), np.frombuffer(r["many"], "<i4").astype(np.int64)
        there = np.flatnonzero((slot >= 0) & (prints[slot] == mix(b).astype(np.uint32)))
        slot = slot[there]
        begin = (np.cumsum(many) - many)[slot]
        n = many[slot]
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cols = {c: pa.array(np.frombuffer(r[c], "<i8")[at]) for c in ("shard", "ordinal", "rows")}
        return pa.table({"doc_id": asked.column("doc_id").take(pa.array(np.repeat(there, n))), **cols})

    asked = _hashed(keys.select("doc_id").distinct(), files.buckets)
    return asked.groupBy("bucket").cogroup(files.index.groupBy("bucket")).applyInArrow(run, f"doc_id {kind}, shard long, ordinal long, rows long")


# --- reading ---------------------------------------------------------------------------------------------


def _groups(bounds: list[tuple[int, int]], width: int) -> Iterator[tuple[int, int]]:
    """Stretches (first, after the last) of sorted ranges of ids that follow on each other and are read at once."""
    a = 0
    for k in range(1, len(bounds) + 1):
        if k == len(bounds) or bounds[k][0] != bounds[k - 1][1] or (bounds[k][1] - bounds[a][0]) * width > READ:
            yield a, k
            a = k


def read(files: IdFiles, keys: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (binary, little-endian 32-bit) of every document of the keys.

    Places are sorted by shard and ordinal and dealt to tasks by ranges; neighbours are fetched in one read.
    """
    spark, folder = keys.sparkSession, files.folder
    kind = dict(keys.dtypes)["doc_id"]
    places = staged(located(files, keys).join(checked_broadcast(files.shards.select("shard", "file", "before")), "shard"))
    total = files.shards.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    tasks = max(1, -(-total * 2 // TASK))
    small_batches(spark)
    p = places.select("doc_id", "shard", "file", "before", "ordinal", "rows").repartitionByRange(tasks, "shard", "ordinal").sortWithinPartitions("shard", "ordinal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _files(folder)
        name, source = None, None
        for batch in batches:
            ids, (shards, names, before, ordinal, rows) = batch.column(0), (batch.column(i).to_pylist() for i in range(1, 6))
            i = 0
            while i < len(names):
                j = i
                while j < len(names) and names[j] == names[i]:
                    j += 1
                if names[i] != name:
                    if source is not None:
                        source.close()
                    name, source = names[i], store.open_input_file(f"{path}/{names[i]}")
                    tail = source.size()
                    width, docs = np.frombuffer(source.read_at(16, tail - 16), "<i8").tolist()
                    if source.read_at(len(MAGIC), 0) != MAGIC:
                        raise ValueError(f"{name} is no shard of ids")
                low, high = ordinal[i], max(ordinal[k] + rows[k] for k in range(i, j))
                edge = np.frombuffer(source.read_at(8 * (high - low + 1), tail - 16 - 8 * (docs + 1 - low)), "<i8")
                each = [(k, o) for k in range(i, j) for o in range(ordinal[k], ordinal[k] + rows[k])]
                spans = [(int(edge[o - low]), int(edge[o - low + 1])) for _, o in each]
                for a, z in _groups(spans, width):
                    begin, stop = spans[a][0], spans[z - 1][1]
                    data = np.frombuffer(source.read_at((stop - begin) * width, len(MAGIC) + begin * width), f"<u{width}").astype("<u4")
                    raw = [data[s - begin : e - begin].tobytes() for s, e in spans[a:z]]
                    cols = [ids.take(pa.array([k for k, _ in each[a:z]])), pa.array([before[i] + s for s, _ in spans[a:z]]), pa.array([e - s for s, e in spans[a:z]]), pa.array(raw, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids"])
                i = j
        if source is not None:
            source.close()

    return p.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids binary")


def stored(docs: DataFrame, spec: str, end: int, folder: str | None = None) -> IdFiles:
    """Encode ``docs`` (doc_id, text) into shards under ``folder`` (default: a new one in the shared folder) and index them.

    Null and empty texts are ``end`` alone. A null id is a key; rows that share an id are neighbours. Empty table: no shard. Other columns aren't read.
    """
    folder = folder or scratch(docs.sparkSession)
    runs = write(docs, spec, folder, end)
    shards = runs.groupBy("shard", "file").agg(F.sum("rows").alias("docs"), F.sum("tokens").alias("tokens"))
    over = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row a shard
    shards = staged(shards.withColumn("before", F.coalesce(F.sum("tokens").over(over), F.lit(0))))
    index, buckets = indexed(runs)
    return IdFiles(folder, shards, index, buckets)
