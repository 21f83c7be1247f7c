"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. In a round every adjacent pair is looked up by binary
search in the sorted pair keys; each word merges its lowest-rank pair, all its occurrences from left to
right; words without a pair that can be merged leave the array. Words are encoded once and kept in a
bounded table of the worker.

The vocabulary file is read on the driver; what executors get are arrays of bounded size (the vocabulary).
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: The pre-tokenizer's pattern of this vocabulary, its white space written as the Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
SHIFT = 21
NONE = np.int64(2**31)
#: Words kept by a worker, and pieces of one long text handled at once.
CACHE_WORDS, PIECES = 200_000, 100_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if printable and not a blank, else the next character from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Bpe:
    """Tables of one vocabulary file; ``encode`` and ``decode`` work on Python strings and numpy arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.byte_id = np.array([vocab[c] for c in symbols], np.int64)
        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in spec["model"]["merges"]]
        key = np.array([(vocab[a] << SHIFT) | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made[order]
        top = max([*vocab.values(), *added.values()]) + 1
        raw = [b""] * top
        for token, i in vocab.items():
            raw[i] = bytes(back[c] for c in token)
        for token, i in added.items():
            raw[i] = token.encode()
        self.lengths = np.array([len(x) for x in raw], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.added = added
        self._ready()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("find", "split", "seen")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def _ready(self):
        import regex

        self.find = regex.compile(PATTERN)
        names = sorted(self.added, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.seen: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each word (not empty)."""
        sizes = np.array([len(w) for w in words], np.int64)
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_sym, done_word = [], []
        while len(sym):
            last = np.empty(len(sym), bool)
            last[:-1], last[-1] = word[1:] != word[:-1], True
            pair = (sym << SHIFT) | np.append(sym[1:], 0)
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where((self.keys[at] == pair) & ~last, self.ranks[at], NONE)
            starts = np.flatnonzero(np.append(True, last[:-1]))
            best = np.minimum.reduceat(rank, starts)
            spans = np.diff(np.append(starts, len(sym)))
            least = np.repeat(best, spans)
            over = least == NONE
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
            take = (rank == least) & ~over
            # of neighbouring occurrences that overlap (one symbol repeated), every other one, from the left
            if (hits := take[1:] & take[:-1]).any():
                index = np.arange(len(sym))
                first = take & ~np.append(False, hits)
                run = np.maximum.accumulate(np.where(first, index, 0))
                take &= (index - run) % 2 == 0
            sym = np.where(take, self.made[at], sym)
            keep = ~over
            keep[1:] &= ~take[:-1]
            sym, word = sym[keep], word[keep]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        data = sym[order].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(word, minlength=len(words))) * 4
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _learn(self, pieces: Iterable[str]) -> dict[str, bytes]:
        new = list(set(pieces).difference(self.seen))
        if not new:
            return self.seen
        if len(self.seen) + len(new) > CACHE_WORDS:
            self.seen.clear()
            new = list(set(pieces))
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self.seen.update(zip(part, self.merge([w.encode("utf-8") for w in part]), strict=True))
        return self.seen

    def _parts(self, text: str) -> Iterator[list[str]]:
        """Pieces of plain text, in lists of bounded length."""
        if len(text) <= 4 * PIECES:
            yield self.find.findall(text)
            return
        found = self.find.finditer(text)
        while part := [m.group() for m in islice(found, PIECES)]:
            yield part

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; an added token's text becomes its id; null is empty."""
        todo: list[tuple[int, list[str] | str]] = []
        out: list[list[bytes]] = [[] for _ in texts]
        held = 0

        def flush():
            nonlocal held
            table = self._learn([p for _, part in todo if isinstance(part, list) for p in part]) if todo else {}
            for i, part in todo:
                out[i].append(self.added[part].to_bytes(4, "little") if isinstance(part, str) else b"".join(map(table.__getitem__, part)))
            todo.clear()
            held = 0

        for i, text in enumerate(texts):
            if not text:
                continue
            plain = [text] if not self.split or not any(a in text for a in self.added) else self.split.split(text)
            for piece in plain:
                if piece in self.added:
                    todo.append((i, piece))
                elif piece:
                    for part in self._parts(piece):
                        todo.append((i, part))
                        held += len(part)
                        if held > 4 * PIECES:
                            flush()
        flush()
        return [b"".join(x) for x in out]

    def decode(self, ids: list[bytes]) -> list[str]:
        """Text of each list of ids; bytes that are not UTF-8 become U+FFFD."""
        out = []
        for one in ids:
            i = np.frombuffer(one, "<u4").astype(np.int64)
            text = []
            for k in range(0, len(i), 1_000_000):
                part = i[k : k + 1_000_000]
                n = self.lengths[part]
                ends = np.cumsum(n)
                at = np.repeat(self.begins[part] - (ends - n), n) + np.arange(ends[-1])
                text.append(self.flat[at].tobytes())
            out.append(b"".join(text).decode("utf-8", errors="replace"))
        return out


def encode(docs: DataFrame, bpe: Bpe, decoded: bool = False) -> DataFrame:
    """(doc_id, ids_le) and, if asked for, the text that the ids decode to.

    ids_le: the ids as little-endian unsigned 32-bit integers. Null and empty texts have no ids. Rows keep
    their number and ids whatever repeats; other columns are not read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(bpe)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        model = shared.value
        for b in batches:
            ids = model.encode(b.column(1).to_pylist())
            cols = [b.column(0), pa.array(ids, pa.binary())]
            if decoded:
                cols.append(pa.array(model.decode(ids), pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids_le", "decoded"][: len(cols)])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids_le binary" + ", decoded string" * decoded)


def round_trip(docs: DataFrame, bpe: Bpe) -> DataFrame:
    """Digests of ids and of the decoded text: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    e = encode(docs, bpe, decoded=True)
    return e.select("doc_id", F.expr("length(ids_le) div 4").cast("long").alias("n_tokens"), F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
