"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding look-alikes.

Texts are folded: compatibility forms, case, letters of other scripts that look Latin, and digits or signs
that stand for letters inside a word. Entries are whole words and stems (beginnings of words), with weights
that are log ratios of document frequencies in labelled training rows. An exception is a phrase of two words
in which an entry's word is used without harm; matches inside it don't count. The sum of weights is divided
by a power of the text's length in words, and a logistic scale fitted on the training rows gives the score.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches, staged

#: Labelled documents that the lexicon is learned from at most, and entries it has at most.
SAMPLE, ENTRIES = 20_000, 5000
THRESHOLD = 0.5
#: An entry needs this many toxic training documents, and this share of those that have it must be toxic.
LEAST_WORD, LEAST_STEM, PRECISION = 4, 4, 0.9
STEMS = (4, 5, 6)
#: Power of the length in words by which the weights' sum is divided.
LENGTH_POWER = 0.125
#: Terms that a task of the training holds before it sends them on.
TERMS = 20_000
#: Code points of a text that are folded and matched at once.
PIECE = 1_000_000

#: Letters of other scripts by the Latin letter that they look like.
HOMOGLYPHS = {
    "a": "аαɑ", "b": "ьβ", "c": "сϲ", "d": "ԁ", "e": "еєε", "f": "ϝ", "g": "ɡ", "h": "һ", "i": "іιıɩ", "j": "јϳ", "k": "кκ", "l": "ӏⅼ", "m": "мⅿ", "n": "пη",
    "o": "оοσө", "p": "рρ", "q": "ԛ", "r": "гɾ", "s": "ѕ", "t": "тτ", "u": "υս", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγү", "z": "ᴢ",
}
#: Digits and signs that stand for a letter inside a word.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "+": "t"}
_LETTERS = {ord(x): k for k, v in HOMOGLYPHS.items() for x in v} | {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_SIGNS = str.maketrans(SUBSTITUTES)
_INNER = re.compile(r"(?<=[^\W\d_])[" + re.escape("".join(SUBSTITUTES)) + r"]+(?=[^\W\d_])|(?<![^\s])[" + re.escape("".join(SUBSTITUTES)) + r"]+(?=[^\W\d_])|(?<=[^\W\d_])[013457]+(?!\S)")
_GAPS = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """Lower-case words of letters with one blank between, before and after.

    i and l are one letter in the folded alphabet, as the digit 1 stands for either.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii():
        text = text.translate(_LETTERS)
    text = _INNER.sub(lambda m: m.group().translate(_SIGNS), text)
    return " " + _GAPS.sub(" ", text).strip().replace("l", "i") + " "


def _pieces(text: str):
    """Folded pieces of a text, cut at blanks."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            cut = text.rfind(" ", at, end)
            end = cut if cut > at else end
        yield fold(text[at:end])
        at = end


@dataclass
class Lexicon:
    """words and stems with their weights, phrases that are exceptions, and the scale of the score."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    scale: float = 1.0

    def automaton(self):
        import ahocorasick

        found: dict[str, list] = {}
        for w, x in self.words.items():
            found.setdefault(f" {w} ", []).append(("word", x, len(w) + 2))
        for w, x in self.stems.items():
            found.setdefault(f" {w}", []).append(("stem", x, len(w) + 1))
        for w in self.exceptions:
            found.setdefault(f" {w} ", []).append(("but", 0.0, len(w) + 2))
        a = ahocorasick.Automaton()
        for k, v in found.items():
            a.add_word(k, v)
        if found:
            a.make_automaton()
        return a if found else None

    def total(self, automaton, text: str | None) -> tuple[float, int]:
        """Sum of weights of the matches, and the number of words."""
        total, words = 0.0, 0
        for t in _pieces(text or ""):
            words += t.count(" ") - 1 if len(t) > 2 else 0
            if automaton is None:
                continue
            spans, hits = [], {}
            for end, values in automaton.iter(t):
                for kind, x, n in values:
                    begin = end - n + 1
                    if kind == "but":
                        spans.append((begin, end))
                    else:
                        hits[begin] = max(hits.get(begin, 0.0), x)
            total += sum(x for b, x in hits.items() if not any(s <= b < e for s, e in spans)) if spans else sum(hits.values())
        return total, words

    def density(self, automaton, text: str | None) -> float:
        total, words = self.total(automaton, text)
        return total / max(1, words) ** LENGTH_POWER


def _counts(rows: DataFrame) -> DataFrame:
    """(kind, term, toxic, clean, words): documents of either label that have a word or stem, and words of a stem."""

    def batch(out: list) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 4
        types = (pa.string(), pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["kind", "term", "y", "word"])

    def run(batches):
        out: list = []
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("_y").to_pylist(), strict=True):
                words = {w for t in _pieces(text or "") for w in t.split()}
                out += [("word", w, y, "") for w in words if len(w) > 2]
                stems: dict[str, str] = {}
                for w in sorted(words):
                    for k in STEMS:
                        if len(w) > k:
                            stems.setdefault(w[:k], w)
                out += [("stem", s, y, w) for s, w in stems.items()]
                if len(out) >= TERMS:
                    yield batch(out)
                    out = []
        yield batch(out)

    c = rows.select("text", "_y").mapInArrow(run, "kind string, term string, y long, word string")
    return c.groupBy("kind", "term").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"), F.approx_count_distinct(F.when(F.col("y") == 1, F.col("word"))).alias("words"))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Lexicon:
    """Learn a lexicon from at most ``sample`` labelled documents that are not held out, those that come first by hash of the id.

    Without toxic rows the lexicon is empty and every score is 0.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).cast("long").alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # rows that share an id are one example; the training rows are staged, as several passes read them
    rows = staged(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min(F.struct("_y", "text")).alias("r")).select("r.*"), "zstd")
    sizes = rows.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0))).first()
    toxic, clean = int(sizes[1]), int(sizes[0] - sizes[1])
    if not toxic:
        return Lexicon()
    c = _counts(rows).where(F.col("toxic") >= LEAST_WORD)
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    good = F.when(F.col("kind") == "word", F.col("toxic") >= LEAST_WORD).otherwise((F.col("toxic") >= LEAST_STEM) & (F.col("words") >= LEAST_STEM))
    top = c.where(good & (F.col("toxic") >= PRECISION * (F.col("toxic") + F.col("clean")))).select("kind", "term", weight.alias("w"), "toxic", "clean").orderBy(F.col("toxic").desc(), "kind", "term").limit(ENTRIES).collect()
    lex = Lexicon(words={r.term: float(r.w) for r in top if r.kind == "word"}, stems={r.term: float(r.w) for r in top if r.kind == "stem"})
    mixed = {r.term for r in top if r.kind == "word" and r.clean}
    return _scaled(rows, _without_harm(rows, lex, mixed) if mixed else lex)


def _without_harm(rows: DataFrame, lex: Lexicon, mixed: set[str]) -> Lexicon:
    """Adds phrases of two words around words that clean documents have too, if only clean ones have the phrase, twice at least."""

    def run(batches):
        for b in batches:
            out = []
            for text, y in zip(b.column("text").to_pylist(), b.column("_y").to_pylist(), strict=True):
                pairs = {f"{x} {z}" for t in _pieces(text or "") for ws in [t.split()] for x, z in zip(ws, ws[1:], strict=False) if x in mixed or z in mixed}
                out += [(p, y) for p in pairs]
            cols = list(zip(*out, strict=True)) or [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64())], names=["phrase", "y"])

    c = rows.select("text", "_y").mapInArrow(run, "phrase string, y long").groupBy("phrase").agg(F.sum("y").alias("toxic"), F.count("*").alias("n"))
    lex.exceptions = [r.phrase for r in c.where("toxic = 0 and n > 1").orderBy(F.col("n").desc(), "phrase").limit(ENTRIES).collect()]
    return lex


def _densities(rows: DataFrame, lex: Lexicon, keep: list[str]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(lex)
    kinds = dict(rows.dtypes)

    def run(batches):
        lexicon = shared.value
        a = lexicon.automaton()
        for b in batches:
            d = [lexicon.density(a, t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(d, pa.float64())], names=[*keep, "density"])

    return rows.select(*keep, "text").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", density double")


def _scaled(rows: DataFrame, lex: Lexicon) -> Lexicon:
    """Puts the density that separates the training rows best at a score of one half; of equals the lowest clean margin wins."""
    d = _densities(rows, lex, ["_y"]).toPandas()  # a row an example, SAMPLE at most
    y, x = d["_y"].to_numpy(), d["density"].to_numpy()
    v = np.unique(np.concatenate([[0.0], x]))
    cuts = (v[:-1] + v[1:]) / 2 if len(v) > 1 else np.array([1.0])
    toxic, clean = np.sort(x[y == 1]), np.sort(x[y != 1])
    right = len(toxic) - np.searchsorted(toxic, cuts) + np.searchsorted(clean, cuts)
    lex.scale = float(cuts[int(np.flatnonzero(right == right.max())[0])])
    return lex


def scores(docs: DataFrame, lex: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Null and empty texts score 0. Repeated rows get equal scores; a null doc_id is not held out; an empty
    table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    d = _densities(docs, lex, ["doc_id"])
    s = d.select("doc_id", (F.col("density") / (F.col("density") + F.lit(lex.scale))).alias("score"))
    return s.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
