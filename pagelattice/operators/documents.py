"""Content across documents: exact and near copies, thin texts, boilerplate, overlap, readability, keywords, passages."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import dims
from ..plans.stage import in_batches, small, staged

try:  # Python's own: half the time of OpenSSL's for texts as short as shingles
    from _md5 import md5
except ImportError:
    from hashlib import md5


def exact_groups(docs: DataFrame) -> DataFrame:
    """Groups of equal normalised texts: digest, docs, first_id."""
    d = docs.where("text is not null").select("doc_id", F.sha2(T.normalised(F.col("text")), 256).alias("digest"))
    return d.groupBy("digest").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_id")).where("docs > 1")


def thin_texts(docs: DataFrame, floor: int = 300, critical: int = 100) -> DataFrame:
    d = docs.select("doc_id", F.size(T.words(F.coalesce("text", F.lit("")))).cast("long").alias("words")).where(F.col("words") < floor)
    return d.withColumn("severity", F.when(F.col("words") < critical, "critical").otherwise("warning"))


#: Modulus of the universal hashes; products of two residues fit a long.
PRIME = 2147483647


def coefficients(n: int) -> list[tuple[int, int]]:
    """n pairs (a, b) of hashes (a * x + b) mod PRIME, from a fixed recurrence."""
    out, x = [], 20240101
    for _ in range(n):
        pair = []
        for _ in range(2):
            x = (x * 48271) % PRIME
            pair.append(x)
        out.append((pair[0], pair[1]))
    return out


def signatures(docs: DataFrame, k: int = 5, n: int = 100, seeded_md5: bool = False) -> DataFrame:
    """doc_id and n minima over the shingles; documents without a shingle have none.

    A shingle is digested once, and n universal hashes of the digest's first 60 bits are minimised, ``SLICE`` shingles
    of a document at a time, in Arrow batches (measured faster than lambdas over arrays). With ``seeded_md5`` every minimum is that of
    md5('seed:shingle') as hex text instead, at n digests a shingle.
    """
    if seeded_md5:
        s = _shingled(docs, k, "doc_id")
        return s.select("doc_id", F.array(*(F.array_min(F.transform("s", _seeded(i))) for i in range(n))).alias("sig"))
    return signed(docs, F.col("doc_id"), k=k, n=n)


def signed(docs: DataFrame, *keep: Column, k: int = 5, n: int = 100, all_rows: bool = False) -> DataFrame:
    """Columns ``keep`` and sig, the minima, of every row that has words (null for others with ``all_rows``); rows that share an id stay rows of their own."""
    d = _joined(docs, *keep)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1])
    s = in_batches(d, _minima(k, coefficients(n)), f"{kept}, sig array<long>")
    return s if all_rows else s.where("sig is not null")


def band_keys(sig: Column, threshold: float, n: int = 100, bands: int = 20) -> Column:
    """Keys of a signature, one of which any two signatures have in common that agree in ``threshold`` of n places.

    So many places in common leave ``bands`` less the disagreeing places' number of whole bands in common. Bands are dealt to one group
    fewer than that, so that two of them are in one group: keys are the pairs of bands of a group, which hardly any two signatures
    share by chance. Where only one band is sure to be shared, keys are bands.
    """
    r = n // bands
    shared = bands - int((1 - threshold) * n + 1e-9)
    if shared < 1:
        raise ValueError("more bands are needed for this threshold")
    places = lambda b: [F.get(sig, b * r + i) for i in range(r)]
    if shared == 1:
        return F.array(*(F.xxhash64(F.lit(b), *places(b)) for b in range(bands)))
    groups = [list(range(g, bands, shared - 1)) for g in range(shared - 1)]
    # a band is hashed once, not for each of its pairs
    pairs = lambda h: F.array(*(F.xxhash64(F.lit(x * bands + y), F.get(h, x), F.get(h, y)) for g in groups for i, x in enumerate(g) for y in g[i + 1 :]))
    return F.get(F.transform(F.array(F.array(*(F.xxhash64(F.lit(b), *places(b)) for b in range(bands)))), pairs), 0)


def shared_keys(keys: DataFrame) -> DataFrame:
    """Rows (node, key) of the keys that several rows have; of keys that the same nodes have, of one alone."""
    sums = keys.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x")).where("n > 1")
    once = staged(sums.groupBy("n", "s", "x").agg(F.min("key").alias("key")).select("key"))
    return staged(keys.join(small(once, 1_000_000), "key"))


def _joined(docs: DataFrame, *keep: Column) -> DataFrame:
    """Columns ``keep`` and t, the words parted by blanks, '' without words.

    Rows without words are left out where batches are read (``_worded``): a filter on t here is pushed below, and the words are cut twice.
    """
    return docs.select(*keep, F.coalesce(F.array_join(T.ascii_words(F.col("text")), " "), F.lit("")).alias("t"))


def _worded(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows of a batch whose last column, t, has words."""
    return batch.filter(pc.not_equal(batch.column(batch.num_columns - 1), ""))


def _digests(words: str, k: int) -> np.ndarray:
    """Halves of the MD5 digests of the distinct k-word shingles, in order of first place; fewer words are one shingle."""
    text = words.encode()
    ends = [-1, *np.flatnonzero(np.frombuffer(text, np.uint8) == ord(" ")).tolist(), len(text)]
    distinct = dict.fromkeys([text[i + 1 : j] for i, j in zip(ends, ends[k:])] or [text])
    return np.frombuffer(b"".join([md5(x).digest() for x in distinct]), dtype=">u8").reshape(-1, 2)


def _kernel(pairs: list[tuple[int, int]]) -> Callable[[np.ndarray], np.ndarray]:
    """Digests below PRIME -> the minimum of every hash (a * x + b) mod PRIME over them. Works in two buffers of SLICE columns that fit a core's cache."""
    a, b = (np.array(c, dtype=np.int64)[:, None] for c in zip(*pairs, strict=True))
    x, y = (np.empty(len(pairs) * SLICE, np.int64) for _ in range(2))

    def least(h: np.ndarray) -> np.ndarray:
        out = np.full(len(pairs), PRIME, np.int64)
        for i in range(0, len(h), SLICE):
            g = h[i : i + SLICE]
            u, v = x[: len(pairs) * len(g)], y[: len(pairs) * len(g)]
            at = u.reshape(len(pairs), len(g))
            np.multiply(a, g, out=at)
            at += b
            # mod 2^31 - 1 by adding high and low bits: as digests, a and b are below PRIME, the sum is below 2 * PRIME
            np.right_shift(u, 31, out=v)
            u &= PRIME
            u += v
            # either it or it less PRIME is the residue; a negative one becomes huge
            np.subtract(u, PRIME, out=v)
            v &= 2**63 - 1
            np.minimum(u, v, out=u)
            np.minimum(out, at.min(axis=1), out=out)
        return out

    return least


def _residues(x: np.ndarray) -> np.ndarray:
    """x mod PRIME = 2^31 - 1, by folding instead of division: high and low bits are added twice."""
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)
    return np.where(x == PRIME, 0, x)


def _hashed(words: str, k: int) -> np.ndarray:
    """The distinct k-word shingles as the numbers that are hashed: the first 60 bits of their digests, below PRIME."""
    return _residues((_digests(words, k)[:, 0] >> np.uint64(4)).astype(np.int64))


def _minima(k: int, pairs: list[tuple[int, int]]):
    """Of each row, whose last column is t, the minimum of every hash over its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = _kernel(pairs)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            sig = np.stack([least(_hashed(t, k)) for t in texts if t] or [np.empty(0, np.int64)])
            ends = np.cumsum([len(pairs) if t else 0 for t in texts], dtype=np.int32)
            offsets = pa.array(np.concatenate([np.zeros(1, np.int32), ends]), mask=np.array([*(not t for t in texts), False]))
            flat = pa.ListArray.from_arrays(offsets, pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], flat], names=[*batch.schema.names[:-1], "sig"])

    return run


#: Shingles of a document that are hashed at once.
SLICE = 1 << 8


def _halves(k: int):
    """Of each row of (source, t) the shingles' digests as two lists of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(_worded, batches):
            d = [_digests(t, k).astype(np.uint64).view(np.int64) for t in batch.column(1).to_pylist()]
            offsets = pa.array(np.cumsum([0, *map(len, d)]), pa.int32())
            flat = np.concatenate(d) if d else np.empty((0, 2), np.int64)
            x, y = (pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(flat[:, i]))) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), x, y], names=["source", "x", "y"])

    return run


def _seeded(i: int):
    return lambda x: F.md5(F.concat(F.lit(f"{i}:"), x).cast("binary"))


def _shingled(df: DataFrame, k: int, *keep: str) -> DataFrame:
    """Columns ``keep`` and s, the distinct shingles of rows that have words.

    Tokens are a column of their own first, and nothing filters on s: a filter would be pushed below and
    make the tokens anew for every shingle. For the same reason s is exploded by explode_outer.
    """
    return df.select(*keep, T.ascii_words(F.col("text")).alias("w")).where(F.size("w") > 0).select(*keep, T.shingles(F.col("w"), k).alias("s"))


def near_pairs(docs: DataFrame, threshold: float = 0.85, k: int = 5, n: int = 100, bands: int = 20) -> DataFrame:
    """Pairs a, b (a < b) whose signatures agree in at least ``threshold`` of n places, without pairs of equal texts.

    Documents of equal signatures are one class, and its smallest id stands for it: pairs are those of such ids, and
    a member with another text than its class's id is paired with that id alone. So a class of m copies gives m - 1 rows at most,
    and copies of one text (see ``exact_groups``) none.

    Lossless: candidates come from an equi join on ``band_keys``, of one row a class, over the keys that are shared. Rows that share an id are documents of their own.
    """
    sig = signed(docs, F.col("doc_id"), F.sha2(T.normalised(F.col("text")), 256).alias("exact"), k=k, n=n)
    sig = staged(sig.withColumn("digest", F.md5(F.array_join(F.col("sig").cast("array<string>"), ",").cast("binary"))))
    one = staged(sig.groupBy("digest").agg(F.min(F.struct("doc_id", "exact", "sig")).alias("r")).select("digest", F.col("r.doc_id").alias("rep"), F.col("r.exact").alias("rep_exact"), "r.sig"))
    keys = shared_keys(one.select(F.col("rep").alias("node"), F.explode(band_keys(F.col("sig"), threshold, n, bands)).alias("key")))
    x, y = keys.select(F.col("node").alias("a"), "key"), keys.select(F.col("node").alias("b"), "key")
    cand = x.join(y, "key").where("a < b").select("a", "b").distinct()
    agree = F.size(F.filter(F.zip_with("sx", "sy", lambda p, q: p == q), lambda z: z)) / F.lit(float(n))
    sides = cand.join(one.select(F.col("rep").alias("a"), F.col("sig").alias("sx")), "a").join(one.select(F.col("rep").alias("b"), F.col("sig").alias("sy")), "b")
    near = sides.select("a", "b", agree.alias("similarity")).where(F.col("similarity") >= threshold)
    members = sig.join(one.select("digest", "rep", "rep_exact"), "digest").where(F.col("exact") != F.col("rep_exact"))
    return near.unionByName(members.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("similarity")))


def _source_shingles(docs: DataFrame, k: int) -> DataFrame:
    """source, n (distinct shingles of the document), x and y (halves of a shingle's digest), a row a shingle of documents that have words."""
    s = in_batches(_joined(docs, F.col("source")), _halves(k), "source string, x array<long>, y array<long>")
    return s.select("source", F.size("x").alias("n"), F.explode(F.arrays_zip("x", "y")).alias("h")).select("source", "n", "h.x", "h.y")


def boilerplate(docs: DataFrame, share: float = 0.8, k: int = 5) -> DataFrame:
    """By source: documents, shingles that at least max(2, share of documents) have, and their mean share of a document's shingles.

    A common shingle is missing in at most ``spare`` of a source's documents, so any M of them have it M - spare times or more. Candidates are the
    shingles that the shortest documents have so often: these are few words, and at most three times as many candidates as such a document has shingles
    on average. Only they are counted in all documents, so no other shingle of a longer document is shuffled. Every occurrence brings one over the number of its
    document's shingles, and the sum of these over common shingles is the sum of the documents' shares.
    """
    lengths = staged(docs.groupBy("source", F.coalesce(F.size(T.ascii_words(F.col("text"))), F.lit(0)).alias("words")).agg(F.count("*").alias("docs")))
    n = lengths.groupBy("source").agg(F.sum("docs").alias("docs"), F.coalesce(F.sum(F.when(F.col("words") > 0, F.col("docs"))), F.lit(0)).alias("with_words"))
    need = F.greatest(F.lit(2.0), share * F.col("docs"))
    spare = F.col("docs") - F.ceil(need)
    # the shortest documents, by whole lengths: half as many again as may lack a common shingle, and one more
    upto = F.sum("part").over(W.partitionBy("source").orderBy("words"))
    cut = lengths.withColumnRenamed("docs", "part").join(n, "source").where(spare >= 0).select("source", "words", spare.alias("spare"), upto.alias("m")).where(F.col("m") >= F.ceil(F.lit(1.5) * (F.col("spare") + 1)))
    cut = staged(cut.groupBy("source").agg(F.min(F.struct("words", "m", "spare")).alias("c")).select("source", F.col("c.words").alias("longest"), (F.col("c.m") - F.col("c.spare")).alias("least")).where("longest > 0"))
    short = docs.join(small(cut), "source").where(F.size(T.ascii_words(F.col("text"))) <= F.col("longest")).select("source", "text")
    often = _source_shingles(short, k).groupBy("source", "x", "y").agg(F.count("*").alias("c")).join(small(cut), "source").where("c >= least")
    often = staged(often.select("source", "x", "y"))
    among = docs.join(small(often.select("source").distinct()), "source", "left_semi")
    df = _source_shingles(among, k).join(small(often), ["source", "x", "y"]).groupBy("source", "x", "y").agg(F.count("*").alias("df"), F.sum(F.lit(1.0) / F.col("n")).alias("part"))
    common = df.join(n, "source").where(F.col("df") >= need)
    g = common.groupBy("source").agg(F.count("*").alias("common_shingles"), F.sum("part").alias("parts"))
    mean = T.rounded(F.col("parts") / F.col("with_words"), 4)
    return n.join(g, n["source"].eqNullSafe(g["source"]), "left").select(n["source"], "docs", F.coalesce("common_shingles", F.lit(0)).alias("common_shingles"), F.coalesce(mean, F.lit(0.0)).alias("mean_share"))


def shingle_overlap(docs: DataFrame, other: DataFrame, k: int = 8) -> DataFrame:
    """doc_id, item_id and the number of k-word shingles that a document shares with an item of another corpus."""
    a = _shingled(docs, k, "doc_id").select("doc_id", F.explode_outer("s").alias("shingle"))
    b = _shingled(other, k, "item_id").select("item_id", F.explode_outer("s").alias("shingle"))
    return a.join(b, "shingle").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


def readability_a(docs: DataFrame) -> DataFrame:
    """First method: words of ASCII letters, sentences with four words at least, a final e silent."""
    d = docs.select("doc_id", F.col("text"), T.ascii_words(F.col("text")).alias("w"))
    sent = F.filter(T.sentences(F.col("text")), lambda s: F.size(F.filter(T.words(s), lambda w: w.rlike("^[a-zA-Z]+$"))) >= 4)
    d = d.select("doc_id", F.size("w").cast("long").alias("words"), F.greatest(F.lit(1), F.size(sent)).cast("long").alias("sentences"), F.transform("w", T.syllables_a).alias("syl"))
    d = d.where("words > 0").select("doc_id", "words", "sentences", T.total(F.col("syl")).cast("long").alias("syllables"), F.size(F.filter("syl", lambda x: x >= 3)).cast("long").alias("complex_words"))
    n, s, y = (F.col(c).cast("double") for c in ("words", "sentences", "syllables"))
    d = d.withColumns({"reading_ease": T.reading_ease(n, s, y), "grade": T.reading_grade(n, s, y), "minutes": T.rounded(n / 200, 1)})
    return d.withColumn("level", T.reading_level(F.col("reading_ease")))


def readability_b(docs: DataFrame) -> DataFrame:
    """Second method: words with apostrophes and hyphens, sentences between runs of . ! ?."""
    w = F.regexp_extract_all("text", F.lit("[a-zA-Z'-]+"), F.lit(0))
    s = F.filter(F.split("text", "[.!?]+"), T.solid)
    d = docs.where(T.solid(F.col("text"))).select("doc_id", F.greatest(F.lit(1), F.size(w)).cast("long").alias("words"), F.greatest(F.lit(1), F.size(s)).cast("long").alias("sentences"), T.total(F.transform(w, T.syllables_b)).cast("long").alias("syllables"))
    n, m, y = (F.col(c).cast("double") for c in ("words", "sentences", "syllables"))
    d = d.withColumns({"reading_ease": T.reading_ease(n, m, y), "grade": T.reading_grade(n, m, y)})
    return d.withColumn("label", F.when(F.col("reading_ease") >= 70, "easy").when(F.col("reading_ease") >= 50, "medium").otherwise("difficult"))


def reading_levels(docs: DataFrame) -> DataFrame:
    return readability_a(docs).groupBy("level").agg(F.count("*").alias("docs"), T.rounded(F.avg("reading_ease"), 2).alias("avg_ease"))


def quality_by_readability(docs: DataFrame, labels: DataFrame) -> DataFrame:
    j = readability_a(docs).join(labels.select("doc_id", "quality"), "doc_id")
    return j.groupBy("level").agg(F.count("*").alias("docs"), T.rounded(F.avg(F.col("quality").cast("double")), 4).alias("share_good"))


#: An n-gram's score is its count by these, and n-grams are kept above these counts.
GRAM_WEIGHTS, GRAM_FLOORS = (1, 3, 5), (3, 1, 1)


def _best_grams(k: int):
    """Of each row of (doc_id, words parted by blanks), whose doc_id is no other row's: its terms as ``keywords`` has them."""

    def best(t: str) -> list[tuple[str, int]]:
        w = t.split(" ") if t else []
        c = [(" ".join(g), m * v) for m, f, n in zip(GRAM_WEIGHTS, GRAM_FLOORS, (1, 2, 3)) for g, v in Counter(zip(*(w[i:] for i in range(n)))).items() if v > f]
        c.sort(key=lambda x: (-x[1], x[0]))
        top, out = [x for x, _ in c[: 3 * k]], []
        for x in c:
            if not any(x[0] in y and x[0] != y for y in top):
                out.append(x)
                if len(out) == k:
                    break
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [best(t) for t in batch.column(1).to_pylist()]
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(each)), [len(x) for x in each])))
            flat = [y for x in each for y in x]
            columns = [ids, pa.array([x for x, _ in flat], pa.string()), pa.array([v for _, v in flat], pa.int64()), pa.array([i + 1 for x in each for i in range(len(x))], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "term", "score", "rank"])

    return run


def keywords(docs: DataFrame, k: int = 12) -> DataFrame:
    """Frequent uni-, bi- and trigrams without stop-words: doc_id, term, score, rank; a term inside a better ranked longer one is left out.

    Scores: uni above 3 times as they are, bi and tri above once by 3 and 5. Ties go by term.

    A document whose id is its own is done within its row. Rows that share an id are one document: their grams are shuffled (``_shared_keywords``).
    """
    w = F.filter(T.ascii_words(F.col("text")), lambda x: (F.length(x) >= 3) & ~x.isin(*T.STOP_WORDS))
    shared = staged(docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1 or doc_id is null").select("doc_id"))
    none = shared.isEmpty()
    alone = docs if none else docs.where("doc_id is not null").join(small(shared.where("doc_id is not null")), "doc_id", "left_anti")
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = in_batches(alone.select("doc_id", F.array_join(w, " ").alias("t")), _best_grams(k), f"doc_id {kind}, term string, score long, rank long")
    if none:
        return own
    rest = docs.join(small(shared), docs["doc_id"].eqNullSafe(shared["doc_id"]), "left_semi")
    return own.unionByName(_shared_keywords(rest.select("doc_id", w.alias("w")), k))


def _shared_keywords(d: DataFrame, k: int) -> DataFrame:
    """``keywords`` of (doc_id, w) where several rows may have one id."""
    sized = lambda n: F.transform(T.grams(F.col("w"), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("term")))
    each = d.select("doc_id", F.concat(*map(sized, (1, 2, 3))).alias("g")).select("doc_id", F.explode_outer("g").alias("g"))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("n"))
    c = each.where("g is not null").groupBy("doc_id", "g.n", "g.term").agg(F.count("*").alias("c")).where(F.col("c") > pick(GRAM_FLOORS))
    c = staged(c.select("doc_id", "term", (F.col("c") * pick(GRAM_WEIGHTS)).cast("long").alias("score")))
    order = W.partitionBy("doc_id").orderBy(F.col("score").desc(), "term")
    top = c.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 3 * k)
    # the best terms suppress, but any term may fill a place
    inside = c.alias("a").join(top.alias("b"), (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.term") != F.col("b.term")) & F.col("b.term").contains(F.col("a.term"))).select("a.doc_id", "a.term").distinct()
    left = c.join(inside, ["doc_id", "term"], "left_anti")
    return left.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("doc_id", "term", "score", "rank")


def long_sentences(docs: DataFrame, k: int = 5) -> DataFrame:
    """The k sentences with most words of each document: doc_id, rank, words, sentence; ties by place."""
    s = docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("words", F.size(T.words(F.col("sentence"))).cast("long"))
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("words").desc(), "pos")).cast("long")
    return s.withColumn("rank", rank).where(F.col("rank") <= k).select("doc_id", "rank", "words", "sentence")


#: Words before which a long sentence may be split.
CONJUNCTIONS = ("and", "but", "because", "which", "that", "while", "although", "however", "so")


def _squared(head: Column, rest: Column) -> Column:
    """Two sentences of the tokens before and after a cut."""
    first = F.regexp_replace(F.array_join(head, " "), r"[,;:.]+$", "")
    drop = F.lower(F.regexp_replace(F.coalesce(F.get(rest, 0), F.lit("")), "[,;:]+", "")).isin(*CONJUNCTIONS)
    second = F.regexp_replace(F.array_join(F.when(drop, F.slice(rest, 2, F.size(rest))).otherwise(rest), " "), r"^[,;: ]+", "")
    up = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))
    return F.concat(up(first), F.lit(". "), up(second), F.lit("."))


def _letter_words(s: Column) -> Column:
    return F.filter(T.words(F.lower(s)), lambda x: x.rlike("^[a-z]+$"))


def _navigation(s: Column, n: Column, distinct: Column) -> Column:
    """Whether a sentence of n words is of a menu or a list rather than prose: a phrase of menus, two line breaks, no word, or 25 words and more of which over 85 % differ."""
    return F.lower(s).rlike("|".join(re.escape(p) for p in dims.MENU_PHRASES)) | (F.regexp_count(s, F.lit("\n")) >= 2) | (n == 0) | ((n >= 25) & (100 * distinct > 85 * n))


def sentence_rewrites(docs: DataFrame, longer: int = 25, best: int = 5, k: int = 3) -> DataFrame:
    """doc_id, rank and rewrite: of the ``best`` longest sentences of over ``longer`` words of ASCII letters (ties by place) the first ``k`` that are prose, split in two
    near the middle, at a comma or conjunction if one lies eight words from either end. Sentences of up to 22 tokens stay. All within a row.
    """
    # words are cut only where length and runs of letters, which are words at most, leave room for so many
    room = lambda s: (F.length(s) > 2 * longer) & (F.regexp_count(s, F.lit("[a-zA-Z]+")) > longer)
    count = lambda s: F.when(room(s), F.size(F.filter(T.words(s), lambda w: w.rlike("^[a-zA-Z]+$")))).otherwise(0)
    d = docs.select("doc_id", T.sentences(F.col("text")).alias("s")).select("doc_id", F.transform("s", lambda s, i: F.struct((-count(s)).alias("n"), i.alias("i"), s.alias("s"))).alias("s"))
    d = d.select("doc_id", F.slice(F.array_sort(F.filter("s", lambda x: x["n"] < -longer)), 1, best).alias("s"))
    # what is used more than once is a column or a field of its own first: words of a sentence, the place to cut, both parts
    d = d.select("doc_id", F.transform("s", lambda x: F.struct(x["s"].alias("s"), _letter_words(x["s"]).alias("w"))).alias("s"))
    d = d.select("doc_id", F.transform("s", lambda x: F.struct(x["s"].alias("s"), F.size(x["w"]).alias("n"), F.size(F.array_distinct(x["w"])).alias("distinct"))).alias("s"))
    d = d.select("doc_id", F.slice(F.filter("s", lambda x: ~_navigation(x["s"], x["n"], x["distinct"])), 1, k).alias("s"))
    s = d.select("doc_id", F.posexplode_outer("s").alias("pos", "s")).where("pos is not null").select("doc_id", (F.col("pos") + 1).cast("long").alias("rank"), T.trimmed(F.col("s.s")).alias("sentence"))
    s = s.withColumn("tok", F.split("sentence", r"\s+")).withColumn("size", F.size("tok")).withColumn("mid", F.floor(F.col("size") / 2).cast("int"))
    ends = F.transform("tok", lambda t, i: F.when(t.rlike("[,;:]$") | F.lower(F.regexp_replace(t, "[,;:]+", "")).isin(*CONJUNCTIONS), F.struct(F.abs(i - F.col("mid")).alias("d"), i.alias("i"))))
    s = s.withColumn("point", F.when(F.col("size") > 22, F.array_min(F.filter(ends, lambda x: x.isNotNull()))["i"]))
    s = s.withColumn("at", F.when(F.col("point").isNull() | (F.col("point") < 8) | (F.col("point") > F.col("size") - 8), F.col("mid")).otherwise(F.col("point")))
    s = s.withColumns({"head": F.slice("tok", 1, F.col("at")), "rest": F.slice("tok", F.col("at") + 1, F.col("size"))})
    return s.select("doc_id", "rank", F.when(F.col("size") <= 22, F.col("sentence")).otherwise(_squared(F.col("head"), F.col("rest"))).alias("rewrite"))


def citable_passages(docs: DataFrame, low: int = 134, high: int = 167) -> DataFrame:
    """Lines (paragraphs) whose length in words suits a citation, and where in the document they are, by thirds."""
    p = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "p"), F.size(F.split("text", "\n")).alias("n")).withColumn("words", F.size(T.words(F.col("p"))).cast("long"))
    p = p.where(F.col("words").between(low, high))
    return p.select("doc_id", F.col("pos").cast("long").alias("pos"), "words", F.when(F.col("pos") * 3 < F.col("n"), "first").when(F.col("pos") * 3 < F.col("n") * 2, "middle").otherwise("last").alias("third"))


def keyword_density(docs: DataFrame, warn: float = 0.03) -> DataFrame:
    """The most frequent keyword of a document and its share of words, where it passes ``warn``."""
    d = docs.select("doc_id", T.ascii_words(F.col("text")).alias("all")).select("doc_id", F.size("all").alias("n"), F.explode(F.filter("all", lambda x: (F.length(x) >= 3) & ~x.isin(*T.STOP_WORDS))).alias("w"))
    c = d.groupBy("doc_id", "n", "w").agg(F.count("*").alias("c"))
    top = c.groupBy("doc_id", "n").agg(F.max(F.struct("c", "w")).alias("t"))
    out = top.select("doc_id", F.col("t.w").alias("word"), F.col("t.c").alias("uses"), T.rounded(F.col("t.c") / F.col("n"), 4).alias("share"))
    return out.where(F.col("share") > warn)
