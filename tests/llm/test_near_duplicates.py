"""Near-duplicate documents and lines against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelattice.llm import common, line_dedup, minhash_dedup, neardup, sketch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, base, share):
    return [w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in base]


def fixture():
    rng = random.Random(3)
    base, other = words(rng, 150), words(rng, 90)
    texts = [" ".join(base)] * 3 + [" ".join(edited(rng, base, s)) for s in [0.02] * 30 + [0.035] * 60 + [0.05] * 40]
    texts += [" ".join(words(rng, rng.randrange(1, 200))) for _ in range(40)]
    texts += [" ".join(words(rng, 60) + other) for _ in range(40)]  # a passage that many share
    texts += [None, "", " \n", "one", "ONE", "one two", "a b c d e", "A b\tc d\ne"]
    rng.shuffle(texts)
    return [(i, t, "en", "s", 0) for i, t in enumerate(texts)]


def brute(rows, k=5, percent=75):
    sets = {}
    for i, t, *_ in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("block", [256, 16])
def test_documents(spark, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "SKETCHES", block)
    rows = fixture()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(rows)
    assert len({v[1] for v in want.values()}) > 60
    assert got == want


def test_documents_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert minhash_dedup.near_duplicates(empty).count() == 0
    assert minhash_dedup.deduplicated(empty).columns == empty.columns
    rows = [(1, "a b c", "en", "s", 1), (1, "a b c", "en", "s", 1), (2, "A b c", None, None, None), (None, "a b c", "x", "y", 0), (None, None, "x", "y", 0), (3, "long " * 30000, "en", "s", 0)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in minhash_dedup.near_duplicates(d).collect())
    assert got == sorted([("1", 1, "1"), ("1", 1, "1"), ("2", 1, "1"), ("None", 1, "1"), ("None", 0, "None"), ("3", 1, "3")])
    assert {r.doc_id for r in minhash_dedup.deduplicated(d).collect()} == {1, 3, None}


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    u = rng.integers(0, 2**63, 1500, dtype=np.int64).astype(np.uint64)
    a, b = u[:1200], u[300:]
    s = sketch.sketch(np.concatenate([a, b, a[:3]]), np.array([0, 1200, 2400, 2403]), 250)
    assert (s != np.uint64(2**64 - 1)).all()
    assert abs((s[0] == s[1]).mean() - 900 / 1500) < 0.1
    assert (s[2] == sketch.sketch(a[:3], np.array([0, 3]), 250)[0]).all()


ENDS = " \t\n\x0b\x0c\r"


def brute_lines(rows, k, percent):
    items = [(i, p, line.strip(ENDS).lower()) for i, t, *_ in rows if t is not None for p, line in enumerate(t.split("\n")) if line.strip(ENDS)]
    texts = sorted({x for *_, x in items})
    sets = {t: {t[j : j + k] for j in range(max(1, len(t) - k + 1))} for t in texts}
    root = {t: t for t in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(b)] = find(a)
    first = {}
    for i, p, t in items:
        first.setdefault(find(t), (i, p))
    keep = set(first.values())
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if not x.strip(ENDS) or (i, p) in keep) for i, t, *_ in rows if t is not None}


def test_lines(spark):
    rng = random.Random(5)
    base = [" ".join(words(rng, rng.randrange(8, 60))) for _ in range(60)]
    texts = []
    for _ in range(80):
        lines = []
        for _ in range(rng.randrange(1, 8)):
            x = rng.choice(base)
            kind = rng.random()
            lines.append(x if kind < 0.4 else " ".join(edited(rng, x.split(), 0.03)) if kind < 0.7 else "  " + x.upper() if kind < 0.8 else " ".join(words(rng, 20)) if kind < 0.95 else "")
        texts.append("\n".join(lines))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*texts, "", "short", "short\nshort\n\n", "ein\tüber größer"])] + [(1000, None, None, None, None)]
    d = line_dedup.deduplicated(spark.createDataFrame(rows, SCHEMA))
    got = {r.doc_id: r.text for r in d.collect()}
    want = brute_lines(rows, line_dedup.K, line_dedup.PERCENT)
    assert got.pop(1000) is None
    assert got == want
    assert sum(len(t or "") for t in want.values()) < 0.7 * sum(len(t or "") for _, t, *_ in rows)
    assert line_dedup.deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_edited_character(spark):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    lines = ["".join(rng.choice(letters) for _ in range(n)) for n in range(40, 79) for _ in range(3)]
    edits = [x[: len(x) // 2] + "#" + x[len(x) // 2 + 1 :] for x in lines]
    rows = [(0, "\n".join(lines), "en", "s", 0), (1, "\n".join(edits), "en", "s", 0)]
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: (len(lines), 0), 1: (len(lines), len(lines))}


def thue_morse(n, a, b):
    word = a
    other = b
    for _ in range(n):
        word, other = word + other, other + word
    return word


def test_words_that_polynomial_hashes_confuse(spark):
    """Thue-Morse words and their complements have equal polynomial hashes modulo a power of two, whatever the base."""
    x, y = thue_morse(10, "a", "b"), thue_morse(10, "b", "a")
    rng = random.Random(5)
    rest = words(rng, 40)
    rows = [(1, x, "en", "s", 0), (2, y, "en", "s", 0), (3, " ".join([*rest[:20], x, *rest[20:24]]), "en", "s", 0), (4, " ".join([*rest[:20], y, *rest[20:24]]), "en", "s", 0)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (*v, v[1] == i) for i, v in brute(rows).items()} and got[2][2]
    for lane in (0, 7):
        data = np.frombuffer((x + " " + y + " " + x).encode(), np.uint8)
        w, first = sketch.words(data, np.array([0, len(data)]), lane=lane)
        assert w[0] != w[1] and w[0] == w[2] and first.tolist() == [0, 3]


def test_sets_with_one_fingerprint_stay_apart(spark, monkeypatch):
    """Different sets and lines whose first hash is the same are not taken for copies, and are still linked where they are near."""
    plain = minhash_dedup._fingerprint
    monkeypatch.setattr(minhash_dedup, "_fingerprint", lambda v, o, salt=0: plain(v, o, salt) if salt else plain(v, o) % 3)
    rng = random.Random(31)
    base = words(rng, 120)
    texts = [" ".join(base), " ".join(base), " ".join(edited(rng, base, 0.02))] + [" ".join(words(rng, 60)) for _ in range(12)] + ["", None]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)
    monkeypatch.setattr(line_dedup, "_first_hash", lambda: F.pmod(F.xxhash64("line"), F.lit(3)))
    lines = [(i, "\n".join(t.split(" w1")) if t else t, "en", "s", 0) for i, t in enumerate(texts)]
    out = {r.doc_id: r.text for r in line_dedup.deduplicated(spark.createDataFrame(lines, SCHEMA)).collect() if r.text is not None}
    assert out == brute_lines(lines, line_dedup.K, line_dedup.PERCENT)


def test_line_ends_and_case(spark):
    rows = [(0, "A line of some words here\r\nanother line of words\r\n \t\r", "en", "s", 0), (1, "\ta LINE of some words here\nnew words altogether in this", "en", "s", 0)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: (rows[0][1], 2, 0), 1: ("new words altogether in this", 2, 1)}


def test_any_column_names_and_repeated_rows(spark):
    names = "doc_id long, text string, _d int, _h int, _drop int, root int, fp int, n_lines int, _in2 int, first int, count int"
    text = "one two three four five six seven\neight nine ten eleven twelve"
    rows = [(i, t, *range(9)) for i, t in [(1, text), (1, text), (None, text), (None, text), (None, "alone here with no copy at all"), (2, text), (3, None), (4, "")]]
    d = spark.createDataFrame(rows, names)
    near = minhash_dedup.deduplicated(d)
    assert near.columns == d.columns
    assert sorted((str(r.doc_id), r.text or "") for r in near.collect()) == sorted([("1", text), ("None", "alone here with no copy at all"), ("3", ""), ("4", "")])
    lines = line_dedup.deduplicated(d)
    assert set(d.columns) - {"n_lines"} < set(lines.columns) and lines.count() == len(rows)
    kept = [(r.doc_id, r.text) for r in lines.collect()]
    assert kept.count((None, text)) == 2 and kept.count((1, "")) == 2 and (2, "") in kept and (3, None) in kept  # rows equal in id and text are one document


def test_crowded_buckets_are_split_by_pack():
    """Items of a bucket that meet in a pack send one pair there; what comes out links them all."""
    rng = np.random.default_rng(2)
    fp = rng.integers(-(2**62), 2**62, 500)
    keys = rng.integers(0, 2**63, (500, 4), dtype=np.int64).astype(np.uint64)
    keys[:, 0] = 7 << 40  # all share a bucket
    b = neardup.pack(fp, keys, 16)
    home = [neardup._unpacked(x, 1) for x in b.column("home").to_pylist() if x is not None]
    extra = [neardup._unpacked(x, 2) for x in b.column("extra").to_pylist() if x is not None]
    assert sum((k == 7 << 40).sum() for k, _ in home) == 1 and sum(len(k) for k, _ in home) == 1501
    assert {int(x) for _, low, item in extra for x in item} == set(fp.tolist()) and {int(x) for _, low, _ in extra for x in low} == {int(fp.min())}
    assert len({int(p) for p, y in zip(b.column("place").to_pylist(), b.column("extra").to_pylist(), strict=True) if y is not None}) > 8


def test_components_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(common, "EDGES", 50)
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, x) for x in range(1001, 1300)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "u long, v long").repartition(9)).collect()))
    label = common.forest(2300, *np.array(edges).T)
    assert got == {x: int(label[x]) for e in edges if e[0] != e[1] for x in e}


def test_lines_of_one_length_are_sketched_together(monkeypatch):
    """Lines in order of length, all of them once, with the sketches that each has alone; a chunk's rounds are those of its own lines."""
    monkeypatch.setattr(line_dedup, "CHUNK", 300)
    lines = ["".join(chr(97 + (i * j * j) % 26) for j in range(n)) for i, n in enumerate([3, 200, 7, 90, 400, 1, 8, 200, 60])]
    chunks = list(line_dedup._chunks(lines))
    assert sorted(np.concatenate(chunks).tolist()) == list(range(len(lines))) and len(chunks) > 2
    sizes = [len(lines[i]) for c in chunks for i in c]
    assert sizes == sorted(sizes) and not list(line_dedup._chunks([]))
    alone = [sketch.sketch(*line_dedup.shingles([x]), 168)[0] for x in lines]
    for c in chunks:
        assert (sketch.sketch(*line_dedup.shingles([lines[i] for i in c]), 168) == np.stack([alone[i] for i in c])).all()


def test_blank_lines_and_ends(spark):
    """What is a blank at a line's ends, next to characters that look like one."""
    lines = [" ", "\t\x0b", "\x0c", "", " one line ", "\tone line", "one line\r", "\x1fone line", "\u00a0one line", "one line\u00a0", "é ", "É"]
    d = spark.createDataFrame([(1, "\n".join(lines), "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    r = line_dedup._split(d, "doc_id").orderBy("pos").collect()
    assert [x.line for x in r] == [y for y in (x.strip(line_dedup.ENDS).lower() for x in lines) if y]
    assert line_dedup.deduplicated(d).first().n_lines == len(r)
