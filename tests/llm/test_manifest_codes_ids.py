"""Files of ids, vector codes and Merkle manifests against brute force, with edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelattice.llm import id_files, merkle, queries, vector_codes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, i long, n long, salt long, bucket string"


def docs_frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 7, 8, 9, "x") for r in rows], DOCS).repartition(parts)


# --- ids in shards ---------------------------------------------------------------------------------------

BLANKS = [chr(c) for c in (*range(9, 14), 0x1C, 0x1F, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


@pytest.fixture(scope="module")
def spec():
    with open(queries.vocabulary(), encoding="utf-8") as f:
        return f.read()


def texts():
    rng = random.Random(3)
    bits = [*BLANKS, " ", " ", " ", "  ", "\n", "a", "bc", "don't", "1", "²", "é", "日本", "_", "...", "<|endoftext|>", "<|end", "​", "é", "😀", "'ll"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(400)] + ["".join(rng.choice([*bits[-12:], " "]) for _ in range(12)) for _ in range(400)] + ["", " ", "word " * 3000, "x" * 30_000, "a b " * 5000 + "c"]


def test_encoder_equals_library(spec, library):
    import pyarrow as pa

    t = texts()
    ids, sizes = id_files.Encoder(spec).encode(pa.array([*t, None]), 2)
    want = [[*e.ids, 2] for e in library.encode_batch(t, add_special_tokens=False)] + [[2]]
    assert sizes.tolist() == list(map(len, want))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want


def test_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (1, 2, 63, 1000, 20_000):
        a, b = rng.integers(0, 2**64, (2, n), dtype=np.uint64)
        a[: n // 3] = a[0]  # the second hash tells these apart
        sizes, bits, slot = id_files.build(a, b)
        assert sorted(slot) == list(range(n))
        assert (id_files.slots(a, b, sizes, bits) == slot).all()


@pytest.fixture()
def small_shards(spark, monkeypatch):
    monkeypatch.setattr(id_files, "TOGETHER", 2_000)
    monkeypatch.setattr(id_files, "SHARD", 1_500)
    monkeypatch.setattr(id_files, "KEYS", 8)
    monkeypatch.setattr(id_files, "READ", 700)
    monkeypatch.setattr(id_files, "TASK", 9_000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ids_of_all_documents_are_read_back(spark, spec, library, small_shards):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(40))), "en", "a", 0) for i in rng.sample(range(10**6), 200)]
    rows += [(77, f"copy {k % 3}", "en", "a", 0) for k in range(120)] + [(None, "no id", None, None, None), (None, None, None, None, None), (-5, None, "en", "a", 0), (-6, "", "en", "a", 0)]
    docs = docs_frame(spark, rows)
    files = id_files.stored(docs, spec, 2)
    shards = files.shards.collect()
    assert len(shards) > 5 and sum(s.docs for s in shards) == len(rows)
    got = sorted(((r.start, r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.n_tokens) for r in id_files.read(files, docs).collect()), key=lambda r: r[0])
    assert [r[1] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    assert [r[0] for r in got] == np.cumsum([0, *(r[3] for r in got[:-1])]).tolist()
    want = sorted((str(i), [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t, *_ in rows)
    assert sorted((str(r[1]), r[2]) for r in got) == want


def test_keyed_reads(spark, spec, library, small_shards):
    rows = [(i, f"text number {i}", "en", "a", 0) for i in range(300)] + [(500, f"again {k}", "en", "a", 0) for k in range(90)]
    files = id_files.stored(docs_frame(spark, rows), spec, 2)
    keys = spark.createDataFrame([(i,) for i in (3, 3, 299, 500, 10**9, -1)] + [(k,) for k in range(1000, 4000)], "doc_id long")
    got = sorted((r.doc_id, library.decode(np.frombuffer(r.ids, "<u4")[:-1].tolist())) for r in id_files.read(files, keys).collect())
    assert got == sorted((i, t) for i, t, *_ in rows if i in (3, 299, 500))
    names = docs_frame(spark, rows).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    files = id_files.stored(names, spec, 2)
    assert id_files.read(files, names.where("doc_id = 'd7'")).count() == 1


def test_ids_of_empty_table(spark, spec):
    docs = docs_frame(spark, []).where("false")
    files = id_files.stored(docs, spec, 2)
    assert id_files.read(files, docs).count() == 0


# --- vector codes ----------------------------------------------------------------------------------------


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, lab, np.floor(np.array(v, np.float64) * 256).astype(np.int64).reshape(parts, -1)) for i, lab, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))[:entries]
    books = np.stack([x for _, _, x in first]).transpose(1, 0, 2).copy()
    x = np.stack([x for _, _, x in kept])

    def assign():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        return d.argmin(-1), d.min(-1).sum(-1)

    for _ in range(rounds):
        code, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                if (m := code[:, p] == e).any():
                    books[p, e] = x[m, p].sum(0) // m.sum()
    code, error = assign()
    return sorted((str(i), str(lab), bytes(c.tolist()), int(e)) for (i, lab, _), c, e in zip(kept, code, error, strict=True)), books


def vectors(n, seed=1, dim=64, step=None):
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 0.2, (n, dim)).astype(np.float32)
    return (np.round(v / step) * step).astype(np.float32) if step else v


@pytest.mark.parametrize(("n", "dim", "step"), [(700, 64, None), (700, 64, 0.25), (40, 32, None), (900, 16, 0.1), (65, 64, 1.0)])
def test_codes_equal_brute_force(spark, n, dim, step, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 256)
    rows = [(i, i % 3 if i % 7 else None, v.tolist()) for i, v in enumerate(vectors(n, dim=dim, step=step))]
    rows += [(9000, 1, None), (9001, 1, [float("nan")] * dim), (9002, None, [None] * dim), (-3, 2, [float("inf")] * dim), (n - 1, 1, rows[-1][2])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label int, embedding array<float>, code int").repartition(3)
    codes, books = vector_codes.compressed(df)
    want, want_books = brute_codes(rows)
    assert sorted((str(r.vec_id), str(r.label), bytes(r.code), r.error) for r in codes.collect()) == want
    assert (books == want_books).all()
    sums = {}
    for _, lab, _, e in want:
        sums[lab] = sums.get(lab, 0) + e
    assert {(str(r.label), r.label_error) for r in vector_codes.with_label_errors(codes).collect()} == set(sums.items())


def test_codes_of_empty_and_odd_tables(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert vector_codes.with_label_errors(vector_codes.compressed(df)[0]).count() == 0
    odd = spark.createDataFrame([(1, None, [0.5] * 16), (2, None, [0.5] * 15), (3, 1, []), (None, 1, [0.25] * 16), (4, 1, [1e9] * 16)], "vec_id long, label int, embedding array<float>")
    assert sorted(str(r.vec_id) for r in vector_codes.compressed(odd)[0].collect()) == ["1", "None"]


def test_subtrees_are_assigned_at_once():
    x = np.floor(vectors(4096, dim=4) * 256).astype(np.int64)
    tree = vector_codes.Tree(x)
    found = list(tree.filtered(x, np.array([[-130] * 4, [0] * 4, [130] * 4])))
    ends = [e - b for b, e, _, _ in found[:-1]]
    assert sum(map(np.sum, ends)) > len(x) / 2 and max(map(np.max, ends)) > vector_codes.LEAF
    assert sum(int((e - b).sum()) for b, e, _, _ in found) == len(x)


# --- Merkle manifests ------------------------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row, more=0):
    i, text, lang, source, n = row
    fields = (i, source, lang, n + more if n is not None else None, text)
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def brute_climb(nodes):
    """Root, and siblings and sides of each node level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            paths[k].append((i & 1, nodes[i ^ 1] if i ^ 1 < len(nodes) else None))
        nodes, at = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)], [i // 2 for i in at]
    return nodes[0], paths


def brute_manifest(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))
        trees[lang] = (own, *brute_climb([brute_leaf(r) for r in own]))
    root, tops = brute_climb([trees[x][1] for x in langs])
    out = []
    for lang, top in zip(langs, tops, strict=True):
        own, sub, paths = trees[lang]
        for r, path in zip(own, paths, strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            got = brute_leaf(r, int(hit))
            for right, s in path + top:
                got = digest(s, got) if right else digest(got, s or "")
            out.append((str(r[0]), brute_leaf(r), sub, root, digest(*(s for _, s in path + top if s)), got, got == root))
    return sorted(out)


@pytest.mark.parametrize("bits", [1, 2, 3, 5, 12])
def test_manifest_equals_brute_force(spark, bits, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE", 40)
    rng = random.Random(bits)
    rows = [(i, f"text é {i}", rng.choice(["en", "en", "en", "de", "ß"]), rng.choice("ab"), i % 9) for i in range(150)]
    rows += [(7, "text", "en", "a", 1)] * 30 + [(None, "x", "en", "a", 1), (None, None, None, None, None), (5, "", None, "", None), (6, "y" * 100_000, "one", None, -4), (200, "a", "two", "b", 1), (201, "b", "two", "b", 1)]
    got = merkle.proved(docs_frame(spark, rows), merkle.tampered(F.col("doc_id")), bits=bits)
    assert sorted((str(r.doc_id), *r[1:]) for r in got.collect()) == brute_manifest(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 9, 31, 64])
@pytest.mark.parametrize("step", [1, 2, 4])
def test_fractal_paths(n, step):
    leaf = [hashlib.sha256(str(i).encode()).hexdigest().encode() for i in range(n)]
    levels = merkle.height(n)
    root, want = brute_climb([x.decode() for x in leaf])
    got = list(merkle.paths(leaf, levels, step))
    assert [[s and s.decode() for s in p] for p in got] == [[s for _, s in p] for p in want]
    assert merkle.root_of(leaf, levels).decode() == root
    assert all(merkle.fold(leaf[i], i, p).decode() == root for i, p in enumerate(got))


def test_manifest_of_empty_table_and_siblings(spark):
    assert merkle.proved(docs_frame(spark, []).where("false"), F.lit(True)).count() == 0
    rows = [(i, "t", "en", "a", 1) for i in range(5)] + [(9, "t", "de", "a", 1)]
    got = {r.doc_id: r for r in merkle.proved(docs_frame(spark, rows), F.lit(False), with_paths=True).collect()}
    assert [s is None for s in got[4].siblings] == [True, True, False, False] and got[9].siblings == [got[0].subroot]
    assert all(r.verified for r in got.values())
