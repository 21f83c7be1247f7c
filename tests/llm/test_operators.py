"""Operators against brute force, round trips and defined edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelattice.llm import bpe, common, embedding_dedup, mixing, quality_rules, queries, rule_classifier, token_histogram, toxicity, warc_index

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", None, 3), (4, "word " * 40_000, "en", "a", 5), (5, "same text here", "en", "b", 1), (5, "same text here", "en", "b", 1), (None, "no id at all", None, "b", 2), (6, "x" * 50_000, "de", "a", 0),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


# --- quality rules ---------------------------------------------------------------------------------------


def brute_statistics(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen = collections.defaultdict(list)
    for k in range(len(w) - 7):
        seen[tuple(w[k : k + 8])].append(k)
    covered = {p + i for v in seen.values() if len(v) > 1 for p in v for i in range(8)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab cd# éf |".split()) for _ in range(rng.randrange(0, 60))) + "\n" * rng.randrange(3) for _ in range(40)] + ["a b c d e f g h\n" * 4, "l\nl\n l\n\n", "\x0bq\x0cw"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + EDGES
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.statistics(frame(spark, rows)).collect())
    assert got == sorted((str(i), *brute_statistics(t)) for i, t, *_ in rows)


def test_outliers_are_rejected_and_clean_kept(spark):
    rng = random.Random(2)
    clean = [(i, " ".join("w" * rng.randrange(2, 9) + str(rng.randrange(99)) for _ in range(rng.randrange(40, 400))), "en", "s", 0) for i in range(300)]
    junk = [(1000 + i, " ".join("w" * rng.randrange(2, 9) + str(rng.randrange(99)) + "###" for _ in range(100)), "en", "s", 0) for i in range(20)]
    got = {r.doc_id: r.kept for r in quality_rules.scores(frame(spark, clean + junk)).collect()}
    assert not any(got[i] for i, *_ in junk) and sum(got[i] for i, *_ in clean) >= 299


def test_outliers_of_each_statistic_are_rejected(spark):
    rng = random.Random(7)
    word = lambda: "w" * rng.randrange(2, 9) + str(rng.randrange(10**4))
    text = lambda n, f=word, end=" ": end.join(f() for _ in range(n))
    few = [word() for _ in range(6)]
    one = text(30)
    planted = {
        "many words": text(20_000), "long words": text(150, lambda: word() + "v" * 12), "symbols": text(150, lambda: word() + "|" * (rng.random() < 0.25)), "lines": text(150, lambda: rng.choice(few), "\n"), "repeated": " ".join([one] * 8),
    }
    rows = [(i, text(rng.randrange(40, 400)), "en", "s", 0) for i in range(300)] + [(1000 + i, t, "en", "s", 0) for i, t in enumerate(planted.values())]
    got = {r.doc_id: r for r in quality_rules.scores(frame(spark, rows), base_failed=F.lit(False)).collect()}
    assert {name: got[1000 + i].kept for i, name in enumerate(planted)} == dict.fromkeys(planted, False)
    assert sum(got[i].kept for i in range(300)) >= 297
    assert got[1003].n_repeat_words < 0.3 * got[1003].n_words


def brute_mcd(u):
    """Least determinant over the starts, reweighted: (squared distances, determinant), with numpy and sorted distances."""
    q = quality_rules

    def cov(x, factor):
        return np.cov(x.T, bias=True) * factor

    def regular(v):
        t = np.trace(v)
        try:
            least = (np.diag(np.linalg.cholesky(v + 1e-30)) ** 2).min()
        except np.linalg.LinAlgError:
            least = 0
        rho = 1.0 if t <= 1e-12 else 0.0 if least * q.SINGULAR > t else t / (q.CONDITION - 1 + t)
        return (1 - rho) * v + rho * np.eye(5)

    def dist(m, k):
        return np.einsum("ij,jk,ik->i", u - m, np.linalg.inv(k), u - m)

    r = np.maximum(np.sqrt((u * u).sum(1)), 1e-12)[:, None]
    best = None
    for m, v in ((u.mean(0), cov(u, 1)), (np.zeros(5), np.eye(5)), (np.zeros(5), cov(np.tanh(u), 1)), (np.zeros(5), cov(u / r, 1))):
        k, last = regular(v), np.inf
        for _ in range(60):
            bins = np.floor(np.log(np.maximum(dist(m, k), 1e-9)) * q.FINE)
            near = u[bins <= np.sort(bins)[int(np.ceil(q.SHARE * len(u))) - 1]]
            m2, k2 = near.mean(0), regular(cov(near, q.CONSISTENCY))
            if np.linalg.det(k2) >= last * (1 - 1e-9):
                break
            m, k, last = m2, k2, np.linalg.det(k2)
        if best is None or last < best[0] * (1 - 1e-9):
            best = (last, m, k)
    near = u[dist(best[1], best[2]) <= q.WITHIN]
    return dist(near.mean(0), regular(cov(near, q.WITHIN_CONSISTENCY))), best[0]


def vectors(seed):
    """Correlated vectors with a far cluster; the last two statistics are zero in most."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(60, 500))
    turn = np.triu(rng.normal(size=(5, 5))) / 2 + np.eye(5)
    x = rng.normal(size=(n, 5)) @ turn
    if seed % 2:
        x[rng.random(n) < 0.9, 3:] = 0
    way = rng.normal(size=5)
    x[: n // 8] += 9 * way / np.linalg.norm(way) @ turn
    return x


def test_least_determinant_is_that_of_brute_force(spark):
    groups = {f"g{i}": vectors(i) for i in range(6)}
    u = spark.createDataFrame([(g, *map(float, r)) for g, x in groups.items() for r in x], "g string, u0 double, u1 double, u2 double, u3 double, u4 double")
    u = common.staged(u)
    found = quality_rules.least_determinants(u)
    det = {r.g: r.det for r in found.collect()}
    got = collections.defaultdict(list)
    for r in quality_rules._distances(u, quality_rules._reweighted(u, found), "g").collect():
        got[r.g].append(r.d2)
    for g, x in groups.items():
        want, least = brute_mcd(x)
        assert abs(det[g] / least - 1) < 1e-6 and np.allclose(np.sort(got[g]), np.sort(want), rtol=1e-5, atol=1e-8)
        assert (want[: len(x) // 8] > quality_rules.CUT).mean() > 0.9
        plain = np.cov(x.T, bias=True)  # what an estimate from all rows would make of the cluster
        y = x - x.mean(0)
        assert g in ("g1", "g3", "g5") or np.einsum("ij,jk,ik->i", y, np.linalg.inv(plain), y)[: len(x) // 8].mean() < quality_rules.CUT


def test_every_verdict_is_that_of_brute_force(spark):
    rng = random.Random(21)
    rows = []
    for i in range(700):
        junk = rng.random() < 0.1
        w = ["w" * rng.randrange(2, 9) + str(rng.randrange(999)) + ("##" if junk and rng.random() < 0.5 else "") for _ in range(rng.randrange(20, 300))]
        end = "\n" if rng.random() < 0.1 else " "
        rows.append((i, end.join(w), rng.choice(["en", "de", None]), rng.choice(["a", "b", None, "rare"] if i < 60 else ["a", "b", None]), 0))
    got = {r.doc_id: r for r in quality_rules.scores(frame(spark, rows)).collect()}
    by = collections.defaultdict(list)
    for i, t, lang, source, _ in rows:
        n, chars, symbols, dup, again = brute_statistics(t)
        if not got[i].base_failed:
            by[lang, source].append((i, n, chars, symbols, dup, len(t.split("\n")), again))
    middle = lambda x: np.sort(x, axis=0)[(len(x) + 1) // 2 - 1]
    for members in by.values():
        a = np.array(members, float)
        n = a[:, 1]
        usual = middle((a[:, 2] + 1) / n)
        z = np.stack([np.log1p(n), np.log((a[:, 2] + 100 * usual) / (n + 100)), np.log1p(100 * a[:, 3] / n), np.sqrt(a[:, 4] / a[:, 5]), np.sqrt(a[:, 6] / n)], axis=1)
        mad = middle(np.abs(z - middle(z)))
        d, _ = brute_mcd((z - middle(z)) / np.where(mad > 1e-6, mad * 1.4826, 1.0))
        limit = quality_rules.cut(len(a))
        for i, x in zip(a[:, 0].astype(int), d, strict=True):
            assert abs(x / limit - 1) < 1e-6 or got[i].kept == (x <= limit)
    assert len(by) == 12 and min(map(len, by.values())) < 20


def test_quantiles():
    q = quality_rules
    assert abs(q.chi2_cdf(q.chi2_quantile(0.99, 5), 5) - 0.99) < 1e-9 and abs(q.chi2_quantile(0.95, 5) - 11.0705) < 1e-3
    assert abs(q.f_cdf(3.3258, 5, 10) - 0.95) < 1e-4 and abs(q.f_cdf(4.2, 5, 200) - 0.9988) < 5e-4
    assert q.cut(6) == float("inf") and q.cut(20) > q.cut(100) > q.cut(400) > q.CUT == q.cut(401)


def test_quality_edges(spark):
    assert quality_rules.scores(frame(spark, [])).count() == 0
    got = quality_rules.scores(frame(spark, EDGES)).collect()
    assert len(got) == len(EDGES) and all(not r.kept for r in got)


# --- mixing ----------------------------------------------------------------------------------------------


def test_mixing_meets_targets(spark):
    rng = random.Random(4)
    rows = [(i, "w " * int(rng.lognormvariate(4, 1)), "en", rng.choice(["a", "a", "a", "b", "c", "d", None]), 0) for i in range(800)] + EDGES[:2]
    d = mixing.mix(frame(spark, rows)).collect()
    assert len(d) == len(rows)
    by = collections.defaultdict(lambda: [0, 0, 0])
    for r in d:
        assert 0 <= r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        s = by[r.source]
        s[0], s[1], s[2] = s[0] + r.taken, r.target, r.source_size
    assert abs(sum(s[1] for s in by.values()) - sum(s[2] for s in by.values())) < 1e-6 * sum(s[2] for s in by.values())
    for taken, target, size in by.values():
        assert target <= 3 * size + 1e-6 and abs(taken - target) <= 0.02 * target + 20
    again = mixing.mix(frame(spark, rows).repartition(7)).collect()
    assert sorted(map(str, d)) == sorted(map(str, again))


def test_mixed_holds_each_document_as_often_as_it_is_taken(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(0, 90), "en", rng.choice(["a", "a", "b", "c"]), i) for i in range(300)]
    d = frame(spark, rows)
    want = {r.doc_id: r.copies for r in mixing.mix(d).collect() if r.copies}
    out = mixing.mixed(d)
    assert out.columns == d.columns and collections.Counter(r.doc_id for r in out.collect()) == want and max(want.values()) > 1
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1  # what regexp_count is rewritten to


def test_mixing_edges(spark):
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.mixed(frame(spark, [])).columns == ["doc_id", "text", "lang", "source", "n_chars"]
    d = spark.createDataFrame([(1, "a b", "s", 9, 9), (2, None, None, 9, 9)], "doc_id long, text string, source string, size int, lam int")
    got = mixing.mix(d)
    assert got.columns == ["doc_id", "text", "source", "lam", "size", "source_size", "target", "copies", "taken"]
    assert {(r.doc_id, r["size"], r.lam) for r in got.collect()} == {(1, 2, 9), (2, 0, 9)}


# --- encoding --------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return bpe.Bpe(queries.vocabulary())


def texts():
    rng = random.Random(6)
    out = ["", "a", "aaaaaaa " * 5, "<|endoftext|>x <|endoftext|><|endoftext|>", " \n\n  x\x1c\x1d y\x85z\xa0q", "it's we'll I'M 123 ½ ٣ 中文 🎉🎉 é", "a" * 3000, "ab" * 2000, " " * 50, "\r\n\t", "don't 'S 're"]
    kinds = [(1, 300), (32, 127), (32, 127), (0x370, 0xD000), (0x1F300, 0x1F700), (9, 33)]
    return out + ["".join(chr(rng.randrange(*rng.choice(kinds))) for _ in range(rng.randrange(200))) for _ in range(200)]


def test_encoding_is_the_library(model):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    ids = model.encode([*texts(), None])
    for text, got in zip(texts(), ids, strict=False):
        want = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want
        assert model.decode([got])[0] == t.decode(want, skip_special_tokens=False) == text
    assert ids[-1] == b""


def test_broken_bytes_decode_as_the_library(model):
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(queries.vocabulary()), random.Random(8)
    for _ in range(50):
        ids = [rng.randrange(50257) for _ in range(20)]
        assert model.decode([np.array(ids, "<u4").tobytes()])[0] == t.decode(ids, skip_special_tokens=False)


def test_long_text_in_pieces(model, monkeypatch):
    text = " ".join(texts()) * 3
    want = model.encode([text])
    monkeypatch.setattr(bpe, "PIECES", 50)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 100)
    assert model.encode([text, text]) == want * 2


def test_round_trip_query(spark, model):
    got = {str(r.doc_id): r for r in bpe.round_trip(frame(spark, EDGES), model).collect()}
    assert got["1"].n_tokens == 0 and got["1"].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert all(got[str(i)].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t, *_ in EDGES)
    assert bpe.round_trip(frame(spark, []), model).count() == 0


def test_histogram(spark, model):
    h = token_histogram.histogram(token_histogram.lengths(frame(spark, EDGES), model))
    n = [len(x) // 4 for x in model.encode([t for _, t, *_ in EDGES])]
    for r in h.collect():
        k = r.n_tokens
        assert (r.n_docs, r.docs_longer, r.tokens_longer) == (n.count(k), sum(x > k for x in n), sum(x for x in n if x > k))
        assert (r.docs_upto, r.tokens_kept, r.tokens_lost) == (sum(x <= k for x in n), sum(min(x, k) for x in n), sum(max(0, x - k) for x in n))
    asked = (0, 1, 2, 7, 1024, 30_000, 10**6)
    assert {tuple(r) for r in token_histogram.at_limits(h, [*asked, 7]).collect()} == {(k, sum(x > k for x in n), sum(min(x, k) for x in n)) for k in asked}
    shares = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
    assert {tuple(r) for r in token_histogram.quantiles(h, list(shares)).collect()} == {(q, sorted(n)[max(1, int(np.ceil(q * len(n) - 1e-9))) - 1]) for q in shares}
    assert token_histogram.at_limits(h.limit(0), [5]).count() == token_histogram.quantiles(h.limit(0), [0.5]).count() == 0
    assert token_histogram.histogram(token_histogram.lengths(frame(spark, []), model)).count() == 0


# --- classifiers -----------------------------------------------------------------------------------------


def test_rules_separate_held_out(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.8
        w = ["w" + str(rng.randrange(500)) for _ in range(rng.randrange(30, 200))]
        rows.append((i, " ".join(w) + "." if good else " ".join(x + rng.choice(["###", "***"]) for x in w), "en", "s", 0))
        labels.append((i, int(good), 0))
    d, y = frame(spark, rows + EDGES), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = rule_classifier.train(d, y)
    assert 0 < len(m.rules) < 200
    got = rule_classifier.scores(d, m).collect()
    truth = {i: g for i, g, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id > 10]
    assert len(held) > 60 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(rows) + len(EDGES)
    x = rule_classifier.statistics(d).where("doc_id = 20").toPandas()
    assert abs(m.apply(x[list(rule_classifier.STATISTICS)].to_numpy(float))[0] - next(r.score for r in got if r.doc_id == 20)) < 1e-5
    assert rule_classifier.accepted(d, m).columns == d.columns
    assert rule_classifier.scores(d, rule_classifier.train(d, y.limit(0))).select("score").distinct().count() == 1


def test_rejecting_reads_each_text_once(spark):
    rng = random.Random(12)
    rows = [(i, " ".join("w" + str(rng.randrange(500)) + "#" * (i % 2) for _ in range(50)), "en", "s", 0) for i in range(200)] + EDGES
    d = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA + ", _score int")
    y = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(10, 200)], "doc_id long, quality int, toxic int")
    m = rule_classifier.train(d, y)
    kept = rule_classifier.accepted(d, m)
    want = {r.doc_id for r in rule_classifier.scores(d, m).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == d.columns
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2 and "Generate explode(array" in plan  # the filter is above the score, not below the statistics


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="tables are not there")
def test_quality_of_held_out_labels(spark):
    d, y = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = rule_classifier.scores(d, rule_classifier.train(d, y)).join(y.where("quality is not null").dropDuplicates(["doc_id"]), "doc_id").where("held_out")
    r = got.agg(F.count("*"), F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()
    assert r[0] > 500 and r[1] > 0.98


def test_folding():
    assert toxicity.fold("Sсum, 1D10T!") == " scum idiot "  # the second letter is Cyrillic
    assert toxicity.fold("l0ser") == toxicity.fold("LOSER") == " ioser "
    assert toxicity.fold("ﬁne​ly") == toxicity.fold("finely")
    assert toxicity.fold("") == "  "


def test_lexicon(spark):
    rng = random.Random(10)
    rows, labels = [], []
    for i in range(500):
        bad = rng.random() < 0.2
        w = ["w" + rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(rng.randrange(20, 200))]
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["vileword", "nastyterm", "zork" + rng.choice(["a", "b", "c", "d", "e", "f"]) * 3]))
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    tests = [(9001, "some v1lew0rd here", "en", "s", 0), (9002, "NАSTYTERM", "en", "s", 0), (9003, "a zorkqqq", "en", "s", 0), (9004, "clean vilewords", "en", "s", 0)]
    d, y = frame(spark, rows + tests + EDGES), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.scores(d, toxicity.train(d, y)).collect()}
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if got[i].held_out and i > 10]
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    assert [got[9000 + i].predicted for i in (1, 2, 3)] == [1, 1, 1] and got[1].score == 0
    assert toxicity.scores(d, toxicity.train(d, y.limit(0))).agg({"score": "max"}).first()[0] == 0
    lex = toxicity.Lexicon({"kiii": 2.0}, {}, ["kiii switch"], 1.0)
    assert lex.total(lex.automaton(), "kill kill switch")[0] == 2.0


# --- WARC ------------------------------------------------------------------------------------------------


def test_warc(spark):
    big = "<p>" + "x" * 2000
    rows = [(1, "http://a/", big), (2, "http://b/ü\r\n", big), (3, None, big + "é"), (4, "u", None), (5, "u", ""), (6, "u", "s"), (7, "u", "s"), (8, "u", big), (None, "u", big), (9, "u", "WARC/1.1\r\n\r\n")]
    got = {r.page_id: r for r in warc_index.archive_and_read(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        assert got[i].payload_bytes == len((h or "").encode()) and got[i].payload_digest == hashlib.sha1((h or "").encode()).hexdigest()
    assert {i: got[i].refers_to for i in (1, 2, 8, None)} == {1: 8, 2: 8, 8: None, None: 8}
    assert got[6].record_type == got[7].record_type == got[4].record_type == "response" and got[2].record_type == "revisit" and bytes(got[3].payload).decode() == big + "é"
    assert warc_index.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert warc_index.ranges([(0, 10), (10, 5), (100_000, 5)]) == [(0, 2, 0, 15), (2, 3, 100_000, 5)]


def test_warc_ranges_of_several_archives(spark, monkeypatch):
    monkeypatch.setattr(warc_index, "ARCHIVE", 40_000)
    monkeypatch.setattr(warc_index, "READ", 8_000)
    monkeypatch.setattr(warc_index, "TASK", 30_000)
    rng = random.Random(14)
    rows = [(i, f"http://a/{i}", "".join(rng.choice("abcdefgh<>/ ") for _ in range(rng.choice([10, 900, 5000, 30_000])))) for i in range(120)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = common.scratch(spark)
    index = warc_index.write(warc_index.plan(d), folder)
    assert index.select("archive").distinct().count() > 10
    got = {r.page_id: bytes(r.payload).decode() for r in warc_index.read(index, folder).collect()}
    assert got == {i: h for i, _, h in rows}
    some = warc_index.read(index.where("page_id % 7 = 0"), folder)
    assert {r.page_id: bytes(r.payload).decode() for r in some.collect()} == {i: h for i, _, h in rows if i % 7 == 0}
    assert some.rdd.getNumPartitions() > 1


# --- vectors ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("tile", [1024, 20])
def test_vectors(spark, tile, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    rng = np.random.default_rng(11)
    base = rng.normal(size=(12, 16))
    x = [base[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.3]) for _ in range(300)]
    rows = [(i, [float(np.float32(v)) for v in e], int(rng.integers(3))) for i, e in enumerate(x)]
    rows += [(400 + i, rows[0][1], rows[0][2]) for i in range(30)] + [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] + [1.0] * 15, 1), (503, rows[1][1], None), (504, [1.0, 2.0], 1), (505, [1.0, 2.0], 1), (506, [], 1), (507, [None, 1.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    ok = [(i, np.array(e, float), y) for i, e, y in rows if y is not None and e and None not in e and np.isfinite(e).all() and np.any(e)]
    links, root = collections.Counter(), {i: i for i, *_ in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for n, (i, a, y) in enumerate(ok):
        for j, b, z in ok[n + 1 :]:
            if y == z and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.93:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    assert got == {i: (links[i], find(i)) for i, *_ in rows}
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_vectors_that_share_an_id_or_have_names(spark):
    """An id under two labels doesn't join their neighbours; ids may be strings; columns that clash with working names are passed over."""
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [("1", a, 0), ("1", b, 1), ("2", a, 0), ("3", b, 1), ("4", [0.99, 0.01, 0.0], 0), ("5", a, 2)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id string, embedding array<float>, label int, key int, id int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == [("1", 1, "1"), ("1", 2, "1"), ("2", 2, "1"), ("3", 1, "1"), ("4", 2, "1"), ("5", 0, "5")]
    apart = spark.createDataFrame([(1, a, 0), (1, b, 1), (2, a, 0), (0, b, 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r) for r in embedding_dedup.near_duplicates(apart).collect()) == [(0, 1, 0, True), (1, 1, 0, False), (1, 1, 1, True), (2, 1, 1, False)]
