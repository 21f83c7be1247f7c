"""Merged signatures against exact Jaccard similarities, uniqueness of templates by hand, sketches within their bound."""

import random

from pyspark.sql import functions as F

from pagelattice.operators import documents, rollups


def word(i):
    return "".join(chr(97 + int(c)) for c in f"{i:05}")


def texts(rng):
    base = [" ".join(word(rng.randrange(300)) for _ in range(30)) for _ in range(60)]
    rows = []
    for s, share in (("a", 1.0), ("b", 0.7), ("c", 0.3), ("d", 0.0)):
        rows += [(s, t if rng.random() < share else " ".join(word(rng.randrange(300, 9000)) for _ in range(30))) for t in base]
    return [(i, s, t) for i, (s, t) in enumerate(rows)] + [(900, "a", None), (901, None, "x y z"), (902, "e", "1 2"), (903, "f", "p q")]


def shingles(t):
    w = [x for x in (t or "").split() if x.isalpha()]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_similarity_of_groups(spark):
    rows = texts(random.Random(1))
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    sets = {}
    for _, s, t in rows:
        sets.setdefault(s, set()).update(shingles(t))
    got = {(r.a, r.b): r.similarity for r in rollups.group_similarity(df, F.col("source")).collect()}
    for a in "abcdf":
        for b in "abcdf":
            if a < b:
                assert abs(got.get((a, b), 0.0) - len(sets[a] & sets[b]) / len(sets[a] | sets[b])) < 0.125
    assert got["a", "b"] > got["a", "c"] > 0.05 and ("a", "e") not in got
    merged = {r.by: (r.docs, r.sig) for r in rollups.merged_signatures(df, F.col("source"), n=20).collect()}
    assert {k: v[0] for k, v in merged.items()} == {"a": 60, "b": 60, "c": 60, "d": 60, "f": 1, None: 1}
    one = {r.doc_id: r.sig for r in documents.signatures(df.where("source = 'a' and text is not null"), n=20).collect()}
    assert merged["a"][1] == [min(s[i] for s in one.values()) for i in range(20)]


PAGES = [
    (1, "https://a.test/x/1", "one two three four five six seven"), (2, "https://a.test/x/2", "one two three four five six other"), (3, "https://a.test/x/3", " ".join(word(i) for i in range(400))), (4, "https://a.test/x/4", None),
    (5, "https://a.test/y/1", "alpha beta"), (6, "https://b.test/x/1", "one two three four five six seven"), (7, "https://b.test/x/2", "one two three four five six seven"), (8, "https://b.test/x/3", "1 2 3"),
]


def test_uniqueness_of_templates(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("source", F.lit(1))
    got = {r.pattern: tuple(r)[1:] for r in rollups.template_uniqueness(df).collect()}
    # pages 1 and 2 have three shingles, one of them their own; page 3 has 396, all its own; page 4 has none
    assert got == {"a.test/x/*": (4, 103.5, 400, 398, round((1 / 3 + 1 / 3 + 1) / 3, 4), "warn"), "b.test/x/*": (3, 5.7, 3, 0, 0.0, "stop")}
    assert rollups.template_uniqueness(df.limit(0)).count() == 0


def test_vocabulary_by_site_and_template(spark):
    rng = random.Random(2)
    many = [(100 + i, f"https://c.test/z/{i}", " ".join(word(rng.randrange(90_000)) for _ in range(400))) for i in range(40)]
    df = spark.createDataFrame(PAGES + many, "page_id long, url string, html string").repartition(4)
    got = {(r.site, r.pattern): (r.shingles, r.distinct_shingles) for r in rollups.vocabulary_rollup(df).collect()}
    assert got["a.test", "a.test/x/*"] == (402, 400) and got["a.test", None] == (403, 401) and got["b.test", None] == (6, 3)
    exact = len({s for _, _, t in many for s in shingles(t)})
    assert got["c.test", None][0] == 40 * 396 and abs(got["c.test", None][1] / exact - 1) < 0.05


def test_template_audit_by_hand(spark):
    chrome = " ".join(word(i) for i in range(100))
    page = lambda i, t, own, links="": (i, f"https://a.test/x/{i}", f"<title>{t}</title><link rel=canonical href='https://a.test/x/{i}'><h1>{t}</h1><p>{chrome} {own}</p>{links}")
    own = lambda i: " ".join(word(1000 * i + k) for k in range(400))
    rows = [page(1, "one", own(1), "<a href='/x/2'>2</a>"), page(2, "two", own(2), "<a href='/x/1'>1</a>"), page(3, "two", "", "<a href='/x/3'>self</a>"), (4, "https://a.test/x/4", None), (5, "https://b.test/only", "<p>x</p>")]
    got = {r.pattern: r for r in rollups.template_audit(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    r = got["a.test/x/*"]
    # three of four pages share the chrome, which makes it no boilerplate; page 4 is empty and so stopped; titles are one, two and none
    assert set(got) == {"a.test/x/*"} and (r.pages, r.thin, r.titles, r.hard_stop, r.warned, r.described, r.headed, r.without_canonical, r.cross_linked) == (4, 2, 3, 1, 0, 0, 3, 1, 2)
    assert (r.critical, r.warnings, r.risk) == (2, 5, "high")
    site = rollups.site_audit(spark.createDataFrame(rows, "page_id long, url string, html string")).first()
    assert (site.site, site.groups, site.critical, site.risk) == ("a.test", 1, 2, "high")
