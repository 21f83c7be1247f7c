"""Least values of groups, examples by class of targets, and crawls with budgets against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from pagelattice.operators import links
from pagelattice.plans import least


@pytest.mark.parametrize("held", [3, 100_000])
def test_least_k(spark, held, monkeypatch):
    monkeypatch.setattr(least, "HELD", held)
    rng = random.Random(1)
    rows = [("hot", None, rng.randrange(10**6)) for _ in range(3000)] + [(rng.choice("abc"), rng.choice([1, 2, None]), rng.choice([None, 5, 5, rng.randrange(100)])) for _ in range(200)] + [(None, 3, 7), ("void", 1, None)]
    df = spark.createDataFrame(rows, "k string, j int, v long").repartition(7)
    got = {(r.k, r.j): (r.n, r.least) for r in least.least_k(df, ["k", "j"], "v", 4).collect()}
    want = {}
    for k, j, v in rows:
        n, vs = want.get((k, j), (0, []))
        want[k, j] = (n + 1, vs if v is None else sorted([*vs, v])[:4])
    assert got == want
    assert least.least_k(df.limit(0), ["k", "j"], "v", 4).count() == 0


def site(spark, n=40):
    """Pages of one site that all link to one target, and to some others."""
    rng = random.Random(2)
    body = lambda i: "".join(f'<a href="/{t}">{t}</a>' for t in ["hot", f"p{rng.randrange(n)}", f"gone{rng.randrange(5)}"])
    return spark.createDataFrame([(i, f"https://a.test/p{i}", f"<title>{'Page not found' if i == 3 else 't'}</title>" + body(i)) for i in range(n)], "page_id long, url string, html string")


def test_examples_of_a_hot_target(spark):
    pages = site(spark)
    got = {r.target: (r["class"], r.linking_pages, r.examples) for r in links.linked_pages(pages).collect()}
    assert got["https://a.test/hot"] == ("missing", 40, "0,1,2,3,4")
    e = links.edges(pages).collect()
    for t, (kind, n, examples) in got.items():
        by = sorted({r.page_id for r in e if r.target == t})
        assert (n, examples) == (len(by), ",".join(map(str, by[:5])))
        assert kind == ("soft_404" if t.endswith("/p3") else "crawled" if "/p" in t else "missing")
    plan = links.linked_pages(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [row_number() windowspecdefinition(target" not in plan
    broken = {r.target: (r.linking_pages, r.examples) for r in links.broken_targets(pages).collect()}
    assert broken == {t: v[1:] for t, v in got.items() if v[0] == "missing"}


def test_classes_of_answers(spark):
    pages = site(spark)
    answers = [("https://a.test/hot", 404, None, "https://a.test/hot"), ("https://a.test/gone1", 503, None, "https://a.test/gone1"), ("https://a.test/gone2", 200, "No results found", "https://a.test/gone2"), ("https://a.test/gone3/", 200, "x", "https://a.test/p1"), ("https://a.test/gone4", 200, "x", "https://a.test/gone4/")]
    got = {r["class"]: r.target.rsplit("/", 1)[1] for r in links.linked_statuses(pages, spark.createDataFrame(answers, "url string, status int, title string, final_url string")).collect()}
    assert got == {"broken": "hot", "server_error": "gone1", "soft_404": "gone2", "redirected": "gone3"}


def brute_crawl(edges, seeds, depth, most, rank):
    seen, new, d = {}, sorted(seeds), 0
    while new and (depth is None or d <= depth):
        taken, by = [], {}
        for x in new:
            by.setdefault(x.split("/")[2], []).append(x)
        for host, xs in by.items():
            room = len(xs) if most is None else max(0, most - sum(x.split("/")[2] == host for x in seen))
            taken += sorted(xs, key=lambda x: (rank[x], x))[:room]
        seen |= dict.fromkeys(taken, d)
        new = sorted({b for a, b in edges if a in set(taken)} - set(seen))
        d += 1
    return seen


@pytest.mark.parametrize(("depth", "most"), [(3, 7), (2, 25), (None, 12), (None, None), (0, 1), (5, 0)])
def test_crawl_with_budgets(spark, depth, most, monkeypatch):
    monkeypatch.setattr(links, "RANKS", 4)
    rng = random.Random(4)
    node = lambda h, i: f"https://{h}.test/{i}"
    edges = [(node(h, rng.randrange(60)), node(h, rng.randrange(60))) for h in "abc" for _ in range({"a": 150, "b": 60, "c": 3}[h])] + [(node("a", 0), node("a", i)) for i in range(30)] + [(None, node("a", 1))]
    seeds = [node("a", 0), node("b", 1), node("b", 2), node("none", 0)]
    e = spark.createDataFrame(edges, "src string, dst string")
    s = spark.createDataFrame([(x,) for x in seeds] + [(None,), (seeds[0],)], "node string")
    nodes = sorted({x for p in edges for x in p if x} | set(seeds))
    ranks = {r.node: r.r for r in spark.createDataFrame([(x,) for x in nodes], "node string").select("node", links.rank_of(F.col("node")).alias("r")).collect()}
    got = {r.node: r.depth for r in links.crawl(e, s, depth, most).collect()}
    assert got == brute_crawl([p for p in edges if p[0]], seeds, depth, most, ranks)
    if depth is None and most is None:
        assert got == {r.node: r.depth for r in links.reach(e.where("src is not null"), s.where("node is not null"), None).collect()}
