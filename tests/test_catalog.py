"""Every catalog query against its SQL on the smallest tables, and rule by rule facts that SQL doesn't cover."""

import os

import duckdb
import pytest

from pagelattice import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(frame):
    cols = sorted(frame.columns)
    f = frame[cols].astype(object)
    f = f.where(f.notna(), None)
    # one engine gives dates as dates, the other as time stamps at midnight
    plain = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).removesuffix(" 00:00:00") if hasattr(v, "isoformat") else v
    return cols, sorted(map(repr, f.map(plain).itertuples(index=False, name=None)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not there")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(catalog.ORACLES[name]).df())


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not there")
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).columns


def test_verified_findings(spark):
    got = {r.key: (r.severity, r.merged, r.sources) for r in catalog.QUERIES["verify_findings"](spark, "").collect()}
    assert got["missing-required:security"] == ("Critical", 2, "a,b")  # a key ends at the first full stop
    assert got["community-profile-missing:code of conduct"] == ("Critical", 2, "a,b")
    assert not any("no code examples" in k for k in got)


def test_schema_findings(spark):
    got = {(r.page_id, r.code) for r in catalog.QUERIES["schema_findings"](spark, "").collect()}
    assert {(3, "placeholder"), (3, "type_restricted"), (4, "invalid_json"), (4, "context_missing"), (4, "type_no_rich_result"), (5, "type_retired")} <= got
    scores = {r.page_id: r.score for r in catalog.QUERIES["schema_scores"](spark, "").collect()}
    assert scores[1] == 55 and scores[5] == 80 and scores[6] == 55


def test_entities(spark):
    got = {(r.page_id, r.platform) for r in catalog.QUERIES["same_as_platforms"](spark, "").collect()}
    assert got == {(1, "wikidata"), (1, "linkedin"), (1, "x"), (3, "wikipedia"), (3, "twitter"), (3, "crunchbase")}
    assert all(0 <= r.score <= 100 for r in catalog.QUERIES["entity_scores"](spark, "").collect())


def test_reach_goes_as_deep_as_links_lead(spark, tmp_path):
    page = lambda i: (i, f"https://a.example/p{i}", f'<html><body><a href="/p{(i + 1) % 8}">next</a></body></html>')
    spark.createDataFrame([page(i) for i in range(8)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert sorted(map(tuple, catalog.QUERIES["reach_depth"](spark, str(tmp_path)).collect())) == [(d, 1) for d in range(8)]
