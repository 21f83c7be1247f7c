"""Files as tables, fetch guards and sinks."""

from pagelattice.sources import files, sinks


def test_backlink_csv(spark, tmp_path):
    (tmp_path / "b.csv").write_text("﻿Referring URL,Link URL,Anchor Text,Type,Domain Rating\nhttps://www.wired.test/a,https://t.test/,x,dofollow,130\nhttps://b.test/,https://t.test/,,nofollow,\n", encoding="utf-8")
    got = {r.source_domain: (r.follow, r.dr, r.anchor, r.tld) for r in files.backlink_csv(spark, str(tmp_path / "b.csv")).collect()}
    assert got == {"wired.test": (True, 100.0, "x", ".test"), "b.test": (False, 0.0, "", ".test")}


def test_html_folder(spark, tmp_path):
    (tmp_path / "a.html").write_text("<html>ä</html>", encoding="utf-8")
    (tmp_path / "b.txt").write_text("no", encoding="utf-8")
    assert [r.html for r in files.html_pages(spark, str(tmp_path)).collect()] == ["<html>ä</html>"]


def test_fetchable(spark):
    urls = ["https://a.test/", "http://127.0.0.1/x", "http://user@10.0.0.1/", "http://[::1]/", "ftp://a.test", "http://172.20.1.1", "http://172.40.1.1", "http://localhost:80/"]
    d = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url for r in files.fetchable(d).collect()} == {"https://a.test/", "http://172.40.1.1"}


def test_crawl_source_reports_errors(spark):
    spark.dataSource.register(files.CrawlSource)
    r = spark.read.format("crawl").option("urls", "nonsense|http://[bad").option("retries", 0).load().collect()
    assert len(r) == 2 and all(x.error for x in r)


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("<a>", 1)], "line string, n int")
    sinks.json_rows(d, str(tmp_path / "j"))
    sinks.lines(d, str(tmp_path / "l"))
    sinks.report({"summary": d}, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r/summary")).count() == 1
    assert spark.read.text(str(tmp_path / "j")).first().value == '{"line":"<a>","n":1}'
    assert "&lt;a&gt;" in sinks.dashboard(d, d)
