"""Fetching by backends: saved pages offline, and a loopback server for hops, headers, retries and errors."""

import http.server
import threading

import pytest

from pagelattice.sources import fetching


class Site(http.server.BaseHTTPRequestHandler):
    busy = 0

    def do_GET(self):  # noqa: N802
        if self.path.startswith("/hop"):
            n = int(self.path[4:])
            self.send_response(302)
            self.send_header("Location", f"/hop{n - 1}" if n else "/end")
        elif self.path == "/away":
            self.send_response(301)
            self.send_header("Location", "file:///etc/hosts")
        elif self.path == "/busy" and Site.busy < 2:
            Site.busy += 1
            self.send_response(503)
        elif self.path in ("/end", "/busy"):
            self.send_response(200)
            self.send_header("X-Note", "yes")
            self.send_header("Content-Type", "text/html; charset=latin-1")
        else:
            self.send_response(404)
        self.end_headers()
        self.wfile.write("dé".encode("latin-1") if self.path in ("/end", "/busy") else b"")

    def log_message(self, *_):
        pass


@pytest.fixture()
def server():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_http(spark, server):
    paths = ["/end", "/hop1", "/hop9", "/gone", "/busy", "/away"]
    urls = spark.createDataFrame([(server + p,) for p in paths] + [(server + "/end",), (None,), ("http://[bad",)], "url string")
    got = {r.url.removeprefix(server): r for r in fetching.fetched(urls, "http", guard=False, parts=2, wait=0.01, private=True, timeout=5).collect()}
    assert len(got) == 7
    end = got["/end"]
    assert (end.status, end.body, end.headers["x-note"], end.hops, end.error) == (200, "dé", "yes", [], None)
    hop = got["/hop1"]
    assert [(h.url.removeprefix(server), h.status) for h in hop.hops] == [("/hop1", 302), ("/hop0", 302)] and hop.final_url.endswith("/end") and hop.status == 200
    assert got["/hop9"].error == "too many redirects" and got["/gone"].status == 404 and got["/busy"].status == 200 and got["/away"].error == "blocked" and got["http://[bad"].error.startswith("connection")


def test_private_addresses_are_not_fetched(spark, server):
    urls = spark.createDataFrame([(server + "/end",), ("ftp://a.test/",), ("http://localhost/x",)], "url string")
    assert {r.error for r in fetching.fetched(urls, "http", wait=0.01).collect()} == {"blocked"}
    assert [r.error for r in fetching.fetched(urls.limit(1), "http", guard=False, wait=0.01).collect()] == ["blocked"]  # looked up again by the task


def test_offline(spark):
    pages = spark.createDataFrame([("https://a.test/x/", "<p>x</p>"), ("https://a.test/x", "<p>later</p>"), ("https://a.test/n", None), (None, "y")], "url string, html string")
    hops = spark.createDataFrame([("https://a.test/old", "https://a.test/x", 301)], "src string, dst string, status int")
    urls = spark.createDataFrame([(f"https://a.test/{p}",) for p in ("x", "n", "old", "no")] + [("http://10.0.0.1/",)], "url string")
    got = {r.url.rsplit("/", 1)[1]: (r.status, r.body, r.final_url, [tuple(h) for h in r.hops or []], r.error) for r in fetching.fetched(urls, "offline", pages=pages, redirects=hops).collect()}
    assert got == {
        "x": (200, "<p>later</p>", "https://a.test/x", [], None), "n": (200, "", "https://a.test/n", [], None), "old": (200, "<p>later</p>", "https://a.test/x", [("https://a.test/old", 301)], None),
        "no": (404, None, "https://a.test/no", [], "http 404"), "": (None, None, None, [], "blocked"),
    }


def test_unknown_backend(spark):
    with pytest.raises(ValueError, match="offline"):
        fetching.fetched(spark.createDataFrame([], "url string"), "browser")
