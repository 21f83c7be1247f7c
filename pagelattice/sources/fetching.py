"""Fetching the URLs of a table: answers with their hops, by a backend that is chosen by name.

A backend takes a table with a column url and returns ANSWER. ``offline`` serves a table of saved pages by a join; ``http`` fetches in the
tasks, one URL after the other, and checks every hop. URLs that no fetch may reach are answered before any backend sees them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from .files import fetchable

ANSWER = "url string, final_url string, status int, hops array<struct<url: string, status: int>>, headers map<string, string>, body string, error string"
Backend = Callable[[DataFrame], DataFrame]
#: name -> maker of a backend.
BACKENDS: dict[str, Callable[..., Backend]] = {}


def backend(name: str):
    """Register a maker of backends under a name."""

    def put(make):
        BACKENDS[name] = make
        return make

    return put


def _answer(df: DataFrame, **given) -> DataFrame:
    """ANSWER with the given columns, others null."""
    kinds = [c.strip().split(" ", 1) for c in ANSWER.replace("struct<url: string, status: int>", "struct<url:string;status:int>").replace("map<string, string>", "map<string;string>").split(",")]
    return df.select(*((given[n] if n in given else F.lit(None)).cast(k.replace(";", ",")).alias(n) for n, k in kinds))


def fetched(urls: DataFrame, name: str, guard: bool = True, **options) -> DataFrame:
    """The answers to the distinct URLs of a table, by the backend ``name``.

    Null URLs are left out. With ``guard`` a URL that isn't http(s) or names a private address is an error "blocked" and isn't fetched.
    """
    if name not in BACKENDS:
        raise ValueError(f"no backend {name}: {', '.join(sorted(BACKENDS))}")
    all_ = urls.select("url").where("url is not null").distinct()
    get = BACKENDS[name](**options)
    if not guard:
        return get(all_)
    allowed = fetchable(all_)
    blocked = all_.join(allowed, "url", "left_anti")
    return get(allowed).unionByName(_answer(blocked, url=F.col("url"), error=F.lit("blocked")))


@backend("offline")
def offline(pages: DataFrame, redirects: DataFrame | None = None) -> Backend:
    """Serves saved pages (url, html): 200 with the html, 404 for URLs that no page has. ``redirects`` (src, dst, status) are followed for one hop.

    URLs are the same in normal form B; of several pages with one URL the least html is served.
    """

    def get(urls: DataFrame) -> DataFrame:
        saved = pages.where("url is not null").groupBy(U.normal_b(F.col("url")).alias("key")).agg(F.min(F.coalesce("html", F.lit(""))).alias("html"))
        d = urls
        if redirects is None:
            d = d.withColumns({"final": F.col("url"), "hops": F.array().cast("array<struct<url: string, status: int>>")})
        else:
            r = redirects.groupBy(F.col("src").alias("url")).agg(F.min(F.struct("dst", "status")).alias("r"))
            d = d.join(r, "url", "left").select("url", F.coalesce("r.dst", "url").alias("final"), F.when(F.col("r").isNotNull(), F.array(F.struct("url", F.col("r.status").cast("int").alias("status")))).otherwise(F.array()).alias("hops"))
        j = d.join(saved, U.normal_b(F.col("final")) == F.col("key"), "left")
        found = F.col("key").isNotNull()
        return _answer(j, url=F.col("url"), final_url=F.col("final"), status=F.when(found, 200).otherwise(404), hops=F.col("hops"), body=F.col("html"), error=F.when(~found, "http 404"))

    return get


def _private(host: str | None) -> bool:
    """Whether a name leads to a private, loopback or reserved address; a name that leads nowhere doesn't."""
    import ipaddress
    import socket

    try:
        found = {i[4][0] for i in socket.getaddrinfo(host, None)}
    except (OSError, UnicodeError):
        return False
    return any((a := ipaddress.ip_address(x.split("%")[0])).is_private or a.is_loopback or a.is_reserved or a.is_link_local for x in found)


def fetch_one(url: str, most: int, timeout: float, retries: int, wait: float, private: bool) -> tuple:
    """(url, final URL, status, hops, headers, body, error) of one URL; every hop is checked before it is fetched, 429 and 503 are tried again."""
    import http.client
    import time
    import urllib.error
    import urllib.parse
    import urllib.request

    class Stay(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *_):
            return None

    opener = urllib.request.build_opener(Stay)
    at, hops, tried = url, [], 0
    while True:
        if not private and _private(urllib.parse.urlsplit(at).hostname):
            return url, at, None, hops, {}, None, "blocked"
        try:
            with opener.open(urllib.request.Request(at, headers={"User-Agent": "pagelattice"}), timeout=timeout) as r:
                return url, at, r.status, hops, {k.lower(): v for k, v in r.headers.items()}, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"), None
        except urllib.error.HTTPError as e:
            if e.code in (301, 302, 303, 307, 308) and e.headers.get("Location"):
                hops.append({"url": at, "status": e.code})
                at = urllib.parse.urljoin(at, e.headers["Location"])
                if len(hops) > most:
                    return url, at, e.code, hops, {}, None, "too many redirects"
                if urllib.parse.urlsplit(at).scheme not in ("http", "https"):
                    return url, at, e.code, hops, {}, None, "blocked"
                continue
            if e.code in (429, 503) and tried < retries:
                tried += 1
                time.sleep(wait * tried)
                continue
            return url, at, e.code, hops, {k.lower(): v for k, v in e.headers.items()}, None, f"http {e.code}"
        except TimeoutError:
            return url, at, None, hops, {}, None, "timeout"
        except (urllib.error.URLError, ValueError, OSError, http.client.HTTPException) as e:
            return url, at, None, hops, {}, None, f"connection: {e}"[:200]


@backend("http")
def by_http(parts: int = 64, most: int = 5, timeout: float = 15.0, retries: int = 2, wait: float = 3.0, private: bool = False) -> Backend:
    """Fetches URLs in ``parts`` tasks, dealt by host so that a host is asked by one task at a time. private: reach private addresses too (tests)."""
    one = partial(fetch_one, most=most, timeout=timeout, retries=retries, wait=wait, private=private)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["url", "final_url", "status", "hops", "headers", "body", "error"]
        for f in frames:
            for url in f["url"]:
                d = pd.DataFrame([one(url)], columns=names)
                yield d.assign(status=d["status"].astype("Int32"))

    return lambda urls: urls.repartition(parts, U.host(F.col("url"))).mapInPandas(run, ANSWER)


def answer_mix(answers: DataFrame) -> DataFrame:
    """host, outcome (status or error) and the number of URLs."""
    return answers.groupBy(U.host(F.col("url")).alias("host"), F.coalesce(F.col("status").cast("string"), "error").alias("outcome")).agg(F.count("*").alias("urls"), F.sum(F.coalesce(F.length("body"), F.lit(0))).alias("chars"))
