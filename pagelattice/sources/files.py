"""Files as tables: saved HTML, text, CSV exports of backlinks, findings JSON, XML sitemaps; and a data source for live fetches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Names that exports use for a column, in order of preference.
ALIASES = {
    "source_url": ("source_url", "referring_url", "from_url", "url_from", "source"), "target_url": ("target_url", "link_url", "to_url", "url_to", "target"), "anchor": ("anchor", "anchor_text", "link_anchor"),
    "follow": ("follow", "dofollow", "is_follow", "type"), "dr": ("dr", "domain_rating", "domain_authority", "da"),
}


def html_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Saved pages, one file each: url (the file's place), html."""
    t = spark.read.option("wholetext", True).option("pathGlobFilter", "*.{html,htm}").option("recursiveFileLookup", True).text(folder)
    return t.select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def fixtures(spark: SparkSession, folder: str, pattern: str = r"(\d+)") -> DataFrame:
    """Text files keyed by a number in their names: eval_id, text."""
    t = spark.read.option("wholetext", True).text(folder)
    return t.select(F.regexp_extract("_metadata.file_name", pattern, 1).cast("long").alias("eval_id"), F.col("value").alias("text"))


def is_html(text):
    return F.lower(text).contains("<html") | F.lower(text).contains("<body")


def json_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def sitemap_xml(spark: SparkSession, path: str) -> DataFrame:
    """url rows of an XML sitemap by the built-in reader."""
    return spark.read.format("xml").option("rowTag", "url").option("ignoreNamespace", True).load(path)


def backlink_csv(spark: SparkSession, path: str) -> DataFrame:
    """An export as the profile table of the backlink operators.

    Headers may start with a byte-order mark, differ in case and have blanks; a column is taken from the first
    alias that is present, also if it is empty. Ratings are clamped to 0..100; www. is no part of a domain.
    """
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*(c.replace("﻿", "").strip().lower().replace(" ", "_") for c in raw.columns))
    pick = lambda name: next((F.col(a) for a in ALIASES[name] if a in raw.columns), F.lit(None).cast("string"))
    host = F.regexp_replace(F.lower(F.regexp_extract(pick("source_url"), "^[a-zA-Z]+://([^/?#:]+)", 1)), r"^www\.", "")
    rating = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(pick("dr").try_cast("double"), F.lit(0.0))))
    follow = F.lower(F.trim(F.coalesce(pick("follow"), F.lit("true")))).isin("true", "1", "yes", "follow", "dofollow", "y")
    return raw.select(F.monotonically_increasing_id().alias("seq"), pick("source_url").alias("source_url"), host.alias("source_domain"), pick("target_url").alias("target_url"), F.coalesce(pick("anchor"), F.lit("")).alias("anchor"), follow.alias("follow"), rating.alias("dr"), F.regexp_extract(host, r"(\.[a-z0-9-]+)$", 1).alias("tld"))


#: Literal addresses that a fetch must not reach.
PRIVATE = r"^(?:localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|0\.|\[?::1\]?|\[?f[cd][0-9a-f]{2}:)"


def fetchable(urls: DataFrame) -> DataFrame:
    """http(s) URLs whose host is no private literal address; names are checked again by whoever resolves them."""
    host = F.lower(F.regexp_extract("url", r"^https?://(?:[^@/]*@)?(\[[^\]]+\]|[^/:?#]+)", 1))
    return urls.where((host != "") & ~host.rlike(PRIVATE))


class _Part(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class CrawlReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = [u for u in options.get("urls", "").split("|") if u]
        self.parts, self.timeout, self.retries = int(options.get("parts", 4)), float(options.get("timeout", 15)), int(options.get("retries", 2))

    def partitions(self):
        return [_Part(self.urls[i :: self.parts]) for i in range(min(self.parts, max(1, len(self.urls))))]

    def read(self, part):
        import time
        import urllib.error
        import urllib.request

        for url in part.urls:
            for attempt in range(self.retries + 1):
                status, final, body, error = None, None, None, None
                try:
                    with urllib.request.urlopen(url, timeout=self.timeout) as r:
                        status, final, body = r.status, r.geturl(), r.read().decode("utf-8", "replace")
                except urllib.error.HTTPError as e:
                    status, final, error = e.code, url, f"http {e.code}"
                except TimeoutError:
                    error = "timeout"
                except (urllib.error.URLError, ValueError) as e:
                    error = f"connection: {e}"[:200]
                if error is None or status not in (None, 429, 503) or attempt == self.retries:
                    break
                time.sleep(3 * (attempt + 1))
            yield (url, final, status, body, error)


class CrawlSource(DataSource):
    """spark.read.format("crawl").option("urls", "a|b") -> url, final_url, status, body, error; register with spark.dataSource.register(CrawlSource)."""

    @classmethod
    def name(cls):
        return "crawl"

    def schema(self):
        return "url string, final_url string, status int, body string, error string"

    def reader(self, schema):
        return CrawlReader(self.options)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
