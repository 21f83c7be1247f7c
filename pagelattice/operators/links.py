"""The link graph: edges, degrees, orphans, dead ends, reach, redirect and canonical chains, URL hygiene, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions import urls as U
from ..plans import dims
from ..plans.least import least_k
from ..plans.stage import staged

SKIP = r"(?i)^(#|javascript:|mailto:|tel:|data:)"


def raw_links(pages: DataFrame) -> DataFrame:
    """Every a element with an href that navigates: page_id, host, pos, url (resolved), anchor (at most 80 characters), nofollow, internal.

    The page is cut where an a element begins, so that tag and text of a link are of one piece: an element that
    isn't closed ends where the next one begins and shifts no other link's text.
    """
    pieces = F.slice(F.split(F.coalesce("html", F.lit("")), r"(?i)<a\s", -1), 2, 1 << 30)
    # what links need of the page's URL is made once a page
    own = pages.select("page_id", U.base_parts(F.col("url")).alias("b"), U.host(F.col("url")).alias("host"), pieces.alias("pieces"))
    p = own.select("page_id", "b", "host", F.posexplode_outer("pieces").alias("pos", "piece")).where(F.col("piece").contains(">"))
    p = p.withColumns({"t": F.regexp_extract("piece", "^([^>]*)>", 1), "inner": F.regexp_extract("piece", r"(?is)^[^>]*>(.*?)(?:</a|\z)", 1)})
    href = F.trim(H.attr(F.col("t"), "href"))
    p = p.withColumn("href", href).where(F.col("href").isNotNull() & (F.col("href") != "") & ~F.col("href").rlike(SKIP))
    target = U.resolve_from(F.col("b"), F.col("href"))
    anchor = F.substring(H.squeeze(H.decode(F.regexp_replace("inner", "<[^>]*>", " "))), 1, 80)
    p = p.select("page_id", "pos", "host", target.alias("target"), F.when(anchor == "", "[no text]").otherwise(anchor).alias("anchor"), F.array_contains(F.split(F.lower(F.coalesce(H.attr(F.col("t"), "rel"), F.lit(""))), r"\s+"), "nofollow").alias("nofollow"))
    return p.where(U.scheme(F.col("target")).isin("http", "https")).withColumn("internal", U.host(F.col("target")) == F.col("host"))


def edges(pages: DataFrame) -> DataFrame:
    """Internal links, the first one of a page to a target: page_id, host, target (normal form B), anchor, nofollow."""
    e = raw_links(pages).where("internal").withColumn("target", U.normal_b(F.col("target")))
    first = F.row_number().over(W.partitionBy("page_id", "target").orderBy("pos"))
    return e.withColumn("rn", first).where("rn = 1").select("page_id", "host", "target", "anchor", "nofollow")


def links_with_subdomains(pages: DataFrame) -> DataFrame:
    """Number of all links of a page, repeats counted, to its own host or a subdomain of it (internal) and to other hosts."""
    r = raw_links(pages)
    own = (U.host(F.col("target")) == F.col("host")) | F.endswith(U.host(F.col("target")), F.concat(F.lit("."), F.col("host")))
    return r.groupBy("page_id").agg(F.count_if(own).alias("internal_links"), F.count_if(~own).alias("external_links"))


def links_by_absolute_url(pages: DataFrame) -> DataFrame:
    """Links of a page, each absolute URL once with query and fragment, at its first place: page_id, pos, target."""
    return raw_links(pages).groupBy("page_id", "target").agg(F.min("pos").alias("pos"))


def link_set(pages: DataFrame) -> DataFrame:
    """Internal URLs of a host without fragments, whatever page links to them: host, target."""
    return raw_links(pages).where("internal").select("host", F.regexp_replace("target", "#.*$", "").alias("target")).distinct()


def anchor_top(pages: DataFrame, k: int = 20) -> DataFrame:
    g = edges(pages).where("anchor <> '[no text]'").groupBy("anchor").agg(F.count("*").alias("links"))
    return g.orderBy(F.col("links").desc(), "anchor").limit(k)


def out_degree_stats(pages: DataFrame) -> DataFrame:
    d = pages.select("page_id").join(edges(pages).groupBy("page_id").agg(F.count("*").alias("n")), "page_id", "left").na.fill(0, ["n"])
    return d.agg(F.min("n").alias("min_links"), F.max("n").alias("max_links"), T.rounded(F.avg("n"), 1).alias("avg_links"), F.count_if(F.col("n") < 3).alias("few_links"), F.count_if(F.col("n") > 100).alias("many_links"))


def degrees(pages: DataFrame) -> DataFrame:
    """page_id, in_degree (distinct pages that link to its URL), out_degree."""
    e = edges(pages)
    own = pages.select("page_id", U.normal_b(F.col("url")).alias("norm"))
    inn = e.groupBy("target").agg(F.countDistinct("page_id").alias("in_degree")).withColumnRenamed("target", "norm")
    out = e.groupBy("page_id").agg(F.count("*").alias("out_degree"))
    return own.join(inn, "norm", "left").join(out, "page_id", "left").na.fill(0, ["in_degree", "out_degree"]).select("page_id", "in_degree", "out_degree")


def orphans(pages: DataFrame, most: int = 0) -> DataFrame:
    """Pages that at most ``most`` other pages link to."""
    return degrees(pages).where(F.col("in_degree") <= most).select("page_id", "in_degree")


def unlinked(pages: DataFrame) -> DataFrame:
    """Pages whose URL no page links to, as an anti join."""
    return pages.select("page_id", U.normal_b(F.col("url")).alias("target")).join(edges(pages).select("target").distinct(), "target", "left_anti").select("page_id", "target")


def dead_ends(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url").join(edges(pages).select("page_id"), "page_id", "left_anti")


def top_linked(pages: DataFrame, k: int = 20) -> DataFrame:
    return edges(pages).groupBy("target").agg(F.countDistinct("page_id").alias("linking_pages"), F.count_if("nofollow").alias("nofollow_links")).orderBy(F.col("linking_pages").desc(), "target").limit(k)


def broken_targets(pages: DataFrame) -> DataFrame:
    """Internal targets that no crawled page has, with the number of links and up to five linking pages."""
    known = pages.select(U.normal_b(F.col("url")).alias("target")).distinct()
    e = edges(pages).join(known, "target", "left_anti").select("target", "page_id").distinct()
    return least_k(e, ["target"], "page_id", 5).select("target", F.col("n").alias("linking_pages"), F.array_join("least", ",").alias("examples"))


def external_domains(pages: DataFrame, k: int = 15) -> DataFrame:
    x = raw_links(pages).where("not internal").groupBy(U.host(F.col("target")).alias("domain")).agg(F.countDistinct("target").alias("urls"))
    return x.orderBy(F.col("urls").desc(), "domain").limit(k)


def anchor_diversity(pages: DataFrame) -> DataFrame:
    g = edges(pages).groupBy("target").agg(F.count("*").alias("links"), F.countDistinct(F.lower("anchor")).alias("anchors"))
    return g.where("links > 1").withColumn("diversity", T.rounded(F.col("anchors") / F.col("links"), 3))


def template_cross_links(pages: DataFrame) -> DataFrame:
    """Of each URL template: links from its pages to other pages of the same template."""
    known = pages.select(U.normal_b(F.col("url")).alias("target"), F.concat(U.host(F.col("url")), U.template(F.col("url"))).alias("pattern_t"), F.col("page_id").alias("to_id"))
    e = edges(pages).join(pages.select("page_id", F.concat(U.host(F.col("url")), U.template(F.col("url"))).alias("pattern")), "page_id")
    j = e.join(known, "target").where((F.col("pattern") == F.col("pattern_t")) & (F.col("to_id") != F.col("page_id")))
    return j.groupBy("pattern").agg(F.count("*").alias("cross_links"), F.countDistinct("page_id").alias("linking_pages"))


def url_parts(pages: DataFrame) -> DataFrame:
    u = F.col("url")
    return pages.select("page_id", U.scheme(u).alias("scheme"), U.host(u).alias("host"), U.path(u).alias("path"), U.query(u).alias("query"), U.fragment(u).alias("fragment"), U.tld(u).alias("tld"), U.depth(u).cast("long").alias("depth"))


def url_normal_forms(pages: DataFrame) -> DataFrame:
    u = F.col("url")
    return pages.select("page_id", U.normal_a(u).alias("form_a"), U.normal_b(u).alias("form_b"), U.normal_c(u, U.host(u)).alias("form_c"), U.normal_d(u).alias("form_d"), U.template(u).alias("pattern"))


def hygiene_classes(pages: DataFrame) -> DataFrame:
    return pages.groupBy(U.hygiene(F.col("url")).alias("class")).agg(F.count("*").alias("urls"))


def scheme_mix(pages: DataFrame) -> DataFrame:
    """Hosts that are crawled by both http and https."""
    u = F.col("url")
    g = pages.groupBy(U.host(u).alias("host")).agg(F.count_if(U.scheme(u) == "http").alias("http_urls"), F.count_if(U.scheme(u) == "https").alias("https_urls"))
    return g.where("http_urls > 0 and https_urls > 0")


def www_overlap(pages: DataFrame) -> DataFrame:
    """Paths that a host has with and without www: an intersection of the two sides."""
    u = F.col("url")
    p = pages.select(U.host(u).alias("h"), U.bare_host(u).alias("host"), U.normal_d(u).alias("n"))
    bare = F.regexp_replace("n", r"^www\.", "")
    return p.where(F.col("h").startswith("www.")).select("host", bare.alias("path")).intersect(p.where(~F.col("h").startswith("www.")).select("host", bare.alias("path")))


def url_standards(pages: DataFrame) -> DataFrame:
    u = F.col("url")
    return pages.agg(F.count_if(U.path(u).rlike("[A-Z]")).alias("upper_case"), F.count_if(U.path(u).contains("_")).alias("underscores"), F.count_if(F.length(u) > 100).alias("too_long"), F.count_if(U.fragment(u) != "").alias("fragments"), F.count_if(U.query(u) != "").alias("parameters"))


def reach(edge: DataFrame, seeds: DataFrame, depth: int | None = 5) -> DataFrame:
    """(node, depth): least number of links from a seed, by frontier expansion; edge (src, dst), seeds (node).

    One join and one anti join a level; a level's frontier is checkpointed where a checkpoint folder is set.
    Without a depth it goes on until no new node is found; edges and frontiers are then staged, as levels may be many.
    """
    edge = staged(edge.select("src", "dst").distinct()) if depth is None else edge
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0).cast("long"))
    frontier, d = seen, 0
    while depth is None or d < depth:
        d += 1
        new = frontier.join(edge, frontier["node"] == edge["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(d).cast("long"))
        if depth is None:
            new = staged(new)
            if new.isEmpty():
                break
        elif edge.sparkSession.sparkContext.getCheckpointDir():
            new = new.checkpoint()
        seen, frontier = seen.unionByName(new), new
    return seen


def chains(hops: DataFrame, most: int = 10) -> DataFrame:
    """From (src, dst, status): where each source ends: src, final, hops, loop, temporary (a 302 or 307 on the way)."""
    state = hops.select("src", F.col("dst").alias("final"), F.lit(1).cast("long").alias("hops"), (F.col("src") == F.col("dst")).alias("loop"), F.col("status").isin(302, 307).alias("temporary"), F.array("src", "dst").alias("path"))
    nxt = hops.select(F.col("src").alias("s"), F.col("dst").alias("d"), F.col("status").isin(302, 307).alias("t"))
    for _ in range(most - 1):
        j = state.join(nxt, (F.col("final") == F.col("s")) & ~F.col("loop"), "left")
        go = F.col("s").isNotNull()
        state = j.select(
            "src", F.when(go, F.col("d")).otherwise(F.col("final")).alias("final"), (F.col("hops") + F.when(go, 1).otherwise(0)).alias("hops"), (F.col("loop") | (go & F.array_contains("path", F.col("d")))).alias("loop"),
            (F.col("temporary") | (go & F.col("t"))).alias("temporary"), F.when(go, F.concat("path", F.array("d"))).otherwise(F.col("path")).alias("path"),
        )
    return state.drop("path")


def target_examples(links: DataFrame, classes: DataFrame, k: int = 5) -> DataFrame:
    """class, target, linking_pages and the ``k`` least linking pages of every target of a class.

    ``links``: target, page_id; ``classes``: target, class; targets without a class are left out. Pages count once a target.
    """
    one = links.select("target", "page_id").distinct().join(classes, "target")
    return least_k(one, ["class", "target"], "page_id", k).select("class", "target", F.col("n").alias("linking_pages"), F.array_join("least", ",").alias("examples"))


def status_class(status: Column, title: Column, final: Column, url: Column) -> Column:
    """Class of an answer by precedence: broken (4xx), server_error (5xx), soft_404 (a title that says so), redirected; null for others."""
    t = F.lower(F.coalesce(title, F.lit("")))
    return (
        F.when(status.between(400, 499), "broken").when(status >= 500, "server_error").when((status == 200) & reduce(lambda a, b: a | b, (t.contains(s) for s in dims.SOFT_404_OF_LINKS)), "soft_404").when(final != url, "redirected")
    )


def linked_statuses(pages: DataFrame, responses: DataFrame, k: int = 5) -> DataFrame:
    """Internal targets by class of their answers (url, status, title, final_url), with the number of linking pages and examples."""
    r = responses.select(U.normal_b(F.col("url")).alias("target"), status_class(F.col("status"), F.col("title"), U.normal_b(F.col("final_url")), U.normal_b(F.col("url"))).alias("class")).where("class is not null").distinct()
    return target_examples(edges(pages), r, k)


def linked_pages(pages: DataFrame, k: int = 5) -> DataFrame:
    """Internal targets by what the crawl has of them: missing, soft_404 or crawled; linking pages and examples."""
    title = F.get(H.elements(F.coalesce("html", F.lit("")), "title"), 0)
    own = pages.select(U.normal_b(F.col("url")).alias("target"), status_class(F.lit(200), title, F.lit(""), F.lit("")).alias("c"))
    own = own.groupBy("target").agg(F.max("c").alias("c"), F.lit(True).alias("known"))
    e = edges(pages).select("target", "page_id").distinct().join(own, "target", "left")
    kind = F.when(F.col("known").isNull(), "missing").otherwise(F.coalesce("c", F.lit("crawled")))
    return least_k(e.withColumn("class", kind), ["class", "target"], "page_id", k).select("class", "target", F.col("n").alias("linking_pages"), F.array_join("least", ",").alias("examples"))


#: Buckets of ranks in which a host's quota is cut.
RANKS = 1024


def rank_of(node: Column) -> Column:
    """A number of 60 bits by which nodes are ranked, from the digest of the URL."""
    return F.conv(F.substring(F.md5(node.cast("binary")), 1, 15), 16, 10).cast("long")


def _within(found: DataFrame, room: DataFrame) -> DataFrame:
    """Of the nodes of each host (node, host) the ``room`` ones of least rank, ties by node.

    Ranks are counted in RANKS buckets; only the bucket in which the room ends is put in order.
    """
    f = found.withColumn("rank", rank_of(F.col("node"))).withColumn("bucket", F.shiftright("rank", 60 - (RANKS - 1).bit_length()))
    counts = f.groupBy("host", "bucket").agg(F.count("*").alias("m"))
    counts = counts.withColumn("before", F.coalesce(F.sum("m").over(W.partitionBy("host").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    open_ = counts.join(room, "host").where("before < room").select("host", "bucket", (F.col("before") + F.col("m") <= F.col("room")).alias("whole"), (F.col("room") - F.col("before")).alias("rest"))
    f = f.join(open_, ["host", "bucket"])
    cut = f.where("not whole").withColumn("place", F.row_number().over(W.partitionBy("host").orderBy("rank", "node"))).where("place <= rest")
    return f.where("whole").select("node", "host").unionByName(cut.select("node", "host"))


def crawl(edge: DataFrame, seeds: DataFrame, depth: int | None = 3, most: int | None = 30) -> DataFrame:
    """(node, host, depth): what a crawl from the seeds visits, level by level, at most ``most`` nodes a host and ``depth`` links away.

    ``edge``: src, dst (links within a host); ``seeds``: node. Where a level has more new nodes than a host has room, those of least rank
    are visited (``rank_of``). None: no bound, which gives what ``reach`` gives. Each level is a staged table; a host that is full has no frontier.
    """
    edge = staged(edge.select("src", "dst").where("src is not null and dst is not null").distinct())
    host = U.host(F.col("node"))
    new = seeds.select("node").where("node is not null").distinct().withColumn("host", host)
    seen, d = None, 0
    while True:
        if most is not None:
            used = seen.groupBy("host").agg(F.count("*").alias("used")) if seen is not None else None
            hosts = new.select("host").distinct()
            room = hosts.join(used, "host", "left").select("host", (F.lit(most) - F.coalesce("used", F.lit(0))).alias("room")) if used is not None else hosts.select("host", F.lit(most).alias("room"))
            new = _within(new, room.where("room > 0"))
        new = staged(new.withColumn("depth", F.lit(d).cast("long")))
        if d and new.isEmpty():
            return seen
        seen = new if seen is None else seen.unionByName(new)
        if d == depth:
            return seen
        d += 1
        new = new.join(edge, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().withColumn("host", host).join(seen.select("node"), "node", "left_anti")
