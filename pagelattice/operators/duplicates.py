"""Groups of duplicate pages: exact copies, near copies by signatures, and thin pages, one row a page.

Copies of a text are one class before anything is compared, and classes of one signature are one node. Nodes that share a band key are
compared with the least of them (a star); what is connected then needs no comparison with each other. Only nodes of a key that are still in different
components are compared block by block, in tasks of bounded size. So a key that a group of near copies fills costs a comparison a node, and no pairs are made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..plans.components import connected
from ..plans.stage import staged
from .documents import band_keys, shared_keys, signed

#: Nodes of a block.
BLOCK = 512


def _agree(x: Column, y: Column) -> Column:
    return F.size(F.filter(F.zip_with(x, y, lambda a, b: a == b), lambda z: z))


def _stars(members: DataFrame, nodes: DataFrame, most: int, n: int) -> DataFrame:
    """Links between the least node of a key and those of its others that agree with it in all but ``most`` of n places."""
    low = members.groupBy("key").agg(F.min("node").alias("u"))
    pairs = members.join(low, "key").where("u <> node").select("u", F.col("node").alias("v")).distinct()
    sides = pairs.join(nodes.select(F.col("node").alias("u"), F.col("sig").alias("su")), "u").join(nodes.select(F.col("node").alias("v"), F.col("sig").alias("sv")), "v")
    return sides.where(_agree(F.col("su"), F.col("sv")) >= n - most).select("u", "v")


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """(key, component, node) dealt to blocks of about ``block`` nodes: block, and own, the component where a block holds no other one's."""
    c = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    few = c.where(F.col("n") < block).groupBy("key").agg(F.sum("n").alias("few"))
    r = rows.join(c, ["key", "component"]).join(few, "key", "left")
    big = F.col("n") >= block
    deal = lambda x, n: F.pmod(F.xxhash64(x), F.ceil(n / block).cast("long"))
    return r.select("key", "component", "node", F.when(big, F.col("component")).alias("own"), F.when(big, F.xxhash64("component", deal("node", F.col("n")))).otherwise(deal("component", F.col("few"))).alias("block"))


def _spanning(most: int, n: int):
    """Links that join the components of a pair of blocks: of all close nodes of different components, a forest."""

    def run(t: pa.Table) -> pa.Table:
        names = np.array(t.column("node").to_pylist(), object)
        comp = np.unique(np.array(t.column("component").to_pylist(), object).astype(str), return_inverse=True)[1]
        sig = np.stack([np.asarray(s, np.int64) for s in t.column("sig").to_pylist()])
        same = np.zeros((len(sig), len(sig)), np.int16)
        for i in range(n):
            same += sig[:, i, None] == sig[None, :, i]
        u, v = np.nonzero(np.triu((same >= n - most) & (comp[:, None] != comp[None, :])))
        # one link for each two components that meet
        _, first = np.unique(np.minimum(comp[u], comp[v]) * len(sig) + np.maximum(comp[u], comp[v]), return_index=True)
        return pa.table({"u": pa.array(names[u[first]].tolist(), pa.string()), "v": pa.array(names[v[first]].tolist(), pa.string())})

    return run


def near_components(nodes: DataFrame, threshold: float = 0.85, n: int = 100, bands: int = 20, block: int = BLOCK) -> DataFrame:
    """(node, component) of nodes (string node, sig; distinct) that are connected by signatures that agree in ``threshold`` of n places. No link is lost."""
    nodes = staged(nodes)
    most = int((1 - threshold) * n + 1e-9)
    keys = nodes.select("node", F.explode(band_keys(F.col("sig"), threshold, n, bands)).alias("key"))
    members = shared_keys(keys)
    first = staged(_stars(members, nodes, most, n))
    found = connected(first)
    c = members.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = c.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n")).where("a <> b and n > 2").select("key")
    rest = staged(c.join(mixed, "key"))
    if rest.isEmpty():
        return found
    dealt = staged(_blocks(rest, block))
    b = staged(dealt.select("key", "block", "own").distinct())
    pairs = b.alias("x").join(b.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.block") <= F.col("y.block")) & ~F.coalesce(F.col("x.own") == F.col("y.own"), F.lit(False)))
    pairs = pairs.select("x.key", F.explode(F.array_distinct(F.array("x.block", "y.block"))).alias("block"), F.struct("x.key", "x.block", F.col("y.block").alias("other")).alias("pair"))
    rows = dealt.join(pairs, ["key", "block"]).join(nodes, "node").select("pair", "node", "component", "sig")
    second = staged(rows.groupBy("pair").applyInArrow(_spanning(most, n), "u string, v string"))
    return connected(first.union(second))


def duplicate_report(pages: DataFrame, threshold: float = 0.85, k: int = 5, n: int = 100, bands: int = 20, floor: int = 300, critical: int = 100) -> DataFrame:
    """page_id, words, thin (critical, warning or null), exact_id and exact_pages, group_id and group_pages.

    exact_id: the least page_id with the same text but for case and white space; group_id: the least one reachable over exact and near copies.
    Pages without text have neither. Repeated rows and ids are pages of their own; a null id is the least only where all are. An empty table gives no rows.
    """
    text = pages.select("page_id", H.visible(F.coalesce("html", F.lit(""))).alias("text"))
    exact = F.when(F.col("text") != "", F.sha2(T.normalised(F.col("text")), 256))
    items = staged(signed(text, F.col("page_id"), F.size(T.words(F.col("text"))).cast("long").alias("words"), exact.alias("exact"), k=k, n=n, all_rows=True))
    one = items.where("exact is not null").groupBy("exact").agg(F.min("page_id").alias("exact_id"), F.count("*").alias("exact_pages"), F.min("sig").alias("sig"))
    one = staged(one.withColumn("node", F.coalesce(F.md5(F.array_join(F.col("sig").cast("array<string>"), ",").cast("binary")), "exact")))
    nodes = one.where("sig is not null").groupBy("node").agg(F.first("sig").alias("sig"))
    found = near_components(nodes, threshold, n, bands)
    g = one.join(found, "node", "left").select("exact", "exact_id", "exact_pages", F.coalesce("component", "node").alias("component"))
    least = g.groupBy("component").agg(F.min("exact_id").alias("group_id"), F.sum("exact_pages").alias("group_pages"))
    g = g.join(least, "component").drop("component")
    thin = F.when(F.col("words") < critical, "critical").when(F.col("words") < floor, "warning")
    return items.select("page_id", "words", "exact").join(g, "exact", "left").select("page_id", "words", thin.alias("thin"), "exact_id", "exact_pages", "group_id", "group_pages")
