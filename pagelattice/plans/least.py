"""The k least values of each group as a mergeable aggregate of bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups that a task holds before it sends on what it has; parts that a group's partial results are merged in first.
HELD, PARTS = 100_000, 64


def least_k(df: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """keys, n (rows of the group) and least (its ``k`` least values in ascending order, nulls left out, repeats kept).

    A task keeps k values a group and sends on at most one row for each group that it holds, so a hot group is no more than k values a task.
    These are merged in PARTS parts and then to one: no step sees all rows of a group, and nothing is sorted by group.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + f", n long, least array<{kinds[value]}>"

    def merged(parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat([_top(p) for p in parts]) if len(parts) == 1 else _top(pd.concat(parts))

    def _top(d: pd.DataFrame) -> pd.DataFrame:
        """Rows (keys, n, v): of every group the k least v, and all of its n on the first."""
        d = d.sort_values("v", kind="stable", na_position="last")
        g = d.groupby(keys, dropna=False, sort=False)
        d = d.assign(n=g["n"].transform("sum"), place=g.cumcount())
        d = d[(d["place"] < k) & (d["v"].notna() | (d["place"] == 0))]
        return d.assign(n=d["n"].where(d["place"] == 0, 0)).drop(columns="place")

    def rows(d: pd.DataFrame) -> pd.DataFrame:
        g = d.groupby(keys, dropna=False, sort=False)
        return pd.DataFrame({"n": g["n"].sum(), "least": g["v"].agg(lambda x: list(x.dropna()))}).reset_index()[[*keys, "n", "least"]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for f in frames:
            if not len(f):
                continue
            held.append(_top(f.assign(n=1).rename(columns={value: "v"}) if value != "v" else f.assign(n=1)))
            size += len(held[-1])
            if size > 2 * HELD:
                held = [merged(held)]
                size = len(held[0])
            if size > HELD:
                yield rows(merged(held))
                held, size = [], 0
        if held:
            yield rows(merged(held))

    part = df.select(*keys, value).mapInPandas(run, schema)
    both = lambda: (F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("least"))), 1, k).alias("least"))
    return part.groupBy(*keys, F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part")).agg(*both()).groupBy(*keys).agg(*both())
