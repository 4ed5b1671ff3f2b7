"""Connected components of a link table, without gathering links or components on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import forget, materialise

#: Links that a task contracts together.
TOGETHER = 500_000


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of a link (src, dst); component is the smallest node reachable.

    Tasks first contract their own links, a bounded number each, to stars around smallest nodes; what several tasks
    have made is joined by alternating large-star and small-star steps (each contracts the graph towards its smallest
    nodes) until nothing changes. Every step is a minimum by node and a join, so a node with very many links is neither
    gathered nor expanded. Links of a node with itself and links with a null end say nothing; an empty table gives an
    empty table.
    """
    now = materialise(_tidy(links.select(F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v"))), "links", small=True)
    tasks, before = 1 + now.count() // TOGETHER, now
    now = materialise(now.coalesce(tasks).mapInPandas(_contracted, "u long, v long"), "links")
    forget(before)
    seen = None
    while tasks > 1 and (state := _state(now)) != seen:
        seen, before = state, now
        # a step makes no more links than there were
        now = materialise(_small_star(_large_star(now)).coalesce(1 + seen[0] // TOGETHER), "links")
        forget(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each node of a task's links with the smallest node that they lead to."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    yield pd.DataFrame([(x, root) for x in parent if (root := find(x)) != x], columns=["u", "v"], dtype="int64")


def _tidy(pairs: DataFrame) -> DataFrame:
    """Each link once, from the larger node to the smaller."""
    return pairs.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Link each node's larger neighbours with the smallest of its neighbourhood."""
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _tidy(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(links: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours with the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return _tidy(links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")))
