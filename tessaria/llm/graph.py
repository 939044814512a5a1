"""Connected components over an edge table: contraction within partitions, then alternating large-star and small-star
rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Edges that one task contracts; so many need some 50 MB.
EDGES = 250_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars (u, v), v the smallest of its nodes, that join what the edges (u, v) of a partition join."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns)):
            u, v = root(up.setdefault(u, u)), root(up.setdefault(v, v))
            if u != v:
                up[max(u, v)] = min(u, v)
    tips = [x for x in up if up[x] != x]
    for lo in range(0, max(1, len(tips)), 20_000):
        part = tips[lo : lo + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["u", "v"])


def connected_components(links: DataFrame, folder: str) -> DataFrame:
    """(node, component) for every node in links(a, b); component is the smallest node reachable.

    Each partition of EDGES edges or fewer is first contracted to stars. Then each round links every node to the
    smallest neighbour it knows, until only stars are left: no node is the centre of one edge and the tip of another,
    or the tip of two. The number of rounds is logarithmic in the longest path. Edges stay on the executors; the
    driver only sees their number and whether a round is needed. Self links are allowed, null ends are dropped, and
    empty links give an empty table. Joins with a large star's centre are left to adaptive skew splitting.
    """
    e = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v"), folder, "edges")
    e = cut(e.coalesce(1 + e.count() // EDGES).mapInArrow(_contract, "u long, v long"), folder, "edges-0")
    k = 0
    while not _only_stars(e):
        k += 1
        # Large star: neighbours above u move to u's smallest neighbour (or u).
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        # Small star: u and its neighbours below it move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        e = cut(small, folder, f"edges-{k}")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _only_stars(e: DataFrame) -> bool:
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("tip")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("tip")))
    return ends.groupBy("node").agg(F.sum("tip").alias("tips"), F.min("tip").alias("least")).filter("tips > 1 or (tips = 1 and least = 0)").isEmpty()
