"""Connected components of a link table, without gathering a component anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finquarry.llm.common import drop_staged, stage

#: So few links are settled by one task; more go through rounds of joins.
FEW = 1 << 18
#: Nodes of more links than this have their minimum broadcast; at most 2 * links / HEAVY nodes have.
HEAVY = 1000


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, few: int = FEW, heavy: int = HEAVY) -> DataFrame:
    """(node, component) of every node with a link to another; component is the smallest node it reaches.

    Alternates large-star and small-star steps (Kiveris and others) until links stop changing, or until at most `few`
    are left. Minima are partial aggregates, and those of nodes with very many links are broadcast, so that no node is
    a hot group. Nulls and loops are no links. Rounds that do not end in time are an error, never a partial result.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").filter(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    e, seen = stage(e, "cc"), None
    for _ in range(most_rounds):
        mark = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (mark.n, mark.h) == seen or not mark.n:
            return e.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.groupBy("v").agg(F.lit(0)).select("v", "v"))
        if mark.n <= few:
            return e.coalesce(1).mapInPandas(_settle, "node long, component long")
        seen = (mark.n, mark.h)
        # Large star: each node hands its larger neighbours its smallest neighbour.
        both = e.union(e.select("v", "u"))
        large = _with_least(both, mark.n, heavy).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        # Small star: each node ties its smaller neighbours and itself to the smallest of them.
        large = stage(large.filter("u > v").distinct(), "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, mark.n, heavy).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").union(low)
        new = stage(small.distinct(), "cc")
        drop_staged(e, large)
        e = new
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _with_least(e: DataFrame, links: int, heavy: int) -> DataFrame:
    """(u, v, m): each link with the smallest v of its u."""
    heavy = max(heavy, 2 * links >> 20)  # so at most about a million nodes are heavy
    low = stage(e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "cc-low")
    hubs = F.broadcast(low.filter(F.col("n") > heavy).select("u", F.col("m").alias("hub")))
    split = e.join(hubs, "u", "left")
    light = split.filter("hub is null").select("u", "v").join(low.filter(F.col("n") <= heavy).select("u", "m"), "u")
    return split.filter("hub is not null").select("u", "v", F.col("hub").alias("m")).unionByName(light)


def _settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of a few links (u, v), in one task."""
    links = pd.concat(list(frames) or [pd.DataFrame({"u": [], "v": []}, dtype="int64")])
    nodes = pd.unique(pd.concat([links["u"], links["v"]]).sort_values())
    at = pd.Series(range(len(nodes)), index=nodes)
    uf = UnionFind(len(nodes))
    for x, y in zip(at[links["u"]].tolist(), at[links["v"]].tolist(), strict=True):
        uf.union(x, y)
    yield pd.DataFrame({"node": nodes, "component": nodes[[uf.find(i) for i in range(len(nodes))]]})


class UnionFind:
    """Over 0..n-1 inside one task; the smaller index is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True
