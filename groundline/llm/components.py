"""Connected components of a link table, by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Every round is joins and
grouped minima on Spark; no link or label passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import merging, spool


#: Nodes with at least this many links, and this share of all links' ends, are hubs. So at most 1 / HUB_SHARE
#: nodes are hubs, however many links there are, and a broadcast of them is bounded.
HUB_LINKS, HUB_SHARE = 256, 1 / 5000


def _starred(directed: DataFrame, ends: int, most: int | None = None) -> DataFrame:
    """(u, v, m): each link with the least node next to u, u itself included. Links of nodes with `most` or more stay where they are.

    `ends` are the links' rows: Spark doesn't see that each link has two.
    """
    least = directed.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
    if most is None:
        return directed.join(merging(least.drop("n"), ends), "u")
    hubs = F.broadcast(least.where(F.col("n") >= most).drop("n"))
    return directed.join(hubs, "u").unionAll(directed.join(hubs, "u", "left_anti").join(merging(least.where(F.col("n") < most).drop("n"), ends), "u"))


def _rows(*pairs: tuple[str, str]) -> Column:
    """A row (u, v) for each named pair of columns."""
    return F.inline(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs]))


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links(a, b) of any one orderable type -> (node, root): the least node reachable, for every linked node.

    Repeated links, both directions and self-links are allowed; nulls are ignored. An empty table gives none.
    """
    edges = links.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = spool(edges, "links")

    def summed(both: DataFrame):
        """Ends of links, a digest of these, and the links of the node that has the most."""
        nodes = both.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"))
        return nodes.agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.max("n").alias("most")).first()

    seen = None
    for _ in range(most_rounds):
        both = edges.select(_rows(("u", "v"), ("v", "u")))
        now = summed(both)
        if not now.n or now == seen:
            break
        seen = now
        hub = max(HUB_LINKS, int(now.n * HUB_SHARE))
        large = _starred(both, now.n, hub if now.most >= hub else None).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Both links of a row come from one pass, so that a round's plan holds each star once.
        edges = spool(_starred(large, now.n).select(_rows(("v", "m"), ("u", "m"))).where("u != v").distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return merging(edges.select(_rows(("u", "v"), ("v", "v"))).distinct().toDF("node", "root"), now.n or 0)
