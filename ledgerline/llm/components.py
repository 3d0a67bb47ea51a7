"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import drop, run, stored

#: A node is a hub when it has over 1 / HUBS of all links, so there are fewer than HUBS.
HUBS = 10_000


def _with_least(edges: DataFrame, links: int) -> DataFrame:
    """``edges`` (u, v), ``links`` at most, with m, the least of a u and all its v.

    The least is made of partial minima. Hubs, of which there are fewer than HUBS, are
    sent to their links, which stay where they are; the other nodes are joined by key.
    """
    least = stored(
        edges.groupBy("u").agg(F.count("*").alias("held"), F.min("v").alias("v")).select(
            "u", F.least("u", "v").alias("m"), "held"
        ),
        "links-least",
    )
    hubs = least.filter(F.col("held") * HUBS > links).select("u", "m")
    told = edges.join(F.broadcast(hubs), "u", "left")
    return told.filter("m IS NOT NULL").union(
        told.filter("m IS NULL").drop("m").join(least.select("u", "m"), "u")
    )


def _signature(edges: DataFrame) -> tuple:
    """The number of ``edges`` and a sum that tells them from others."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


@run("components")
def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """node and component (the least node it can reach) of every node with a link.

    ``links`` has the bigint columns a and b. In each round every node first sends its
    larger neighbours to the least node it knows, then all its neighbours and itself;
    the links end as stars around the least nodes, after about log n rounds.
    """
    edges = stored(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    before = _signature(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # larger neighbours meet the least node
        large = stored(
            _with_least(both, 2 * before[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
            "links",
        )
        small = (
            _with_least(large, 2 * before[0])
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u <> v")
            .distinct()
        )
        older, edges = edges, stored(small, "links")
        drop(older, large)
        now = _signature(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
