"""Connected components of links by alternating large and small stars, over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelwright.llm.common import discard, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (columns a and b, of one orderable type); root is the smallest node reachable.

    Each round hooks the larger neighbours of every node, then its smaller ones, to the smallest (Kiveris et al.,
    "Connected Components in MapReduce and Beyond"); the number of rounds grows with the logarithm of the nodes. No
    task gets all links of a node: minima are summed up before the shuffle and stored, so that both sides of the joins
    are plain tables and the links of a node that has very many can be split. Tables of a round go when the next one
    is there. Nulls link nothing, repeated links and loops count once; without links there are no rows.
    """
    live: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        live.append(stored(df, name))
        return live[-1]

    ends = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = kept(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        # large star: of each node u with smallest neighbour m (or itself), neighbours above u now link to m
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = kept(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "lowest")
        large = kept(both.filter("v > u").join(lowest, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links")
        # small star: of each node u, its smaller neighbours and u itself now link to the smallest of them
        lowest = kept(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m"), "lowest")
        hooked = large.join(lowest, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = kept(hooked.union(lowest.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), "links")
        discard(*live[:-1])
        del live[:-1]
        now = _state(edges)
        if now == state:
            break
        state = now
    # all that is left are stars around the smallest nodes
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
