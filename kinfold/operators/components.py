"""Connected components of a graph of long ids, by alternating large-star and small-star steps.

Each step replaces edges by edges to smaller ids, so that every component ends as a star around its
smallest id after a number of rounds that grows with the logarithm of its size.  A step is one job:
an aggregation, whose partial minima keep hubs cheap, joined to a saved table of edges.  Adaptive
execution broadcasts the minima where they prove small, and splits skewed partitions of a sort-merge
join where they do not.  The numbers that tell whether a round changed anything are observed while
its table is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kinfold.scratch import Scratch

#: The most rows of a table of minima that is broadcast.
BROADCAST_ROWS = 200_000


def counted_side(df: DataFrame) -> DataFrame:
    """df marked for broadcast if it is counted as small; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """node and label (the smallest id of its component) of each node of an edge, saved.

    Needs columns u and v.  Edges may repeat and run either way; loops and edges with a null are
    dropped, so a node without an edge to another is not returned.
    """
    tidy = edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).filter("a != b")
    before, turn = None, 0
    now, state = _saved(tidy.distinct(), scratch, f"{name}-0")
    while state != before:
        before, turn = state, turn + 1
        least = now.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        large = now.join(least, F.col("b") == F.col("k"), "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        large = scratch.save(large, f"{name}-large-{turn}")
        least = large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        joined = large.join(least, F.col("a") == F.col("k")).select("a", "b", "m")
        either = F.when(F.col("b") == F.col("m"), F.struct("a", F.col("m").alias("b"))).otherwise(F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = joined.select(either.alias("e")).select("e.a", "e.b").distinct()
        now, state = _saved(small, scratch, f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}", f"{name}-large-{turn}")
    members = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = scratch.save(members.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()), name)
    scratch.drop(f"{name}-{turn}")
    return out


def _saved(edges: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, dict]:
    """The saved edges, with their number and a sum of their hashes."""
    seen = Observation()
    saved = scratch.save(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), name)
    return saved, seen.get
