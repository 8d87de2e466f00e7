"""Connected components of an edge table by alternating large and small stars.

Each round sends every node's larger neighbours, then its smaller ones, to the
least node among them (Kiveris et al., 2014); rounds grow with the logarithm of
the longest path. Only DataFrame operations run; each round is written to the
shared folder, so that lost executors cost one round's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import ROWS_TO_BROADCAST, discard, keep, materialize, scratch


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge to another; the component is its least node.

    Nulls, loops and repeated edges are ignored; an empty table gives an empty one.
    """
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct()
    with scratch(edges.sparkSession):
        now, last = materialize(pairs, "edges"), None
        stamp = _stamp(now)
        while stamp != last and stamp[0]:
            # a node with many neighbours: its least one is found map-side, and if the rows allow it, is sent to them rather than they to it
            few = F.broadcast if 2 * stamp[0] <= ROWS_TO_BROADCAST else lambda df: df
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.where("v > u").join(few(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            large = materialize(large, "edges")
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(few(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
            small = materialize(small, "edges")
            for done in (now, large):
                discard(done)
            now, last = small, stamp
            stamp = _stamp(now)
        members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        return keep(members.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
