"""Distributed union-find over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, tidy


#: Up to so many edges a round's tables go to FILES tasks and files; that many small rows are no work for more.
FEW, FILES = 1_000_000, 8


def _stars(edges: DataFrame) -> bool:
    """Whether every larger end has one edge and is no smaller end: then all components are found."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("hi").alias("v"), F.lit(1).alias("n")), F.struct(F.col("lo").alias("v"), F.lit(0).alias("n")))).alias("e"))
    each = ends.groupBy("e.v").agg(F.sum("e.n").alias("n"), F.min("e.n").alias("least"))
    return each.where("n > 1 OR n = 1 AND least = 0").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node that each node reaches, by alternating large and small stars.

    ``edges``: columns ``a`` and ``b`` of one orderable type. Returns ``node``, ``component`` for
    every node on an edge between two different nodes. Null ends and loops are ignored, repeated
    edges count once, and an empty table gives an empty result. Each round is one written table,
    so a lost executor costs one round; the driver only learns whether all components are stars yet.
    """
    now = materialize(
        edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .distinct(),
        "edges",
    )
    few = now.count() <= FEW  # no round makes more edges than twice these
    dealt = lambda df: df.coalesce(FILES) if few else df
    for _ in range(max_rounds):
        if _stars(now):
            break
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        # minima combine before the shuffle and are written, so that a join on a hub can be split
        least = materialize(dealt(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))), "least")
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = materialize(dealt(large.distinct()), "large")
        low = materialize(dealt(large.groupBy("hi").agg(F.min("lo").alias("m"))), "low")
        small = large.join(low, "hi").select(
            F.explode(
                F.array(
                    F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")),
                    F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")),
                )
            ).alias("e")
        )
        step = materialize(dealt(small.select("e.hi", "e.lo").where("hi <> lo").distinct()), "edges")
        release(least, large, low)
        release(now)
        now = step
    else:
        raise RuntimeError("connected components did not settle")
    tidy(edges.sparkSession)
    tops = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(tops)
