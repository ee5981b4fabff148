"""Ranks by a distributed sort: ranges of the order, sorted apart, and the offset of each."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

_BITS = 33  # fixed value: monotonically_increasing_id counts in its low bits, above them is the partition


def positions(df: DataFrame, *order: Column, name: str = "sorted") -> DataFrame:
    """``df`` and ``position``: 0, 1, 2 ... in ``order`` over all rows.

    Rows go to partitions by ranges and are sorted and written there; the driver sees one count
    for each partition. Rows that are equal in ``order`` may stand in any order, and where a large
    part of the rows may be equal, ``order`` should end in something that tells them apart. No
    rows give no rows; a column named ``position`` is replaced.
    """
    rows = df.drop("position").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(rows.withColumn("position", F.monotonically_increasing_id()), name)
    part = F.shiftright("position", _BITS)
    counts = sorted((r[0], r[1]) for r in rows.groupBy(part).count().collect())
    starts = [0, *accumulate(n for _, n in counts)]
    offsets = [(p, s - (p << _BITS)) for (p, _), s in zip(counts, starts)]
    moves = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part long, _move long"))
    moved = rows.join(moves, part == F.col("_part"))
    return moved.withColumn("position", F.col("position") + F.col("_move")).drop("_part", "_move")
