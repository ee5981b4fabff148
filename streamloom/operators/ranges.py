"""Places and running sums in an order, without one task for a key: ranges are sorted apart and offset by what stands before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import shared_folder


def ranged(df: DataFrame, keys: list[str], order: list[Column], path: str | None = None) -> DataFrame:
    """``df`` sorted by ranges of keys and order and written, with ``_part`` (the range) and ``_at``, which rises in it.

    It is written so that ranges, which Spark draws from a sample, are the same to all who read them. ``order`` should leave no ties.
    """
    spark = df.sparkSession
    path = path or shared_folder(spark)
    by = [*[F.col(k) for k in keys], *order]
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    rows.write.mode("overwrite").parquet(path)
    return spark.read.schema(rows.schema).parquet(path).withColumn("_part", F.shiftright("_at", 33))


def offsets(rows: DataFrame, keys: list[str], total: Column) -> DataFrame:
    """``_k0`` ..., ``_p`` (a range), ``_from`` (its least ``_at``), ``_total`` of each key in it, and ``_before``: the total of the ranges before. A row for each key and range."""
    each = rows.groupBy(*keys, "_part").agg(total.alias("_total"), F.min("_at").alias("_from"))
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_total").over(w), F.lit(0)).alias("_before")
    return each.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_from", "_total", before)


def beside(rows: DataFrame, keys: list[str], starts: DataFrame) -> DataFrame:
    """Each row with the offsets of its key and range; null keys are a key."""
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return rows.join(starts, [F.col("_part") == F.col("_p"), *same])


def placed(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with the place of each row among those of its key, from 1."""
    rows = ranged(df, keys, order)
    out = beside(rows, keys, offsets(rows, keys, F.count("*")))
    return out.withColumn(name, F.col("_at") - F.col("_from") + F.col("_before") + 1).select(*df.columns, name)


def summed(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its key up to each row."""
    rows = ranged(df.withColumn("_v", value), keys, order)
    within = F.sum("_v").over(Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    out = beside(rows.withColumn("_within", within), keys, offsets(rows, keys, F.sum("_v")))
    return out.withColumn(name, F.col("_within") + F.col("_before")).select(*df.columns, name)
