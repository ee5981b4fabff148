"""Duplicates within tumbling, epoch-aligned windows; the batch form of the stream operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import DistinctRule


def window_start(time: Column, width_ms: int) -> Column:
    """Start of the window of a timestamp, in epoch milliseconds."""
    ms = F.unix_millis(time.cast("timestamp"))
    return ms - F.pmod(ms, F.lit(width_ms))


def scope(rule: DistinctRule) -> list[Column]:
    """What the duplicates of a rule have in common."""
    keys = [F.col(f) for f in rule.fields]
    if rule.part_field:
        keys.append(F.col(rule.part_field))
    if rule.time_field:
        keys.append(window_start(F.col(rule.time_field), rule.window_ms))
    return keys


def numbered(df: DataFrame, rule: DistinctRule, order: list[str], name: str = "nth") -> DataFrame:
    """``df`` with the place of each row among its duplicates, from 1; ``order`` needs a tie-break."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*scope(rule)).orderBy(*order)))


def first_arrivals(df: DataFrame, rule: DistinctRule, order: list[str]) -> DataFrame:
    """The first row of each group of duplicates, by a minimum that combines before the shuffle.

    Nulls in key columns are equal to each other.
    """
    keys = [k.alias(f"_k{i}") for i, k in enumerate(scope(rule))]
    row = F.struct(*df.columns)
    best = F.min_by(row, F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select("_row.*")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, distinct keys and duplicates in one row."""
    each = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    sums = each.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys"))
    return sums.withColumn("n_dup", F.col("n_rows") - F.col("n_keys"))


def split_late(df: DataFrame, time: str, horizon: Column) -> tuple[DataFrame, DataFrame]:
    """Rows not older than the horizon, and the late ones."""
    late = F.coalesce(F.col(time) < horizon, F.lit(False))
    return df.where(~late), df.where(late)


def unseen(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not in ``seen``; null keys match null keys."""
    on = [df[k].eqNullSafe(seen[k]) for k in keys]
    return df.join(seen.select(*keys).distinct(), on, "left_anti")
