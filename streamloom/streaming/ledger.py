"""What streams carry from batch to batch in small files: the last number given, the newest time seen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ranges
from ..operators.dedup import window_start
from ..operators.stored import SeenSet
from ..sources.files import delete, list_dir
from ..spec import DistinctRule


def _newest(spark, path: str, before: int) -> str | None:
    """The folder of the newest whole entry of an earlier batch."""
    done = sorted((int(n) for n, _ in list_dir(spark, path) if n.isdigit() and int(n) < before), reverse=True)
    return next((f"{path}/{k}" for k in done if "_SUCCESS" in dict(list_dir(spark, f"{path}/{k}"))), None)


def _trim(spark, path: str, batch: int) -> None:
    """Entries that no repeated batch needs."""
    for k in sorted(int(n) for n, _ in list_dir(spark, path) if n.isdigit() and int(n) < batch)[:-1]:
        delete(spark, f"{path}/{k}")


def numbered(df: DataFrame, keys: list[str], order: list[Column], path: str, batch: int, name: str = "seq") -> DataFrame:
    """A batch with ``name``: 1, 2, 3 ... for each of ``keys`` in ``order``, on from where the batch before ended.

    Rows are sorted by ranges of the keys and the order; a task numbers its part, and the sizes of
    the parts give the start of each, so that one key may fill many tasks. ``path`` keeps the last
    number of each key, an entry a batch: a batch that runs again starts from the same numbers.
    ``order`` should leave no ties. An empty batch carries the numbers on.
    """
    spark = df.sparkSession
    rows = ranges.ranged(df, keys, order, f"{path}/_rows-{batch}")
    starts = ranges.offsets(rows, keys, F.count("*"))
    last = _newest(spark, f"{path}/last", batch)
    each = starts.groupBy(*[F.col(f"_k{i}") for i in range(len(keys))]).agg(F.sum("_total").alias("_last"))
    old = spark.read.schema(each.schema).parquet(last) if last else each.limit(0)
    grown = each.unionByName(old).groupBy(*each.columns[:-1]).agg(F.sum("_last").alias("_last"))
    grown.write.mode("overwrite").parquet(f"{path}/last/{batch}")
    _trim(spark, f"{path}/last", batch)
    same = [F.col(f"s._k{i}").eqNullSafe(F.col(f"o._k{i}")) for i in range(len(keys))]
    starts = starts.alias("s").join(old.alias("o"), same, "left").select("s.*", F.coalesce("_last", F.lit(0)).alias("_last"))
    out = ranges.beside(rows, keys, starts)
    return out.withColumn(name, F.col("_at") - F.col("_from") + F.col("_before") + F.col("_last") + 1).select(*df.columns, name)


def number_stream(df: DataFrame, keys: list[str], order: list[Column], path: str, write: Callable[[DataFrame, int], None], name: str = "seq"):
    """A writer of a stream whose batches get running numbers; ``write`` gets the rows and the batch number and must replace a batch that it has."""

    def batch(rows: DataFrame, number: int) -> None:
        write(numbered(rows, keys, order, f"{path}/ledger", number, name), number)
        delete(rows.sparkSession, f"{path}/ledger/_rows-{number - 1}")

    return df.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/state")


def told_apart(df: DataFrame, rule: DistinctRule, order: list[str], seen: SeenSet, path: str, batch: int) -> DataFrame:
    """A batch with ``fate``: ``kept``, ``duplicate`` or ``late``.

    A row belongs to the generation (tumbling window) of its time. It is late if that is more than
    ``check_range`` generations older than the newest one of the batches before, or if it has no
    time; such rows are compared with nothing. Of rows with equal keys in one generation the first
    by ``order`` is kept unless an earlier batch had one; the others are duplicates. Generations
    that only late rows could belong to are dropped from ``seen``.
    """
    spark = df.sparkSession
    start = window_start(F.col(rule.time_field), rule.window_ms)
    last = _newest(spark, f"{path}/newest", batch)
    newest = spark.read.parquet(last).first()[0] if last else None
    horizon = None if newest is None else newest - rule.check_range * rule.window_ms
    late = start.isNull() if horizon is None else start.isNull() | (start < horizon)
    rows = df.withColumn("_gen", start).withColumn("_late", late)
    top = rows.agg(F.max("_gen").alias("newest")).select(F.greatest("newest", F.lit(newest).cast("long")).alias("newest"))
    top.write.mode("overwrite").parquet(f"{path}/newest/{batch}")
    _trim(spark, f"{path}/newest", batch)
    if horizon is not None:
        seen.drop(lambda g, b: g < horizon)
    names = [*rule.fields, *([rule.part_field] if rule.part_field else [])]
    keys = [F.col(f) for f in names]
    fresh = rows.where("NOT _late")
    row = F.struct(*df.columns)
    groups = [F.col(f).alias(f"_k{i}") for i, f in enumerate(names)]
    first = fresh.groupBy(*groups, F.col("_gen").alias("_g")).agg(F.min(F.struct(*order)).alias("_first"))
    firsts = seen.marked(first, [F.col(f"_k{i}") for i in range(len(names))], F.col("_g"), batch)
    same = [F.col(f).eqNullSafe(F.col(f"_k{i}")) for i, f in enumerate(names)]
    told = fresh.select(row.alias("_row"), *names, "_gen", F.struct(*order).alias("_order")).join(firsts, [*same, F.col("_gen") == F.col("_g")])
    fate = F.when(~F.col("seen") & (F.col("_order") == F.col("_first")), "kept").otherwise("duplicate")
    out = told.select("_row.*", fate.alias("fate")).unionByName(rows.where("_late").select(*df.columns, F.lit("late").alias("fate")))
    seen.add(fresh, keys, F.col("_gen"), batch)
    return out


def told_apart_stream(df: DataFrame, rule: DistinctRule, order: list[str], seen: SeenSet, path: str, write: Callable[[DataFrame, int], None]):
    """A writer of a stream whose rows are told apart; ``write`` gets rows with ``fate`` and the batch number and must replace a batch that it has."""

    def batch(rows: DataFrame, number: int) -> None:
        held = rows.persist()
        try:
            write(told_apart(held, rule, order, seen, f"{path}/ledger", number), number)
        finally:
            held.unpersist()

    return df.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/state")
