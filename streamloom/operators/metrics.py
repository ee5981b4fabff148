"""Counters, rates and roll-ups of what streams and stores did."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges


def counters(df: DataFrame, keys: list[str], size: Column, failed: Column) -> DataFrame:
    """Rows, bytes and failures for each key."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(size).cast("long").alias("bytes"), F.count_if(F.coalesce(failed, F.lit(False))).alias("failed")
    )


def roll_up(df: DataFrame, host: str, msg: str, measures: dict[str, Column]) -> DataFrame:
    """Per host, per message and in all, in one pass; ``level`` tells which."""
    level = F.when(F.grouping(host) == 0, "host").when(F.grouping(msg) == 0, "msg").otherwise("all").alias("level")
    sets = df.groupingSets([[F.col(host)], [F.col(msg)], []], F.col(host), F.col(msg))
    return sets.agg(level, *[c.alias(n) for n, c in measures.items()]).select("level", host, msg, *measures)


def nested_max(df: DataFrame, outer: list[str], inner: list[str], value: str, name: str) -> DataFrame:
    """Sum over the inner keys of the largest value of each."""
    return df.groupBy(*outer, *inner).agg(F.max(value).alias("_m")).groupBy(*outer).agg(F.sum("_m").alias(name))


def deltas(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "delta") -> DataFrame:
    """Difference to the snapshot before; null for the first."""
    return df.withColumn(name, F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))


def rates(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Sum of deltas over number of steps, whole division; null for a single snapshot."""
    steps = deltas(df, keys, order, value, "_d").groupBy(*keys).agg(F.sum("_d").alias("_s"), F.count("*").alias("_n"))
    return steps.select(*keys, F.when(F.col("_n") > 1, F.expr("_s div (_n - 1)")).alias("rate"))


def last_snapshots(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by a maximum that combines before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_r")).select("_r.*")


def ring(df: DataFrame, keys: list[str], order: list[Column], size: int = 5) -> DataFrame:
    """The newest ``size`` rows of each key with their place."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= size)


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Sum up to each row; ``order`` needs a tie-break. A key may fill many tasks."""
    return ranges.summed(df, keys, [F.col(c) for c in order], value, name)


def throughput(df: DataFrame, time: str, seconds: int = 5) -> DataFrame:
    """Rows a second, whole division, in each window of so many seconds."""
    ms = F.unix_millis(F.col(time).cast("timestamp"))
    start = (ms - F.pmod(ms, F.lit(seconds * 1000))).alias("window_ms")
    return df.groupBy(start).agg(F.count("*").alias("n")).withColumn("per_second", F.expr(f"n div {seconds}"))


def collect_log(df: DataFrame, msg: str, time: str, size: Column, minutes: int) -> DataFrame:
    """A log row for each message and interval: first and last time, bytes and rows."""
    ms = F.unix_millis(F.col(time).cast("timestamp"))
    slot = (ms - F.pmod(ms, F.lit(minutes * 60_000))).alias("slot_ms")
    return df.groupBy(msg, slot).agg(
        F.min(ms).alias("start_ms"), F.max(ms).alias("end_ms"), F.sum(size).cast("long").alias("bytes"), F.count("*").alias("n")
    )


def bucket_stats(counts: DataFrame, value: str, low: int = 15, high: int = 85) -> DataFrame:
    """Spread of bucket sizes: number, empty, small, large, extremes, sum, mean and population variance."""
    v = F.col(value)
    return counts.agg(
        F.count("*").alias("buckets"), F.count_if(v == 0).alias("empty"), F.count_if(v < low).alias("small"),
        F.count_if(v > high).alias("large"), F.min(v).alias("least"), F.max(v).alias("most"), F.sum(v).alias("total"),
        F.avg(v).alias("mean"), F.var_pop(v).alias("variance"),
    )


def chain_histogram(df: DataFrame, key: str) -> DataFrame:
    """How many keys have how many rows."""
    return df.groupBy(key).agg(F.count("*").alias("depth")).groupBy("depth").agg(F.count("*").alias("n_keys"))


def accumulate(old: DataFrame, new: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Upsert that adds: rows of equal keys are summed."""
    return old.unionByName(new).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def joined(df: DataFrame, keys: list[str], value: str, sep: str) -> DataFrame:
    """The distinct texts of each key in order, between separators."""
    return df.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set(value)), sep).alias(value))


def merged_by(df: DataFrame, keys: list[str], name: str, value: str, out: str) -> DataFrame:
    """A map of each key's names to the sums of their values."""
    each = df.groupBy(*keys, name).agg(F.sum(value).alias(value))
    return each.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, value)))).alias(out))


def best(df: DataFrame, value: str, order: list[str], least: bool = True) -> DataFrame:
    """The ``value`` of the row that is least (or largest) by ``order``."""
    return df.agg((F.min_by if least else F.max_by)(value, F.struct(*order)).alias(value))


def counted_log(df: DataFrame, msg: str, order: list[str], time: str, size: Column, rows: int = 1000) -> DataFrame:
    """A log row for each message and so many rows: number, first and last time, bytes and rows. ``order`` needs a tie-break; a message may fill many tasks."""
    ms = F.unix_millis(F.col(time).cast("timestamp"))
    each = ranges.placed(df.withColumn("_size", size), [msg], [F.col(c) for c in order], "_place")
    part = F.floor((F.col("_place") - 1) / rows).cast("int").alias("part")
    return each.groupBy(msg, part).agg(F.min(ms).alias("start_ms"), F.max(ms).alias("end_ms"), F.sum("_size").cast("long").alias("bytes"), F.count("*").alias("n"))


def snapshot_json(df: DataFrame, host: str, measures: list[str]) -> DataFrame:
    """A JSON text for each host, ready to publish."""
    return df.select(host, F.to_json(F.struct(*measures)).alias("snapshot"))


def html_rows(df: DataFrame) -> DataFrame:
    """``value``: a table row for each row, escaped; a null is empty."""
    safe = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    cells = [safe(F.col(c)) for c in df.columns]
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        cells = [F.replace(c, F.lit(a), F.lit(b)) for c in cells]
    return df.select(F.concat(F.lit("<tr>"), *[x for c in cells for x in (F.lit("<td>"), c, F.lit("</td>"))], F.lit("</tr>")).alias("value"))


def html_page(df: DataFrame, title: str) -> Iterator[str]:
    """The parts of a report page of all rows in their order; rows come to the driver one partition at a time."""
    import html

    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    yield f"<html><head><title>{html.escape(title)}</title></head><body><table><tr>{head}</tr>"
    yield from (r.value for r in html_rows(df).toLocalIterator())
    yield "</table></body></html>"


#: Declared group methods.
GROUP_METHODS = {"COUNT": F.count, "MAX": F.max, "MIN": F.min, "SUM": F.sum, "AVG": F.avg}


def group_by_method(df: DataFrame, keys: list[str], outputs: list[tuple[str, str, object]]) -> DataFrame:
    """``outputs``: (name, method, field); ``FUN`` takes a function of a Column, ``NONE`` any value of the group."""
    made = []
    for name, method, field in outputs:
        if method == "FUN":
            made.append(field.alias(name))
        elif method == "NONE":
            made.append(F.any_value(field).alias(name))
        else:
            made.append(GROUP_METHODS[method](field).alias(name))
    return df.groupBy(*keys).agg(*made)
