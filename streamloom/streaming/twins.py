"""Streaming forms of the batch operators, and runs of them to the end of their input."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.expr import compile_rule, drop_rows, truthy
from ..operators.sinks import HOOKS
from ..operators.topology import Dimension, Lookup, look_up
from ..sources.files import shared_folder
from ..spec import DistinctRule, StoreSpec, StreamSpec, needs_restart


def read_events(spark: SparkSession, path: str, schema=None, files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over a folder or one file; back-pressure by files in a batch."""
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(re.sub(r"(\w)(?=\.parquet$)", r"[\1]", path))  # as a pattern, one file will do


def dedup_stream(df: DataFrame, rule: DistinctRule, delay: str | None = None) -> DataFrame:
    """One row of each group of duplicates in its tumbling window, kept apart by the window itself.

    The watermark lets state go once the window and ``check_range`` more are past; older rows are late and go. Batches of any
    size give the same groups.
    """
    time = rule.time_field
    if not time:
        raise ValueError("a stream needs a time field to bound its state")
    width = f"{rule.window_ms} milliseconds"
    stamped = df.withColumn(time, F.col(time).cast("timestamp"))
    marked = stamped.withWatermark(time, delay or f"{rule.window_ms * rule.check_range} milliseconds").withColumn("_window", F.window(time, width)["start"])
    keys = [*rule.fields, *([rule.part_field] if rule.part_field else []), "_window"]
    return marked.dropDuplicates(keys).drop("_window")


def counter_stream(df: DataFrame, keys: list[str], size: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("bytes"))


def window_stream(df: DataFrame, time: str, width: str, keys: list[str], delay: str = "0 seconds") -> DataFrame:
    """Rows of each tumbling window, sent once the watermark is past."""
    marked = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return marked.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(
        F.unix_millis("w.start").alias("window_ms"), *keys, "n"
    )


def late_rows(df: DataFrame, time: str, horizon: Column) -> DataFrame:
    """A side output of what the watermark would drop."""
    return df.where(F.col(time) < horizon)


def change_only_stream(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before in their key, in order of arrival; state is one text a key."""

    def run(found, batches, state):
        import pandas as pd

        last = state.get[0] if state.exists else None
        seen = state.exists
        for pdf in batches:
            out = []
            for v in pdf[value]:
                v = None if v is None or v != v else str(v)
                if not seen or v != last:
                    out.append(v)
                last, seen = v, True
            yield pd.DataFrame({key: [found[0]] * len(out), value: out})
        state.update((last,))

    kind = dict(df.dtypes)[key]
    return df.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, `{value}` string", "last string", "append", "NoTimeout")


def look_up_stream(df: DataFrame, dim: Dimension, rule: Lookup, write: Callable[[DataFrame, int], None], event: str | None = None):
    """A writer of a stream with a dimension that is looked up in each batch.

    The dimension is loaded when its cycle is over, when the stream starts, and before a batch that has
    a row for which the rule ``event`` holds. ``write`` gets the rows and the batch number. ``dim``
    should load a snapshot that stays as it is while a batch runs.
    """

    def batch(rows: DataFrame, number: int) -> None:
        if event and not rows.where(truthy(*compile_rule(event, rows.schema))).isEmpty():
            dim.refresh()
        write(look_up(rows, dim.table(), rule), number)

    return df.writeStream.foreachBatch(batch)


def trigger_of(interval: str | None) -> dict:
    """``processingTime`` with an interval (the poll period), else all there is, once."""
    return {"processingTime": interval} if interval else {"availableNow": True}


def run_to_end(writer) -> object:
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return query


def finish(df: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over all there is and gives its result.

    Appended rows go to Parquet in the shared folder and are read from there. Only the result of
    ``complete`` mode, which is one row for each group, is kept in memory.
    """
    writer = df.writeStream.outputMode(mode)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    if mode == "append":
        path = shared_folder(df.sparkSession)
        writer = writer if checkpoint else writer.option("checkpointLocation", f"{path}/state")
        run_to_end(writer.format("parquet").option("path", f"{path}/rows"))
        return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
    name = f"t{uuid.uuid4().hex}"
    run_to_end(writer.format("memory").queryName(name))
    return df.sparkSession.table(name)


def drain(queries: list, timeout: float = 60.0) -> None:
    """Stops streams once they have worked off what has come in."""
    for query in queries:
        if query.isActive:
            query.processAllAvailable()
            query.stop()
            query.awaitTermination(timeout)


class Running:
    """The streams of a worker: definitions in, queries started, kept or started anew."""

    def __init__(self, start: Callable[[StreamSpec], list]):
        self.start, self.specs, self.queries = start, {}, {}

    def apply(self, specs: dict[str, StreamSpec]) -> dict[str, str]:
        """What was done to each stream: ``start``, ``stop``, ``restart`` or ``keep``."""
        done = {}
        for name in sorted({*self.specs, *specs}):
            old, new = self.specs.get(name), specs.get(name)
            done[name] = "stop" if new is None else "start" if old is None else "restart" if old != new and needs_restart(old, new) else "keep"
            if done[name] in ("stop", "restart"):
                drain(self.queries.pop(name, []))
                self.specs.pop(name, None)
            if done[name] in ("start", "restart"):
                self.queries[name] = self.start(new)
            if new is not None:
                self.specs[name] = new
        return done


def start_stores(df: DataFrame, spec: StreamSpec, write: Callable[[StoreSpec, DataFrame, int], None], checkpoints: str, interval: str | None = None) -> list:
    """One query for each active store, each with its own checkpoint; ``write`` gets the batch id to be idempotent.

    ``interval`` is the time between batches; without it all there is is done once.
    """
    queries = []
    for store in spec.stores:
        if store.state != 1:
            continue
        out = drop_rows(df, store.filter_rule)
        out = dedup_stream(out, store.distinct) if store.distinct else out

        def batch(rows: DataFrame, number: int, store: StoreSpec = store) -> None:
            write(store, HOOKS[store.plugin](rows) if store.plugin else rows, number)

        start = out.writeStream.queryName(f"{spec.name}_{store.store_id}").foreachBatch(batch)
        queries.append(start.option("checkpointLocation", f"{checkpoints}/{store.store_id}").trigger(**trigger_of(interval)).start())
    return queries
