"""Polls as streams: an offset is the number of a poll, and what a poll has fetched is kept until it is committed."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..spec import StreamSpec
from . import shared
from .files import delete, list_dir
from .registry import _HttpReader, sql_source


class PollSource(DataSource):
    """``poll_http``: ``poll``, ``request`` and ``value`` for each reply to ``sendcontent``, posted once a poll.

    Options as for ``messages_http``, and ``keep`` (a shared folder), ``interval`` (milliseconds
    between polls). Each request is a task. Its reply is written to ``keep`` before it is handed
    over, so that a task or batch that runs again reads it there and asks nobody twice; it goes
    once the batch is committed. Without ``url`` a poll only gives its number: a clock.
    """

    @classmethod
    def name(cls) -> str:
        return "poll_http"

    def schema(self) -> str:
        return "poll long, request string, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PollReader(dict(self.options))


class Request(InputPartition):
    def __init__(self, poll: int, value: str):
        self.poll, self.value = poll, value


class PollReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.keep, self.interval = options["keep"].rstrip("/"), float(options.get("interval", 0)) / 1000
        self.http = _HttpReader(options) if options.get("url") else None
        self.values = json.loads(options.get("sendcontent", '[""]'))

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def latestOffset(self) -> dict:
        """One poll more than the last one planned once the interval is over; the plan is written, as a new reader goes on from it."""
        planned = shared.get_json(f"{self.keep}/plan.json", {"poll": 0, "at": 0.0})
        if time.time() >= planned["at"] + self.interval:
            planned = {"poll": planned["poll"] + 1, "at": time.time()}
            shared.put_json(f"{self.keep}/plan.json", planned)
        return {"poll": planned["poll"]}

    def partitions(self, start: dict, end: dict) -> list[Request]:
        return [Request(k, v) for k in range(start["poll"], end["poll"]) for v in self.values]

    def kept(self, poll: int, value: str = "") -> str:
        return f"{self.keep}/poll-{poll}/{hashlib.sha256(value.encode()).hexdigest()[:32]}.json"

    def read(self, partition: Request) -> Iterator[tuple]:
        poll, value = partition.poll, partition.value
        if self.http is None:
            yield poll, value, None
            return
        reply = shared.get_json(self.kept(poll, value))
        if reply is None:
            reply = next(self.http.read(InputPartition(value)))[1]
            shared.put_json(self.kept(poll, value), reply)
        yield poll, value, reply

    def commit(self, end: dict) -> None:
        found = {f.path.rpartition("/")[0].rpartition("/poll-")[2] for f in shared.listed(self.keep, recursive=True)}
        for k in found:
            if k.isdigit() and int(k) < end["poll"]:
                shared.drop(f"{self.keep}/poll-{k}")


def poll_sql(spark: SparkSession, spec: StreamSpec, write: Callable[[DataFrame, int], None], folder: str, interval_ms: int = 0, fetch: Callable[[], DataFrame] | None = None):
    """A writer of a stream that runs the whole query of a definition at each poll.

    ``fetch`` gives the rows, by default those of ``sql_source``. They are written below ``folder``
    once and read from there, so a batch that runs again neither asks again nor sees other rows;
    ``write`` gets them with the batch number. Start it with a trigger.
    """
    fetch = fetch or (lambda: sql_source(spark, spec))

    def batch(polls: DataFrame, number: int) -> None:
        path = f"{folder}/fetched-{number}"
        if "_SUCCESS" not in dict(list_dir(spark, path)):
            fetch().write.mode("overwrite").parquet(path)
        write(spark.read.parquet(path), number)
        delete(spark, f"{folder}/fetched-{number - 1}")

    clock = spark.readStream.format("poll_http").option("keep", f"{folder}/clock").option("interval", interval_ms).load()
    return clock.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/state")
