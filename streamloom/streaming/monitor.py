"""What streams report, how much the next batch may take, and what all stores have passed."""

from __future__ import annotations

import json
import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..sources import shared
from ..sources.files import delete, list_dir


class Progress(StreamingQueryListener):
    """Writes a row for each batch of each stream to JSON files below ``folder``; ``table`` reads them.

    Spark itself keeps the last hundred batches of a stream. Here rows go to disk when ``rows`` of
    them are there and when a stream ends, so no batch is missing from a stream of any length. With
    ``bounds`` (query name to a file) the bound of a stream's next batch follows its last one: see ``Rate``.
    """

    def __init__(self, folder: str, host: str = "local", rows: int = 50, bounds: dict | None = None):
        self.folder, self.host, self.rows, self.bounds = folder, host, rows, bounds or {}
        self.held: list[dict] = []
        self.last: dict[str, int] = {}
        self.files = 0
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        return

    def onQueryIdle(self, event) -> None:
        return

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = {"host": self.host, "id": str(p.id), "run": str(p.runId), "name": p.name, "batch": int(p.batchId), "time": p.timestamp, "n": int(p.numInputRows), "ms": int(p.batchDuration)}
        row["late"] = sum(int(s.numRowsDroppedByWatermark) for s in p.stateOperators)
        row["state"] = sum(int(s.numRowsTotal) for s in p.stateOperators)
        if rate := self.bounds.get(p.name):
            rate.after(row["n"], row["ms"])
        with self.lock:
            self.held.append(row)
            self.last[row["id"]] = row["batch"]
        if len(self.held) >= self.rows:
            self.flush()

    def onQueryTerminated(self, event) -> None:
        self.flush()

    def wait_for(self, query: str, batch: int, seconds: float = 30.0) -> bool:
        """Waits until a batch of a query has been reported: reports come some time after their batch."""
        end = time.monotonic() + seconds
        while (query, batch) not in self.last.items() and time.monotonic() < end:
            time.sleep(0.05)
        return self.last.get(query) == batch

    def flush(self) -> None:
        with self.lock:
            rows, self.held = self.held, []
            number, self.files = self.files, self.files + bool(rows)
        if rows:
            shared.put(f"{self.folder}/{self.host}-{id(self):x}-{number}.json", "".join(json.dumps(r) + "\n" for r in rows).encode())

    def table(self, spark: SparkSession) -> DataFrame:
        """A row for each batch; of a batch that was reported again the last report."""
        self.flush()
        rows = spark.read.schema("host string, id string, run string, name string, batch long, time string, n long, ms long, late long, state long").json(self.folder)
        return rows.groupBy("id", "batch").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("id", "batch")]), "time").alias("r")).select("id", "batch", "r.*")


class Rate:
    """The bound of a stream's next batch, in a file that the source reads (``boundfile`` of ``tail_text``).

    A batch that took longer than ``goal_ms`` lowers the bound in proportion, down to ``least``; one
    that took less than half raises it by half at most, up to ``most``.
    """

    def __init__(self, path: str, first: int, goal_ms: int, least: int = 1, most: int = 1 << 40):
        self.path, self.now, self.goal, self.least, self.most = path, first, goal_ms, least, most
        shared.put(path, str(first).encode())

    def after(self, rows: int, ms: int) -> int:
        """Takes a batch's rows and time; an empty batch says nothing."""
        if rows and ms > self.goal:
            self.now = max(self.least, int(self.now * self.goal / ms))
        elif rows and 2 * ms < self.goal:
            self.now = min(self.most, int(self.now * min(1.5, self.goal / max(1, 2 * ms))) + 1)
        shared.put(self.path, str(self.now).encode())
        return self.now


def committed_files(spark: SparkSession, checkpoint: str, source: int = 0) -> DataFrame | None:
    """``path`` of the files that the committed batches of a file stream have read, from its checkpoint; null before the first commit."""
    done = [int(n) for n, _ in list_dir(spark, f"{checkpoint}/commits") if n.isdigit()]
    if not done:
        return None
    lines = spark.read.text(f"{checkpoint}/sources/{source}").where(F.col("value").startswith("{"))
    found = lines.select(F.from_json("value", "path string, timestamp long, batchId long").alias("f")).select("f.*")
    return found.where((F.col("batchId") <= max(done)) & F.col("path").isNotNull()).select("path").distinct()


def passed_by_all(spark: SparkSession, checkpoints: list[str]) -> DataFrame:
    """``path`` of the files that every one of the streams has read and committed."""
    found = [committed_files(spark, c) for c in checkpoints]
    if not found or any(f is None for f in found):
        return spark.createDataFrame([], "path string")
    every = found[0]
    for f in found[1:]:
        every = every.join(f, "path", "left_semi")
    return every


def delete_passed(spark: SparkSession, checkpoints: list[str]) -> int:
    """Deletes the files that all stores have passed, so that the slowest one decides; gives their number. Files that are gone already don't count."""
    n = 0
    for row in passed_by_all(spark, checkpoints).toLocalIterator():
        n += delete(spark, row.path)
    return n
