"""A store that sends: tasks hand chunks over, and only the chunks of a committed batch count."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

from ..sources import shared


class SendStore(DataSource):
    """``message_store``: posts rows ``topic``, ``key``, ``value`` to ``url``, which ``receiver.store_server`` shows how to take.

    Options: ``source`` (a name for the stream, the same after a restart), ``rows`` of a chunk,
    ``retries`` and ``timeout`` of a request, ``rejected`` (a folder for rows that the other side
    doesn't take: JSON lines with a ``reason``, visible with their batch).

    A task posts chunks under names of its own and tells the driver which were taken; a commit names
    those of the whole batch and its number, an abort gives them up. The other side shows a batch's
    chunks at its commit and ignores a batch that it has, so a task that fails and runs again, or a
    batch that does, neither loses nor doubles a row.
    """

    @classmethod
    def name(cls) -> str:
        return "message_store"

    def schema(self) -> str:
        return "topic string, key string, value string"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return SendWriter(dict(self.options))


@dataclass
class Sent(WriterCommitMessage):
    chunks: list[str]
    rejected: list[str]
    rows: int


class SendWriter(DataSourceStreamWriter):
    def __init__(self, options: dict):
        self.url, self.source = options["url"].rstrip("/"), options["source"]
        self.size, self.retries = int(options.get("rows", 1000)), int(options.get("retries", 3))
        self.timeout, self.folder = float(options.get("timeout", 30_000)) / 1000, options.get("rejected")
        self.pause = float(options.get("pause", 200)) / 1000

    def post(self, path: str, body: object) -> object:
        """The reply to a request, which is sent again after a pause that grows while the connection or the other side fails."""
        data = json.dumps(body).encode()
        for k in range(self.retries + 1):
            try:
                request = urllib.request.Request(f"{self.url}/{path}", data, {"Content-Type": "application/json"})
                with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                    return json.loads(reply.read() or b"null")
            except OSError as e:
                if k == self.retries or isinstance(e, urllib.error.HTTPError) and e.code < 500:
                    raise
                time.sleep(self.pause * 2**k)

    def write(self, iterator: Iterator) -> Sent:
        sent = Sent([], [], 0)
        held: list[list] = []
        for row in iterator:
            held.append([row["topic"], row["key"], row["value"]])
            if len(held) == self.size:
                self.hand_over(held, sent)
                held = []
        if held:
            self.hand_over(held, sent)
        return sent

    def hand_over(self, rows: list[list], sent: Sent) -> None:
        name = uuid.uuid4().hex
        refused = self.post(f"stage/{name}", rows) or []
        sent.chunks.append(name)
        sent.rows += len(rows) - len(refused)
        if refused and self.folder:
            lines = [json.dumps(dict(zip(("topic", "key", "value"), rows[i])) | {"reason": why}) for i, why in refused]
            sent.rejected.append(f"{self.folder}/_{name}.json")  # hidden until the commit
            shared.put(sent.rejected[-1], ("\n".join(lines) + "\n").encode())

    def commit(self, messages: list, batchId: int) -> None:
        done = [m for m in messages if m is not None]
        fresh = self.post("commit", {"source": self.source, "batch": batchId, "chunks": [c for m in done for c in m.chunks]})
        for path in (p for m in done for p in m.rejected):
            data = shared.get(path) if fresh else None
            if data:
                shared.put(path.replace("/_", f"/batch-{batchId}-"), data)
            shared.drop(path)

    def abort(self, messages: list, batchId: int) -> None:
        done = [m for m in messages if m is not None]
        self.post("abort", {"chunks": [c for m in done for c in m.chunks]})
        for path in (p for m in done for p in m.rejected):
            shared.drop(path)


def send(df: DataFrame, checkpoint: str, **options):
    """A writer of a stream of ``topic``, ``key`` and ``value`` to ``message_store``; start it with a trigger."""
    return df.select("topic", "key", "value").writeStream.format("message_store").options(**options).option("checkpointLocation", checkpoint)
