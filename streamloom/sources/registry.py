"""Sources by name: SQL, JDBC, HTTP, sockets and user callables; each gives a table of messages."""

from __future__ import annotations

import importlib
import json
import struct
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..spec import POLLS, WAITS, StreamSpec
from ..types import cast_field


def sql_source(spark: SparkSession, spec: StreamSpec, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """The query of a definition over registered views, its columns picked by rule and cast."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    found = spark.sql(spec.scheme)
    names = {c.upper(): c for c in found.columns}
    out = []
    for f in spec.fields:
        have = names.get((f.src or f.name).upper())
        value = F.col(have) if have else F.lit(None).cast("string")
        out.append(cast_field(value, f.data_type, source=found.schema[have].dataType if have else None).alias(f.name))
    return found.select(*out)


def jdbc_source(spark: SparkSession, url: str, query: str, properties: dict[str, str] | None = None, split: tuple | None = None) -> DataFrame:
    """A whole query each time, in parallel if ``split`` (column, low, high, parts) is given."""
    reader = spark.read.format("jdbc").option("url", url).options(**properties or {})
    if split:
        col, low, high, parts = split
        reader = reader.option("dbtable", f"({query}) q").option("partitionColumn", col)
        return reader.option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).load()
    return reader.option("query", query).load()


def changed_since(definitions: DataFrame, time: str, since, order: str) -> DataFrame:
    return definitions.where(F.col(time) > F.lit(since)).orderBy(order)


class HttpSource(DataSource):
    """``messages_http``: posts ``contentKey`` with each of the ``sendContent`` values and gives the bodies."""

    @classmethod
    def name(cls) -> str:
        return "messages_http"

    def schema(self) -> str:
        return "request string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _HttpReader(dict(self.options))


class _HttpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.key = options["url"], options.get("contentkey", "content")
        self.values = json.loads(options.get("sendcontent", '[""]'))
        self.timeout, self.charset = float(options.get("timeout", 30_000)) / 1000, options.get("charset", "utf-8")
        self.retries = int(options.get("retries", 2))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(v) for v in self.values]

    def request(self, value: str) -> urllib.request.Request:
        return urllib.request.Request(self.url, urllib.parse.urlencode({self.key: value}).encode())

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """One request, sent again up to ``retries`` times when the connection fails."""
        for left in range(self.retries, -1, -1):
            try:
                with urllib.request.urlopen(self.request(partition.value), timeout=self.timeout) as reply:
                    body = reply.read().decode(self.charset, "replace")
                break
            except OSError:
                if not left:
                    raise
        yield partition.value, body


def soap_envelope(template: Column, fields: dict[str, Column]) -> Column:
    """An envelope around a template whose ``{name}`` parts give way to the escaped values."""
    body = template
    for name, value in fields.items():
        safe = value
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            safe = F.replace(safe, F.lit(a), F.lit(b))
        body = F.replace(body, F.lit("{" + name + "}"), safe)
    head, tail = '<soap:Envelope xmlns:soap="http://schemas.xmlsoap.org/soap/envelope/"><soap:Body>', "</soap:Body></soap:Envelope>"
    return F.concat(F.lit(head), body, F.lit(tail))


class SoapSource(HttpSource):
    """``messages_soap``: posts each of the ``sendContent`` values, whole XML texts, and gives the replies; pick a node with ``xpath_text``."""

    @classmethod
    def name(cls) -> str:
        return "messages_soap"

    def reader(self, schema) -> DataSourceReader:
        return _SoapReader(dict(self.options))


class _SoapReader(_HttpReader):
    def request(self, value: str) -> urllib.request.Request:
        return urllib.request.Request(self.url, value.encode("utf-8"), {"Content-Type": "text/xml; charset=utf-8", "SOAPAction": '""'})


class SocketSource(DataSource):
    """``messages_socket``: sends ``request`` to ``host``:``port`` and gives the length-prefixed frames of the answer."""

    @classmethod
    def name(cls) -> str:
        return "messages_socket"

    def schema(self) -> str:
        return "value binary"

    def reader(self, schema) -> DataSourceReader:
        return _SocketReader(dict(self.options))


class _SocketReader(DataSourceReader):
    def __init__(self, options: dict):
        self.address = options["host"], int(options["port"])
        self.request, self.batch = options.get("request", "").encode(), options.get("batch", "false") == "true"
        self.timeout = float(options.get("timeout", 30_000)) / 1000

    def read(self, partition) -> Iterator[tuple]:
        import socket

        with socket.create_connection(self.address, self.timeout) as s, s.makefile("rb") as f:
            s.sendall(self.request)
            left = struct.unpack(">i", f.read(4))[0] if self.batch else None
            while left != 0 and len(head := f.read(4)) == 4 and (n := struct.unpack(">i", head)[0]) > 0:
                data = f.read(n)
                if len(data) < n:
                    return
                yield (data,)
                left = None if left is None else left - 1


def callable_source(spark: SparkSession, dotted: str, argument: str = "") -> DataFrame:
    """Messages from ``package.module:function`` (text in, iterable of texts out), called on an executor."""
    if ":" not in dotted:
        raise ValueError(f"a callable is named module:function, not {dotted!r}")

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        module, _, name = dotted.partition(":")
        call: Callable = getattr(importlib.import_module(module), name)
        for pdf in batches:
            for arg in pdf["arg"]:
                yield pd.DataFrame({"value": [str(v) for v in call(arg)]})

    return spark.createDataFrame([(argument,)], "arg string").mapInPandas(run, "value string")


def landing_source(spark: SparkSession, path: str, schema: str = "topic string, content string, batch boolean") -> DataFrame:
    """What receivers of pushed messages (HTTP, SOAP, TCP) have written as JSON lines."""
    return spark.read.schema(schema).json(path)


def register(spark: SparkSession) -> None:
    from ..operators.send import SendStore
    from .archives import TarSource
    from .polls import PollSource
    from .tail import TailSource

    for source in (HttpSource, SoapSource, SocketSource, TailSource, PollSource, TarSource, SendStore):
        spark.dataSource.register(source)


def kind_of(spec: StreamSpec) -> str:
    """Name of the source of a trigger code."""
    found = POLLS.get(spec.trigger) or WAITS.get(spec.trigger)
    if not found:
        raise ValueError(f"unknown trigger {spec.trigger}")
    return found


def route(messages: DataFrame, specs: DataFrame, topic: str = "topic") -> tuple[DataFrame, DataFrame]:
    """Messages of known topics, and the rejected ones."""
    known = specs.select(topic).distinct()
    return messages.join(known, topic, "left_semi"), messages.join(known, topic, "left_anti")
