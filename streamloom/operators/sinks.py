"""Stores: delimited text, keyed tables, key and value rows, JDBC, and the fan-out of a stream to all of them."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import HOST, LOG_ID, FieldSpec, StoreSpec, StreamSpec
from ..sources.files import create_new, delete, list_dir, move
from ..types import TIME, cast_field, field_type
from .dedup import first_arrivals
from .expr import compile_rule, drop_rows
from .records import split_frames

#: Codec names of the text store and Spark's names for them.
CODECS = {"default": "deflate", "deflate": "deflate", "bzip2": "bzip2", "gzip": "gzip", "snappy": "snappy", "none": "none"}


def shown(name: str, declared: str | None, time_format: str | None = None) -> Column:
    """A field as text: times by format, blobs as hex, null as an empty text."""
    kind, col = field_type(declared), F.col(name)
    if kind.code == TIME and time_format:
        text = F.coalesce(F.date_format(F.timestamp_millis(col.try_cast("bigint")), time_format), col.cast("string"))
    else:
        text = F.lower(F.hex(col)) if kind.code == 16 else col.cast("string")
    return F.coalesce(text, F.lit(""))


def delimited(df: DataFrame, fields: list[FieldSpec], sep: str = ",", time_format: str | None = None) -> DataFrame:
    """One ``value``: host, log id and fields between separators."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (HOST, LOG_ID) if c in df.columns]
    return df.select(F.concat_ws(sep, *parts, *[shown(f.name, f.data_type, time_format) for f in fields]).alias("value"))


def write_text(
    df: DataFrame, path: str, fields: list[FieldSpec], sep: str = ",", line: str = "\n", codec: str = "none", day: str | None = None,
    rows_per_file: int = 0, time_format: str | None = None, mode: str = "append",
) -> None:
    """Text files, a folder for each ``day`` if a column is given, rolled by rows."""
    if day:
        out = delimited(df, fields, sep, time_format).columns
        text = df.select(F.date_format(F.col(day), "yyyyMMdd").alias("day"), *[c for c in df.columns if c != "day"])
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (HOST, LOG_ID) if c in df.columns]
        text = text.select("day", F.concat_ws(sep, *parts, *[shown(f.name, f.data_type, time_format) for f in fields]).alias(out[0]))
    else:
        text = delimited(df, fields, sep, time_format)
    writer = text.write.mode(mode).option("lineSep", line).option("compression", CODECS[codec.lower()])
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy("day") if day else writer).text(path)


def partition_key(df: DataFrame, rule: str | None) -> Column:
    """``1:f``: the field; ``2:f1,f2``: the texts of the fields in the order of the columns; else a number from the row's hash, equal when a task runs again."""
    kind, _, names = (rule or "").partition(":")
    wanted = {n.strip().upper() for n in names.split(",") if n.strip()}
    chosen = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns if c.upper() in wanted]
    if kind == "1" and chosen:
        return chosen[0]
    if kind == "2" and chosen:
        return F.concat(*chosen)
    return F.pmod(F.xxhash64(*df.columns), F.lit(1 << 31)).cast("string")


def number_partition(key: Column, n: int) -> Column:
    return F.abs(key.cast("bigint")) % n


def java_hash(text: Column) -> Column:
    """The 32-bit string hash of the JVM, over UTF-16 units; null for null."""
    units = F.encode(text, "UTF-16BE")
    unit = lambda i: F.conv(F.hex(F.substring(units, i * 2 + 1, F.lit(2))), 16, 10).cast("bigint")
    n = F.floor(F.length(units) / 2).cast("int")
    places = F.filter(F.sequence(F.lit(0), n), lambda i: i < n)
    total = F.aggregate(F.transform(places, unit), F.lit(0).cast("bigint"), lambda h, u: (h * 31 + u) % (1 << 32))
    return F.when(total >= 1 << 31, total - (1 << 32)).otherwise(total).cast("int")


def text_partition(key: Column, n: int) -> Column:
    """Absolute hash modulo ``n``; the smallest hash, whose absolute value overflows, goes to partition 0."""
    h = java_hash(key).cast("bigint")
    return F.when(h == -(1 << 31), 0).otherwise(F.abs(h) % n)


def key_value(df: DataFrame, topic: str, rule: str | None, fields: list[FieldSpec]) -> DataFrame:
    """Rows for a message queue: ``topic``, ``key`` and ``value`` (JSON)."""
    return df.select(F.lit(topic).alias("topic"), partition_key(df, rule).alias("key"), F.to_json(F.struct(*[f.name for f in fields])).alias("value"))


def row_key(df: DataFrame, rule: str) -> Column:
    """A key from a rule, or from a template with ``{field}`` parts."""
    if "{" not in rule:
        return compile_rule(rule, df.schema)[0].cast("string")
    names = {c.upper(): c for c in df.columns}
    parts: list[Column] = []
    for i, part in enumerate(rule.replace("}", "{").split("{")):
        parts.append(F.coalesce(F.col(names[part.strip().upper()]).cast("string"), F.lit("")) if i % 2 else F.lit(part))
    return F.concat(*parts)


def keyed_table(df: DataFrame, rule: str, fields: list[FieldSpec], merged: str | None = None, time_format: str | None = None) -> DataFrame:
    """``row_key`` with a column for each field, or one merged ``cell``."""
    cells = [shown(f.name, f.data_type, time_format) for f in fields]
    made = [F.concat_ws(merged, *cells).alias("cell")] if merged is not None else [c.alias(f.name) for c, f in zip(cells, fields)]
    return df.select(row_key(df, rule).alias("row_key"), *made)


def spilled(df: DataFrame, names: list[str], sep: str = "^") -> DataFrame:
    """``value``: the fields as text between separators, behind their length in four bytes; ``unspilled`` reads it."""
    text = F.encode(F.concat_ws(sep, *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names]), "UTF-8")
    return df.select(F.concat(F.unhex(F.lpad(F.hex(F.octet_length(text)), 8, "0")), text).alias("value"))


def unspilled(df: DataFrame, fields: list[FieldSpec], value: str = "value", sep: str = "^") -> DataFrame:
    """Spilled content, many records in one value or one, to typed fields. No field may hold the separator."""
    text = F.decode(F.col(value), "UTF-8")
    parts = F.split(text, re.escape(sep), -1)
    each = split_frames(df.select(value), value).select(parts.alias("_p"))
    return each.select(*[cast_field(F.get("_p", F.lit(i)), f.data_type).alias(f.name) for i, f in enumerate(fields)])


#: Suffixes that a codec adds to a file name.
SUFFIXES = {"deflate": ".deflate", "bzip2": ".bz2", "gzip": ".gz", "snappy": ".snappy", "none": ""}


def next_sequence(names: list[str], prefix: str, host: str, day: str) -> int:
    """One above the largest sequence number of the files of a host and day."""
    rule = re.compile(re.escape(f"{prefix}_{host}_{day}.") + r"(\d+)\.")
    return max((int(m[1]) for n in names if (m := rule.match(n))), default=-1) + 1


def write_named(df: DataFrame, path: str, prefix: str, host: str, suffix: str = "dat", day: str | None = None, codec: str = "none", max_bytes: int = 1 << 26) -> list[str]:
    """Files ``prefix_host_yyyyMMdd.seq.suffix[.codec]`` of about ``max_bytes`` of text, by day of the column ``day`` (a
    text) or today. ``df`` has one text column ``value`` beside it.

    Spark writes into a folder whose name ends with ``~``; files are then moved to their names, one
    by one, with numbers that go on from those that are there. A number is taken by a hidden file
    that only one writer can make, so writers of one host and day may run at the same time; they
    get different numbers. Rows a file come from the mean size.
    """
    spark, codec = df.sparkSession, CODECS[codec.lower()]
    sized = df.agg(F.avg(F.octet_length("value") + 1)).first()[0]
    if sized is None:
        return []
    rows = df.select("value", (F.col(day) if day else F.date_format(F.current_timestamp(), "yyyyMMdd")).alias("_day"))
    stage = f"{path.rstrip('/')}/{prefix}_{host}_{uuid.uuid4().hex[:8]}~"
    writer = rows.write.partitionBy("_day").option("compression", codec).option("maxRecordsPerFile", max(1, int(max_bytes / sized)))
    writer.text(stage)
    there = [n for n, _ in list_dir(spark, path)]
    made = []
    for folder, _ in list_dir(spark, stage):
        if not folder.startswith("_day="):
            continue
        named = f"{prefix}_{host}_{folder[5:]}"
        number = next_sequence(there, prefix, host, folder[5:])
        for name, _ in sorted(list_dir(spark, f"{stage}/{folder}")):
            if name.startswith("part-"):
                while not create_new(spark, f"{path}/.{named}.{number}"):
                    number += 1
                made.append(f"{named}.{number}.{suffix}{SUFFIXES[codec]}")
                move(spark, f"{stage}/{folder}/{name}", f"{path}/{made[-1]}")
                number += 1
    delete(spark, stage)
    return made


def write_jdbc(df: DataFrame, url: str, name: str, properties: dict[str, str] | None = None) -> None:
    df.write.jdbc(url, name, mode="append", properties=properties or {})


#: Row hooks by name, applied before a store writes.
HOOKS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def branch(df: DataFrame, store: StoreSpec, order: list[str]) -> DataFrame:
    """What a store gets of a stream: its filter first, then its duplicates, then its hook."""
    out = drop_rows(df, store.filter_rule)
    if store.distinct:
        out = first_arrivals(out, store.distinct, order)
    return HOOKS[store.plugin](out) if store.plugin else out


def fan_out(df: DataFrame, spec: StreamSpec, order: list[str]) -> dict[int, DataFrame]:
    """Each active store's rows; every store sees every row of the stream."""
    return {s.store_id: branch(df, s, order) for s in spec.stores if s.state == 1}


def write_stores(df: DataFrame, spec: StreamSpec, order: list[str], write: Callable[[StoreSpec, DataFrame], None]) -> None:
    """Writes all stores of a batch, which is read once."""
    kept = df.persist()
    try:
        for store in spec.stores:
            if store.state == 1:
                write(store, branch(kept, store, order))
    finally:
        kept.unpersist()


def detail_log(df: DataFrame, spec: StreamSpec, store: StoreSpec, kind: str, time: str) -> DataFrame:
    """A side output: what happened to a row, with its content as ``[a|b|c]``."""
    content = F.concat(F.lit("["), F.concat_ws("|", *[F.coalesce(F.col(f.name).cast("string"), F.lit("")) for f in spec.fields]), F.lit("]"))
    return df.select(
        F.lit(spec.msg_id).alias("msg_id"), F.lit(store.store_id).alias("store_id"), F.col(LOG_ID).alias("log_sn"),
        F.col(time).alias("time"), F.lit(kind).alias("type"), content.alias("content"), F.col(HOST).alias("host"),
    )
