"""A stream definition to one lazy plan: split, extract, cast, envelope and a branch for each store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.extract import envelope, extract, typed
from ..operators.records import split_batch, split_multiline
from ..operators.sinks import fan_out
from ..spec import StreamSpec


def parsed(messages: DataFrame, spec: StreamSpec, value: str = "value", host: str = "local") -> DataFrame:
    """Messages to rows. Parameters ``batch`` (separator or ``json``) and ``start`` (record start) split first; empty ones go.

    With parameter ``typed`` text fields are cast as well.
    """
    params = dict(spec.params)
    df = messages.where(F.length(value) > 0)
    if start := params.get("start"):
        df = split_multiline(df, value, start)
    elif batch := params.get("batch"):
        df = split_batch(df, value, "array" if batch == "json" else "text", batch)
    df = extract(df, spec, value, host)
    return typed(df, spec.fields) if params.get("typed") == "true" else df


def build(messages: DataFrame, spec: StreamSpec, value: str = "value", host: str = "local", order: list[str] | None = None) -> dict[int, DataFrame]:
    """Rows of each store of a stream."""
    rows = envelope(parsed(messages, spec, value, host), host, order)
    return fan_out(rows, spec, order or [rows.columns[1]])
