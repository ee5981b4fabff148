"""Declared field types, their Spark types and the typed cast."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Type codes of the wire format, and the date formats of bare types.
TEXT, WHOLE, REAL, TIME, BYTES = 1, 2, 4, 8, 16
DEFAULT_FORMAT, COMPACT_FORMAT = "yyyy-MM-dd HH:mm:ss", "yyyyMMddHHmmss"


@dataclass(frozen=True)
class FieldType:
    code: int
    time_format: str | None = None

    @property
    def spark(self) -> T.DataType:
        return {WHOLE: T.LongType(), REAL: T.DoubleType(), TIME: T.LongType(), BYTES: T.BinaryType()}.get(self.code, T.StringType())


def field_type(declared: str | None) -> FieldType:
    """``NUMBER`` is a long, ``NUMBER(...)`` a double, ``DATE`` and ``TIME_...`` epoch ms, ``BLOB`` bytes, the rest text.

    The format inside ``TIME_STR(...)`` keeps its case, whatever the case of the name.
    """
    text = (declared or "").strip()
    name = text.upper()
    if name == "NUMBER":
        return FieldType(WHOLE)
    if name.startswith("NUMBER("):
        return FieldType(REAL)
    if name in ("DATE", "TIME_LONG"):
        return FieldType(TIME, DEFAULT_FORMAT)
    if name == "TIME_STR":
        return FieldType(TIME, COMPACT_FORMAT)
    if m := re.fullmatch(r"(?i)TIME_STR\((.+)\)", text):
        return FieldType(TIME, m[1])
    return FieldType(BYTES) if name == "BLOB" else FieldType(TEXT)


def epoch_millis(value: Column, time_format: str) -> Column:
    """Text by its format, else a number as it is, else null."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(value, F.lit(time_format))), value.try_cast("bigint"))


def cast_field(value: Column, declared: str | None, default: object = None, source: T.DataType | None = None) -> Column:
    """``value`` as its declared type; what can't be read is ``default``, for times 0 if none is given.

    Epoch milliseconds and timestamps of a time field pass as they are.
    """
    kind = field_type(declared)
    if kind.code == TIME:
        if isinstance(source, (T.TimestampType, T.TimestampNTZType)):
            out = F.unix_millis(value.cast("timestamp"))
        elif isinstance(source, T.IntegralType):
            out = value.cast("bigint")
        else:
            out = epoch_millis(value.cast("string"), kind.time_format)
        return F.when(value.isNotNull(), F.coalesce(out, F.lit(0 if default is None else default).cast("bigint")))
    if kind.code == BYTES:
        if isinstance(source, T.BinaryType):
            return value
        text = value.cast("string")
        out = F.when(text.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(text))
    elif kind.code == TEXT:
        out = F.lower(F.hex(value)) if isinstance(source, T.BinaryType) else value.cast("string")
    else:
        out = value.cast("string").try_cast(kind.spark)
    return out if default is None else F.coalesce(out, F.lit(default).cast(kind.spark))
