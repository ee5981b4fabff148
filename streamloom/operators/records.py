"""Splitting of what a source delivers into records."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import BYTES, REAL, TEXT, TIME, WHOLE, field_type

#: Macros of record starts and file names, and what they match.
MACROS = {
    "yyyy": r"\d{4}", "yy": r"\d{2}", "mmm": r"[A-Za-z]{3}", "mm": r"\d{2}", "dd": r"\d{2}", "h": r"\d{2}", "m": r"\d{2}",
    "sss": r"\d{3}", "s": r"\d{2}", "eee": r"[A-Za-z]{3}", "z": r"(?:[A-Z]{3,4}|[+-]\d{4})",
}


def macro_regex(pattern: str, wildcard: bool = False) -> str:
    """A regular expression in which ``${...}`` macros (and ``*``) match and, for file names, all else is literal."""
    out, at = [], 0
    for m in re.finditer(r"\$\{(\w+)\}", pattern):
        out += [pattern[at : m.start()], None, MACROS.get(m[1].lower(), re.escape(m[0]))]
        at = m.end()
    parts, made = [*out, pattern[at:]], []
    literal = True
    for p in parts:
        if p is None:
            literal = False
            continue
        made.append(".*".join(map(re.escape, p.split("*"))) if literal and wildcard else p)
        literal = True
    return "".join(made)


def split_delimited(df: DataFrame, value: str, delimiter: str = "\n") -> DataFrame:
    """One row for each non-empty record; a carriage return counts as a line end."""
    text = F.col(value)
    rule = "[\r\n]" if delimiter == "\n" else re.escape(delimiter)
    return df.withColumn(value, F.explode(F.split(text, rule, -1))).where(F.length(value) > 0)


def split_multiline(df: DataFrame, value: str, start: str) -> DataFrame:
    """One row for each record; a record starts where ``start`` (with macros) matches and runs to the next."""
    return df.withColumn(value, F.explode(F.split(F.col(value), f"(?={macro_regex(start)})", -1))).where(F.length(F.trim(value)) > 0)


def split_batch(df: DataFrame, value: str, content: str = "text", delimiter: str = "\n") -> DataFrame:
    """A JSON array of texts, or delimited text, to records; empty and null ones go."""
    if "array" in content or "map" in content:
        return df.withColumn(value, F.explode(F.from_json(value, "array<string>"))).where(F.length(value) > 0)
    return split_delimited(df, value, delimiter)


def xpath_text(value: Column, path: str) -> Column:
    """String value of an XML node; null where the text is no well-formed XML."""

    def select(texts: pd.Series) -> pd.Series:
        import xml.etree.ElementTree as ET

        steps = [s for s in path.strip("/").split("/") if s and s != "text()"]

        def one(text):
            try:
                root = ET.fromstring(text)
            except (ET.ParseError, TypeError, ValueError):
                return None
            if not path.startswith("//"):
                if not steps or root.tag != steps[0]:
                    return ""
                node = root.find("/".join(steps[1:])) if steps[1:] else root
            else:
                node = root if root.tag == "/".join(steps) else root.find(f".//{'/'.join(steps)}")
            return "" if node is None else "".join(node.itertext())

        return texts.map(one)

    return F.pandas_udf(select, "string")(value)


def frames(data: bytes, batch: bool = False) -> Iterator[bytes]:
    """Length-prefixed frames; they end with a zero length, the count of a batch, or the data."""
    at, left = 0, None
    if batch:
        if len(data) < 4:
            return
        left, at = struct.unpack_from(">i", data)[0], 4
    while len(data) - at >= 4 and left != 0:
        n = struct.unpack_from(">i", data, at)[0]
        if n <= 0 or len(data) - at - 4 < n:
            return
        yield data[at + 4 : at + 4 + n]
        at, left = at + 4 + n, None if left is None else left - 1


def split_frames(df: DataFrame, value: str, batch: bool = False) -> DataFrame:
    """Binary content to one row for each frame."""
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else list(frames(bytes(b), batch)))

    return df.withColumn(value, F.explode(F.pandas_udf(run, "array<binary>")(value)))


def wire_codes(types: list[str]) -> list[int]:
    return [field_type(t).code for t in types]


def encode_row(values: list, types: list[str], host: str | None = None, log_id: int | None = None) -> bytes:
    """Fields in wire form: 8 bytes for numbers and times, length and bytes for text and blobs; a null is empty or 0."""
    out = []
    if host is not None:
        raw = host.encode()
        out += [struct.pack(">i", len(raw)), raw, struct.pack(">q", log_id or 0)]
    for v, code in zip(values, types if types and isinstance(types[0], int) else wire_codes(types)):
        if code in (WHOLE, TIME):
            out.append(struct.pack(">q", int(v or 0)))
        elif code == REAL:
            out.append(struct.pack(">d", float(v or 0)))
        else:
            raw = b"" if v is None else bytes(v) if code == BYTES else str(v).encode()
            out += [struct.pack(">i", len(raw)), raw]
    return b"".join(out)


def decode_row(data: bytes, types: list[str], enveloped: bool = False) -> list:
    at, out = 0, []

    def text() -> bytes:
        nonlocal at
        n = struct.unpack_from(">i", data, at)[0]
        at += 4 + n
        return data[at - n : at]

    if enveloped:
        out.append(text().decode())
        out.append(struct.unpack_from(">q", data, at)[0])
        at += 8
    for code in types if types and isinstance(types[0], int) else wire_codes(types):
        if code in (WHOLE, TIME, REAL):
            out.append(struct.unpack_from(">d" if code == REAL else ">q", data, at)[0])
            at += 8
        else:
            raw = text()
            out.append(raw.decode() if code == TEXT else raw)
    return out


def encode_rows(df: DataFrame, fields: list[tuple[str, str]], out: str = "value") -> DataFrame:
    """``df`` with a binary column of the fields (name, declared type) in wire form.

    Whole numbers, text and blobs are packed by Spark; only doubles need their bytes from numpy.
    """

    def doubles(values: pd.Series) -> pd.Series:
        raw = values.fillna(0.0).to_numpy(">f8").tobytes()
        return pd.Series([raw[i : i + 8] for i in range(0, len(raw), 8)], dtype=object)

    parts = []
    for name, code in zip([n for n, _ in fields], wire_codes([t for _, t in fields])):
        c = F.col(name)
        if code in (WHOLE, TIME):
            parts.append(F.unhex(F.lpad(F.hex(F.coalesce(c.cast("bigint"), F.lit(0))), 16, "0")))
        elif code == REAL:
            parts.append(F.pandas_udf(doubles, "binary")(c.cast("double")))
        else:
            raw = F.coalesce(c if code == BYTES else F.encode(c.cast("string"), "UTF-8"), F.unhex(F.lit("")))
            parts.append(F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw)), 8, "0")), raw))
    return df.withColumn(out, F.concat(*parts))


def real_of(bits: Column) -> Column:
    """The double whose 64 bits a long has; every step is exact."""
    e = F.shiftrightunsigned(bits, 52).bitwiseAND(F.lit(2047))
    m = bits.bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
    two = lambda k: F.pow(F.lit(2.0), k)
    size = F.when(e == 0, m * two(F.lit(-1074.0))).when(e < 2047, (1 + m / F.lit(float(1 << 52))) * two((e - 1023).cast("double")))
    size = size.otherwise(F.when(m == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))
    return F.when(bits < 0, -size).when(bits >= 0, size)


def _unpacked(df: DataFrame, data: Column, fields: list[tuple[str, str]], prefix: str) -> DataFrame:
    """``df`` and a column for each field, ``prefix`` and its place; a field that the data ends in is null."""
    df = df.withColumn(f"{prefix}at", F.when(data.isNotNull(), F.lit(1)))
    for i, (_, declared) in enumerate(fields):
        kind, at = field_type(declared), F.col(f"{prefix}at")
        if kind.code in (WHOLE, TIME, REAL):
            raw = F.substring(data, at, F.lit(8))
            bits = F.conv(F.hex(F.when(F.length(raw) == 8, raw)), 16, -10).cast("bigint")
            df = df.withColumn(f"{prefix}{i}", bits)
            value, step = real_of(F.col(f"{prefix}{i}")) if kind.code == REAL else F.col(f"{prefix}{i}"), F.lit(8)
            df = df.withColumn(f"{prefix}{i}", value.cast(kind.spark))
        else:
            df = df.withColumn(f"{prefix}n", F.conv(F.hex(F.substring(data, at, F.lit(4))), 16, 10).cast("int"))
            raw = F.substring(data, at + 4, F.col(f"{prefix}n"))
            raw = F.when(F.length(raw) == F.col(f"{prefix}n"), raw)
            df = df.withColumn(f"{prefix}{i}", raw.cast("string") if kind.code == TEXT else raw)
            step = 4 + F.col(f"{prefix}n")
        df = df.withColumn(f"{prefix}at", at + step)
    return df


def decode_rows(df: DataFrame, fields: list[tuple[str, str]], value: str = "value") -> DataFrame:
    """The fields of a binary column in wire form, in place of it, by Spark functions."""
    out = _unpacked(df, F.col(value), fields, "_w")
    return out.select(*[c for c in df.columns if c != value], *[F.col(f"_w{i}").alias(n) for i, (n, _) in enumerate(fields)])


def decode_topics(df: DataFrame, shapes: dict[str, list[tuple[str, str]]], topic: str = "topic", value: str = "value") -> DataFrame:
    """Binary rows of many schemas in one pass: a struct for each topic in place of ``value``, null in rows of other topics.

    ``shapes``: the fields (name, declared type) of each topic. Rows of topics that aren't in it have no struct.
    """
    out = df
    for k, (name, fields) in enumerate(shapes.items()):
        out = _unpacked(out, F.when(F.col(topic) == name, F.col(value)), fields, f"_w{k}_")
    made = [
        F.when(F.col(topic) == name, F.struct(*[F.col(f"_w{k}_{i}").alias(n) for i, (n, _) in enumerate(fields)])).alias(name)
        for k, (name, fields) in enumerate(shapes.items())
    ]
    return out.select(*[c for c in df.columns if c != value], *made)

