"""Scalar functions as Columns: conversion, text, dates, collections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# conversion
def to_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(c.cast("string").try_cast("int"), F.lit(default))


def to_double(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(default))


def to_text(c: Column, default: str = "") -> Column:
    return F.coalesce(c.cast("string"), F.lit(default))


def leading_long(c: Column) -> Column:
    """The digits a text starts with, else 0."""
    return F.coalesce(F.regexp_extract(c, r"^\d+", 0).try_cast("bigint"), F.lit(0))


def leading_double(c: Column) -> Column:
    """The plain decimal that a text starts with, without sign or exponent, else null."""
    return F.regexp_extract(c, r"^\d+(?:\.\d+)?", 0).try_cast("double")


def is_int(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[+-]?\d+$") & c.try_cast("int").isNotNull(), F.lit(False))


def coerce_kind(c: Column) -> Column:
    """Which type a text is taken for in rules: ``double`` with a point, ``long``, or ``text``."""
    return (
        F.when(F.contains(c, F.lit(".")) & c.try_cast("double").isNotNull(), "double")
        .when(c.try_cast("bigint").isNotNull() & ~F.contains(c, F.lit(".")), "long")
        .otherwise("text")
    )


#: Suffixes of sizes, powers of 1024.
SIZE_STEPS = {"k": 1, "m": 2, "g": 3, "t": 4, "p": 5, "e": 6}


def parse_size(c: Column) -> Column:
    """``10k`` or ``5M`` as a number of bytes; null if it is none."""
    number = F.regexp_extract(c, r"(?i)^\s*(-?\d+)\s*[kmgtpe]?b?\s*$", 1).try_cast("bigint")
    unit = F.lower(F.regexp_extract(c, r"(?i)([kmgtpe])b?\s*$", 1))
    factor = F.lit(1).cast("bigint")
    for name, step in SIZE_STEPS.items():
        factor = F.when(unit == name, F.lit(1 << (10 * step))).otherwise(factor)
    return number * factor


# text
def escape(c: Column, escape_char: str = "\\", chars: str = ",") -> Column:
    """An escape before each of ``chars`` and before itself."""
    out = F.replace(c, F.lit(escape_char), F.lit(escape_char * 2))
    for ch in chars:
        out = F.replace(out, F.lit(ch), F.lit(escape_char + ch))
    return out


def _quoted(text: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() else ch for ch in text)


def unescape(c: Column, escape_char: str = "\\") -> Column:
    return F.regexp_replace(c, f"(?s){_quoted(escape_char)}(.)", "$1")


def split_escaped(c: Column, sep: str = ",", escape_char: str = "\\") -> Column:
    """Parts at separators that are not escaped, escapes kept, empty parts at the end dropped."""
    e = _quoted(escape_char)
    parts = F.split(c, rf"(?<!{e})(?:(?<={e}{e}))?{_quoted(sep)}", -1)
    last = F.size(parts) - F.coalesce(F.array_position(F.transform(F.reverse(parts), lambda x: x != ""), F.lit(True)), F.lit(0)).cast("int") + 1
    return F.when(F.array_max(F.transform(parts, lambda x: x != "")), F.slice(parts, 1, last)).otherwise(F.array().cast("array<string>"))


def tokens(c: Column, sep: str = ",") -> Column:
    """Trimmed parts, empty ones dropped."""
    return F.filter(F.transform(F.split(c, _quoted(sep), -1), lambda x: F.trim(x)), lambda x: x != "")


def escape_html(c: Column) -> Column:
    """The four characters of markup, and two spaces."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("  ", "&nbsp;&nbsp;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def camelize(c: Column) -> Column:
    """``snake_case`` to ``SnakeCase``."""
    return F.array_join(F.transform(F.split(F.lower(c), "_"), capitalize), "")


def blanks_to_underlines(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit("_"))


def parse_map(c: Column, entry: str, pair: str) -> Column:
    """Entries of exactly two parts as a map; the last of equal keys counts."""
    parts = F.transform(F.split(c, _quoted(entry), -1), lambda e: F.split(e, _quoted(pair), -1))
    good = F.filter(parts, lambda p: F.size(p) == 2)
    keys = F.array_distinct(F.transform(good, lambda p: p[0]))
    last = lambda k: F.element_at(F.filter(good, lambda p: p[0] == k), -1)[1]
    return F.map_from_arrays(keys, F.transform(keys, last))


def name_value(c: Column, sep: str) -> Column:
    """Name and value of a trimmed text with exactly one separator, else null."""
    parts = F.split(F.trim(c), _quoted(sep), -1)
    return F.when(F.size(parts) == 2, parts)


def strip_ends(c: Column, begin: str, end: str) -> Column:
    """Without begin and end marks if it has both."""
    n = len(begin) + len(end)
    inner = F.substring(c, F.lit(len(begin) + 1), F.length(c) - n)
    return F.when(F.startswith(c, F.lit(begin)) & F.endswith(c, F.lit(end)) & (F.length(c) >= n), inner).otherwise(c)


def bracket_map(items: Column) -> Column:
    """``[k:v]`` items as a map."""
    pairs = F.transform(items, lambda x: F.split(strip_ends(x, "[", "]"), ":", 2))
    good = F.filter(pairs, lambda p: F.size(p) == 2)
    return F.map_from_entries(F.transform(good, lambda p: F.struct(p[0], p[1])))


def column_groups(c: Column) -> Column:
    """``[family:column:[f1,f2]]-...`` as family, column and fields."""
    heads = F.regexp_extract_all(c, F.lit(r"\[([^:\[\]]+):([^:\[\]]+):\[([^\]]*)\]\]"), F.lit(0))
    part = lambda x, i: F.regexp_extract(x, r"\[([^:\[\]]+):([^:\[\]]+):\[([^\]]*)\]\]", i)
    return F.transform(heads, lambda x: F.struct(part(x, 1).alias("family"), part(x, 2).alias("col"), F.split(part(x, 3), ",").alias("fields")))


def select_list(c: Column) -> Column:
    """What stands between SELECT and FROM."""
    return F.trim(F.regexp_extract(c, r"(?is)^\s*select\s+(.*?)\s+from\s", 1))


def full_match(c: Column, pattern: str | None) -> Column:
    return F.lit(True) if pattern is None else c.rlike(f"^(?:{pattern})$")


def count_char(c: Column, ch: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def same_text(a: Column, b: Column) -> Column:
    return F.lower(a).eqNullSafe(F.lower(b))


def is_empty(c: Column) -> Column:
    return c.isNull() | (c == "")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_path(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def pad_front(c: Column, ch: str, size: int) -> Column:
    """Padded on the left; a longer text is null, never cut."""
    return F.when(F.length(c) <= size, F.lpad(c, size, ch))


def _decimal(c: Column, pattern: str) -> Column:
    return F.call_function("format_number", c, F.lit(pattern))


def human_size(c: Column) -> Column:
    """One decimal and k, m or g; smaller numbers as they are."""
    out = c.cast("string")
    for unit, name in ((1 << 10, "k"), (1 << 20, "m"), (1 << 30, "g")):
        out = F.when(F.abs(c) >= unit, F.concat(_decimal(c / unit, "0.0"), F.lit(name))).otherwise(out)
    return out


def byte_size(c: Column) -> Column:
    """Up to two decimals and B to PB."""
    out = F.concat(c.cast("string"), F.lit("B"))
    for i, name in enumerate(("KB", "MB", "GB", "TB", "PB"), 1):
        out = F.when(c >= 1 << (10 * i), F.concat(_decimal(c / (1 << (10 * i)), "0.##"), F.lit(name))).otherwise(out)
    return out


def percent(c: Column, digits: int = 2) -> Column:
    """A share as a percentage, rounded down."""
    scale = 10**digits
    return F.concat(_decimal(F.floor(c * 100 * scale) / scale, "0." + "0" * digits), F.lit("%"))


def simple_host(c: Column) -> Column:
    return F.substring_index(c, ".", 1)


def host_port(c: Column) -> Column:
    """Host and port of ``host:port``, else null."""
    good = c.rlike(r"^[^:\s]+:\d{1,5}$")
    return F.when(good, F.struct(F.substring_index(c, ":", 1).alias("host"), F.substring_index(c, ":", -1).cast("int").alias("port")))


def recode(c: Column, wrong: str = "ISO-8859-1", right: str = "GBK") -> Column:
    """A text that was read in the ``wrong`` charset, read in the ``right`` one."""
    import pandas as pd

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else t.encode(wrong, "replace").decode(right, "replace"))

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(c)


# dates
def date_text(ts: Column, fmt: str) -> Column:
    return F.coalesce(F.date_format(ts, fmt), F.lit(""))


def millis_text(ms: Column, fmt: str) -> Column:
    return F.date_format(F.timestamp_millis(ms), fmt)


def text_millis(c: Column, fmt: str) -> Column:
    return F.unix_millis(F.try_to_timestamp(c, F.lit(fmt)))


def loose_date(c: Column) -> Column:
    """A timestamp from up to 14 digits; missing months and days count as the first, other parts as 0."""
    digits = F.substring(F.regexp_replace(c, r"\D", ""), 1, 14)
    fill = F.lit("00000101000000")
    full = F.concat(digits, F.substring(fill, F.length(digits) + 1, F.lit(14)))
    return F.when(F.length(digits) >= 4, F.try_to_timestamp(full, F.lit("yyyyMMddHHmmss")))


def month_number(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMM")


def day_number(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def seconds_of(ms: Column) -> Column:
    return F.floor(ms / 1000).cast("bigint")


def duration_text(ms: Column) -> Column:
    """``1hrs, 2mins, 3sec``; parts that are zero are left out but for the seconds."""
    s = F.floor(ms / 1000).cast("bigint")
    h, m = F.floor(s / 3600).cast("bigint"), F.floor(s / 60).cast("bigint") % 60
    part = lambda v, name: F.when(v > 0, F.concat(v.cast("string"), F.lit(name)))
    return F.concat_ws(", ", part(h, "hrs"), part(m, "mins"), F.concat((s % 60).cast("string"), F.lit("sec")))


def now_macro(name: str, now: Column | None = None) -> Column:
    """Date macros: ``N_YYYY``, ``N_YYYYMM``, ``N_YYYYMMDD`` with ``P`` (before) or ``N`` (after), ``N_DATE``, ``N_TIME``..."""
    now = F.current_timestamp() if now is None else now
    shift = {"P": -1, "N": 1}.get(name[-1], 0) if name.rstrip("PN") in ("N_YYYY", "N_YYYYMM", "N_YYYYMMDD") else 0
    base = name[:-1] if shift else name
    if base == "N_YYYY":
        return F.date_format(F.add_months(now, 12 * shift), "yyyy")
    if base == "N_YYYYMM":
        return F.date_format(F.add_months(now, shift), "yyyyMM")
    if base == "N_YYYYMMDD":
        return F.date_format(F.date_add(now, shift), "yyyyMMdd")
    formats = {"N_MM": "MM", "N_DD": "dd", "N_HH": "HH", "N_MI": "mm", "N_SS": "ss", "N_DATE": "yyyy-MM-dd", "N_TIME": "yyyy-MM-dd HH:mm:ss"}
    if base not in formats:
        raise ValueError(f"unknown macro {name}")
    return F.date_format(now, formats[base])


# collections
def first_of(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.get(a, F.lit(0)))


def last_of(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.element_at(a, -1))


def upper_all(a: Column) -> Column:
    return F.transform(a, lambda x: F.upper(x))


def merge_add(a: Column, b: Column) -> Column:
    """Two maps of numbers, values of equal keys added."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def arg_map(*pairs: Column) -> Column:
    """A map of names and values without null values."""
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def larger(a: Column, b: Column) -> Column:
    """The larger of two texts, as numbers if both are; nulls are skipped."""
    x, y = a.try_cast("double"), b.try_cast("double")
    both = x.isNotNull() & y.isNotNull()
    return F.when(a.isNull(), b).when(b.isNull(), a).when(both, F.when(x >= y, a).otherwise(b)).otherwise(F.greatest(a, b))


def smaller(a: Column, b: Column) -> Column:
    x, y = a.try_cast("double"), b.try_cast("double")
    both = x.isNotNull() & y.isNotNull()
    return F.when(a.isNull(), b).when(b.isNull(), a).when(both, F.when(x <= y, a).otherwise(b)).otherwise(F.least(a, b))


# more
def decimal_text(c: Column, pattern: str) -> Column:
    """A number by a decimal pattern like ``0.00``."""
    return _decimal(c, pattern)


def class_name(c: Column) -> Column:
    """Name of the public class of a source text, else of its first class."""
    public = F.regexp_extract(c, r"\bpublic\s+(?:\w+\s+)*class\s+(\w+)", 1)
    return F.when(public != "", public).otherwise(F.regexp_extract(c, r"\bclass\s+(\w+)", 1))


def full_class_name(c: Column) -> Column:
    """With the package in front, which may have many parts."""
    package = F.regexp_extract(c, r"(?m)^\s*package\s+([\w.]+)\s*;", 1)
    return F.when(package != "", F.concat(package, F.lit("."), class_name(c))).otherwise(class_name(c))
