"""Field extraction rules: one Column for each declared field of a message."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import HOST, LOG_ID, FieldSpec, StreamSpec
from ..types import cast_field

_RANGE = re.compile(r"(\d+)-(\S+)")


def pieces(value: Column, split: str) -> Column:
    """Parts at a literal separator, empty ones kept."""
    return F.split(value, re.escape(split), -1)


def selected(parts: Column, rule: str, split: str) -> Column:
    """``N`` or ``idx:N``: one part; ``A-B``: parts A to B joined again; ``A-?``: from A on."""
    rule = rule.removeprefix("idx:").strip()
    if rule.isdigit():
        return F.get(parts, F.lit(int(rule)))
    m = _RANGE.fullmatch(rule)
    if not m:
        raise ValueError(f"no part is selected by {rule!r}")
    first = int(m[1])
    last = F.least(F.lit(int(m[2])), F.size(parts) - 1) if m[2].isdigit() else F.size(parts) - 1
    return F.when(last >= first, F.array_join(F.slice(parts, first + 1, F.greatest(last - first + 1, F.lit(0))), split))


def text_field(value: Column, rule: str, split: str, spec: StreamSpec | None = None, host: str = "local") -> Column:
    """A field of a text message; the value stays text. A pattern that is not found gives null."""
    if rule.startswith("mac:"):
        known = {
            "MSG_ID": F.lit(str(spec.msg_id if spec else 0)),
            "HOST": F.lit(host),
            "COLLECT_TIME": F.unix_millis(F.current_timestamp()).cast("string"),
        }
        return known.get(rule[4:].strip(), F.lit(None).cast("string"))
    if rule.startswith("reg:"):
        replacement, _, pattern = rule[4:].partition("~")
        return F.when(value.rlike(pattern), F.regexp_replace(value, pattern, replacement))
    select, _, step = rule.partition(",")
    out = selected(pieces(value, split), select, split)
    if not step:
        return out
    kind, _, arg = step.partition(":")
    if kind == "split":
        k, _, sep = arg.partition(":")
        return F.get(F.split(out, sep, -1), F.lit(int(k)))
    at = F.instr(out, F.lit(arg))
    if kind == "substr_s":
        return F.when(at > 0, F.substring(out, F.lit(1), at - 1)).when(out.isNotNull(), "")
    if kind == "substr_e":
        return F.when(at > 0, F.substring(out, at + len(arg), F.length(out))).otherwise(out)
    raise ValueError(f"unknown step {step!r}")


def extract(messages: DataFrame, spec: StreamSpec, value: str = "value", host: str = "local") -> DataFrame:
    """``messages`` with the declared fields in place of ``value``.

    ``array`` and ``map`` messages are JSON and typed, ``text`` messages stay text. Without a rule
    a field is taken by its place (array, text) or name (map). A broken message gives nulls.
    """
    text = F.col(value)
    out: list[Column] = []
    for i, f in enumerate(spec.fields):
        rule = f.src if f.src not in (None, "") else (f.name if "map" in spec.content else str(i))
        if "array" in spec.content:
            col = cast_field(F.get(F.from_json(text, "array<string>"), F.lit(int(rule))), f.data_type)
        elif "map" in spec.content:
            col = cast_field(F.from_json(text, "map<string,string>")[rule], f.data_type)
        else:
            col = text_field(text, rule, spec.split, spec, host)
        out.append(col.alias(f.name))
    return messages.select(*[c for c in messages.columns if c != value], *out)


def typed(df: DataFrame, fields: tuple[FieldSpec, ...]) -> DataFrame:
    """Declared fields cast to their types; other columns as they are."""
    kinds = {f.name: f.dataType for f in df.schema}
    return df.withColumns({f.name: cast_field(F.col(f.name), f.data_type, source=kinds[f.name]) for f in fields if f.name in kinds})


def envelope(df: DataFrame, host: str = "local", order: list[str] | None = None, partition: list[str] | None = None) -> DataFrame:
    """Host and log id in front.

    With ``order`` and ``partition`` ids count from 1 within the partition. With ``order`` alone
    they rise in that order, with gaps: rows are sorted by ranges, never in one task. Else they
    only rise within a task.
    """
    if order and partition:
        from pyspark.sql import Window

        number = F.row_number().over(Window.partitionBy(*partition).orderBy(*order)).cast("long")
    else:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
        number = F.monotonically_increasing_id()
    return df.select(F.lit(host).alias(HOST), number.alias(LOG_ID), "*")


def topic_content(value: Column) -> tuple[Column, Column]:
    """Text before and after the first comma."""
    return F.substring_index(value, ",", 1), F.when(F.instr(value, ",") > 0, F.substring(value, F.instr(value, ",") + 1, F.length(value)))
