"""Node topologies: filters, dimension look-ups, output fields and groups as one lazy plan."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expr import compile_rule, truthy
from .metrics import group_by_method


#: Output fields by class name: functions of the whole input that give a Column.
CLASSES: dict[str, Callable[[DataFrame], Column]] = {}


class Dimension:
    """A dimension table that is loaded anew once ``cycle`` seconds are past or an event asks for it.

    Call ``table`` in each micro-batch; ``refresh`` is the event.
    """

    def __init__(self, load: Callable[[], DataFrame], cycle: float | None = None, clock: Callable[[], float] = time.monotonic):
        self.load, self.cycle, self.clock = load, cycle, clock
        self.at: float | None = None
        self.held: DataFrame | None = None

    def refresh(self) -> None:
        self.at = None

    def table(self) -> DataFrame:
        now = self.clock()
        if self.at is None or (self.cycle is not None and now - self.at >= self.cycle):
            self.held, self.at = self.load(), now
        return self.held


@dataclass(frozen=True)
class Lookup:
    """A left join with dimension ``table``; ``on``: (field of the stream or an earlier look-up, field of the table)."""

    table: str
    on: tuple[tuple[str, str], ...]
    take: tuple[str, ...]
    prefix: str = ""
    only: str | None = None  # a rule that rows of the table must meet to match


@dataclass(frozen=True)
class Node:
    inputs: tuple[str, ...]
    input_filter: str | None = None
    lookups: tuple[Lookup, ...] = ()
    outputs: tuple[tuple[str, str], ...] = ()  # name, rule
    group_keys: tuple[str, ...] = ()
    group: tuple[tuple[str, str, object], ...] = ()
    output_filter: str | None = None
    rename: Mapping[str, str] = field(default_factory=dict)


def look_up(df: DataFrame, dim: DataFrame, rule: Lookup) -> DataFrame:
    """Spark broadcasts the dimension when its size allows; a null key matches nothing."""
    if rule.only:
        dim = dim.where(truthy(*compile_rule(rule.only, dim.schema)))
    names = {c: f"_d_{c}" for c in dim.columns}
    side = dim.select(*[F.col(c).alias(n) for c, n in names.items()])
    on = [F.col(a) == F.col(names[b]) for a, b in rule.on]
    taken = [F.col(names[c]).alias(rule.prefix + c) for c in rule.take]
    return df.join(side, on, "left").select(*df.columns, *taken)


def keep_rows(df: DataFrame, rule: str | None) -> DataFrame:
    return df.where(truthy(*compile_rule(rule, df.schema))) if rule else df


def output(df: DataFrame, rule: str) -> Column:
    """An output field: ``class:name`` of ``CLASSES``, else a rule."""
    if rule.startswith("class:"):
        return CLASSES[rule.removeprefix("class:").strip()](df)
    return compile_rule(rule, df.schema)[0]


def pushes(df: DataFrame, rules: Mapping[str, str]) -> dict[str, DataFrame]:
    """What each subscriber is sent: the rows that its rule holds for."""
    return {name: keep_rows(df, rule) for name, rule in rules.items()}


def known(df: DataFrame, dim: DataFrame, on: tuple[str, str]) -> DataFrame:
    """Rows whose field is in the dimension."""
    return df.join(dim.select(F.col(on[1]).alias("_key")).distinct(), F.col(on[0]) == F.col("_key"), "left_semi")


def merged(*streams: DataFrame) -> DataFrame:
    """All rows of streams with the same fields."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out


def only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def run_node(node: Node, tables: Mapping[str, DataFrame]) -> DataFrame:
    df = tables[node.inputs[0]]
    for name in node.inputs[1:]:
        df = df.unionByName(tables[name], allowMissingColumns=True)
    df = keep_rows(df, node.input_filter)
    for rule in node.lookups:
        df = look_up(df, tables[rule.table], rule)
    if node.outputs:
        df = df.select(*[output(df, rule).alias(name) for name, rule in node.outputs])
    if node.group:
        df = group_by_method(df, list(node.group_keys), list(node.group))
    return keep_rows(df, node.output_filter).withColumnsRenamed(dict(node.rename))


def run_topology(nodes: Mapping[str, Node], tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Every node's result; nodes read tables and each other's results in any order without cycles."""
    done: dict[str, DataFrame] = dict(tables)
    left = dict(nodes)
    while left:
        ready = [n for n, node in left.items() if all(i in done for i in node.inputs) and all(x.table in done for x in node.lookups)]
        if not ready:
            raise ValueError(f"nodes wait for each other or for a missing table: {sorted(left)}")
        for n in ready:
            done[n] = run_node(left.pop(n), done)
    return {n: done[n] for n in nodes}


def gather(parent: DataFrame, child: DataFrame, on: str, name: str, order: str, columns: list[str]) -> DataFrame:
    """Each parent row with its children as a sorted array, in one join instead of a query a row."""
    each = child.groupBy(on).agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias(name))
    return parent.join(each, on, "left")


def compare(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Each key with where it is: both, old or new."""
    a, b = old.select(key).distinct().withColumn("_o", F.lit(1)), new.select(key).distinct().withColumn("_n", F.lit(1))
    where = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "old").otherwise("both")
    return a.join(b, key, "full").select(key, where.alias("side"))

