"""Aggregates of one's own: partial states on the map side, merged after the shuffle, finished by key."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Aggregate:
    """An aggregate in three steps. States must pickle, and ``merge`` must not depend on the order.

    ``result`` is the Spark type of what ``finish`` gives; ``inputs`` are the columns that ``lift`` gets as a frame.
    """

    result = "double"

    def __init__(self, *inputs: str):
        self.inputs = inputs

    def lift(self, rows: pd.DataFrame) -> object:
        """The state of some rows of one key, at least one."""
        raise NotImplementedError

    def merge(self, a: object, b: object) -> object:
        raise NotImplementedError

    def finish(self, state: object) -> object:
        raise NotImplementedError


class WeightedMedian(Aggregate):
    """The least value at which half of all weight is reached; null without weight.

    Rows with a null, or a weight that isn't positive, don't count. The state has an entry for
    each distinct value of a key, so it is for values of a bounded domain.
    """

    def lift(self, rows: pd.DataFrame) -> object:
        value, weight = (rows[c] for c in self.inputs)
        fine = value.notna() & weight.notna() & (weight > 0)
        return weight[fine].astype("float64").groupby(value[fine].astype("float64")).sum()

    def merge(self, a: pd.Series, b: pd.Series) -> pd.Series:
        return a.add(b, fill_value=0.0)

    def finish(self, state: pd.Series) -> float | None:
        if not len(state):
            return None
        state = state.sort_index()
        reached = np.cumsum(state.to_numpy())
        return float(state.index[np.searchsorted(reached, reached[-1] / 2)])


class TopValues(Aggregate):
    """The ``k`` largest distinct values, largest first; the state has ``k`` values at most."""

    result = "array<double>"

    def __init__(self, value: str, k: int = 3):
        super().__init__(value)
        self.k = k

    def lift(self, rows: pd.DataFrame) -> list[float]:
        return sorted(set(rows[self.inputs[0]].dropna().astype("float64")), reverse=True)[: self.k]

    def merge(self, a: list[float], b: list[float]) -> list[float]:
        return sorted({*a, *b}, reverse=True)[: self.k]

    def finish(self, state: list[float]) -> list[float]:
        return state


def aggregate(df: DataFrame, keys: list[str], made: dict[str, Aggregate], fan_in: int = 16) -> DataFrame:
    """``keys`` and a column for each aggregate of ``made``, a row a key; null keys are a key, no rows give none.

    Each Arrow batch becomes a state for each of its keys. States meet in two shuffles, the first by
    the key and one of ``fan_in`` numbers, so that a key that holds most rows is merged in many
    tasks before its last one. A state crosses as bytes; rows don't cross at all.
    """
    schema = StructType([df.schema[k] for k in keys])
    states = StructType.fromDDL(", ".join(f"`_s{i}` binary" for i in range(len(made))))
    each = list(made.values())
    columns = [*keys, *dict.fromkeys(c for a in each for c in a.inputs)]

    def lift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            if not len(frame):
                continue
            groups = frame.groupby(keys, dropna=False, sort=False).indices
            first = pa.array([at[0] for at in groups.values()])
            parts = [frame.iloc[at] for at in groups.values()]
            arrays = [batch.column(k).take(first) for k in keys]
            arrays += [pa.array([pickle.dumps(a.lift(p[list(a.inputs)])) for p in parts], pa.binary()) for a in each]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, *states.names])

    def merged(table: pa.Table) -> list:
        out = []
        for a, name in zip(each, states.names):
            found = [pickle.loads(s) for s in table.column(name).to_pylist()]
            while len(found) > 1:
                found = [a.merge(*found[i : i + 2]) if i + 1 < len(found) else found[i] for i in range(0, len(found), 2)]
            out.append(found[0])
        return out

    def merge(table: pa.Table) -> pa.Table:
        row = table.slice(0, 1).select(keys)
        for name, state in zip(states.names, merged(table)):
            row = row.append_column(name, pa.array([pickle.dumps(state)], pa.binary()))
        return row

    def finish(table: pa.Table) -> pa.Table:
        row = table.slice(0, 1).select(keys)
        for (name, a), state in zip(made.items(), merged(table)):
            kind = pa.list_(pa.float64()) if a.result == "array<double>" else {"double": pa.float64(), "long": pa.int64(), "string": pa.string()}[a.result]
            row = row.append_column(name, pa.array([a.finish(state)], kind))
        return row

    lifted = df.select(*columns).mapInArrow(lift, StructType([*schema.fields, *states.fields]))
    salted = lifted.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(fan_in)))
    once = salted.groupBy(*keys, "_salt").applyInArrow(merge, StructType([*schema.fields, *states.fields]))
    results = StructType.fromDDL(", ".join(f"`{n}` {a.result}" for n, a in made.items()))
    return once.groupBy(*keys).applyInArrow(finish, StructType([*schema.fields, *results.fields]))
