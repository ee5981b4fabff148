"""Mixing sources to target weights by balanced sampling with the cube method.

A document's expected copies are its source's target over its source's size, the whole part for
certain and the fraction by the draw. The draw holds each source's sum of fractions (documents)
and its sum of size times fraction (tokens): among three documents there is a direction that
changes neither, and moving along it up or down by chance ends with a fraction at 0 or 1. Blocks
of documents do so side by side and leave two undecided each; these meet in blocks again until a
source has one block, whose last two are landed, first by tokens alone, then by chance.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, materialize, packed, row_key, source_columns, table

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
BLOCK = 4096
EPS = 1e-9
#: Documents of a source that wait for the landing beside the two that the flight leaves.
SPARE = 10


def targets(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict:
    """Target of each source, ordered by code point with null last and weighed in turn.

    ``share`` times the sum of all sizes is dealt by weight; what a source would get beyond
    ``most`` times its size goes to the others by weight, until none is above.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out: dict = {}
    left = share * sum(sizes.values())
    while len(out) < len(names):
        active = [s for s in names if s not in out]
        unit = max(0.0, left) / sum(weight[s] for s in active)
        above = [s for s in active if unit * weight[s] > most * sizes[s]]
        if not above:
            return out | {s: unit * weight[s] for s in active}
        for s in above:
            out[s] = most * sizes[s]
            left -= out[s]
    return out


def flight(p: list[float], size: list[float], rng: random.Random) -> list[int]:
    """Moves ``p`` in place, keeping its sum and its sum by ``size``; the positions still undecided, two at most."""
    open_: list[int] = []
    for k in range(len(p)):
        if p[k] <= EPS or p[k] >= 1 - EPS:
            p[k] = float(round(p[k]))
            continue
        open_.append(k)
        if len(open_) < 3:
            continue
        a, b, c = open_
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        open_ = _move(p, open_, u, rng)
    return open_


def _move(p: list[float], at: list[int], u: Sequence[float], rng: random.Random) -> list[int]:
    """One random step along ``u`` to the border of the cube; the positions still inside."""
    up = min(((1 - p[k]) / x if x > 0 else p[k] / -x) for k, x in zip(at, u) if x)
    down = min((p[k] / x if x > 0 else (1 - p[k]) / -x) for k, x in zip(at, u) if x)
    step = up if rng.random() * (up + down) < down else -down
    inside = []
    for k, x in zip(at, u):
        p[k] += step * x
        if p[k] <= EPS or p[k] >= 1 - EPS:
            p[k] = float(round(p[k]))
        else:
            inside.append(k)
    return inside


def land(p: list[float], size: list[float], at: list[int]) -> None:
    """Decides the last few by least cost: their words, then their number, come nearest to what they stood for."""
    bits = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
    now, sizes = np.array([p[k] for k in at]), np.array([size[k] for k in at])
    words, count = np.abs((bits - now) @ sizes), np.abs((bits - now).sum(1))
    for k, bit in zip(at, bits[np.lexsort((count, np.round(words, 6)))[0]]):
        p[k] = float(bit)


def _draw(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    """One block in the order of its rows' sizes and hashes. The last of a source keeps a few rows of all sizes for landing."""
    pdf = pdf.sort_values(["size", "h", "k1"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    rng = random.Random(f"{seed}/{pdf['sid'].iloc[0]}/{pdf['block'].iloc[0]}/{pdf['level'].iloc[0]}")
    p, size = pdf["p"].tolist(), pdf["size"].astype(float).tolist()
    if pdf["last"].iloc[0]:
        spare = sorted({round(k) for k in np.linspace(0, len(p) - 1, min(len(p), SPARE))})
        first = [k for k in range(len(p)) if k not in set(spare)]
        q = [p[k] for k in first]
        rest = [first[k] for k in flight(q, [size[k] for k in first], rng)]
        for k, v in zip(first, q):
            p[k] = v
        land(p, size, rest + spare)
    else:
        flight(p, size, rng)
    pdf["p"] = p
    return pdf


def sample(units: DataFrame, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """``units`` (``sid`` int, ``size`` long, ``p`` double, ``h`` and ``k1`` long, and more) with ``p`` 0 or 1.

    The driver gets a count for each source and level. Blocks have about ``block`` units by hash.
    """
    decided, level, now = [], 0, units
    while True:
        inside = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
        counts = {r["sid"]: r["n"] for r in now.where(inside).groupBy("sid").agg(F.count("*").alias("n")).collect()}
        decided.append(now.where(~inside).select(*units.columns))
        if not counts:
            break
        spark = units.sparkSession
        blocks = spark.createDataFrame(
            [(s, -(-n // block)) for s, n in counts.items()], "sid int, blocks long"
        )
        dealt = now.where(inside).join(blocks, "sid")
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("h", F.lit(level)), F.col("blocks")))
        dealt = dealt.withColumn("level", F.lit(level)).withColumn("last", F.col("blocks") == 1).drop("blocks")
        drawn = dealt.groupBy("sid", "block").applyInPandas(lambda pdf: _draw(pdf, seed), dealt.schema)
        now = materialize(drawn.select(*units.columns), "mix-level")
        level += 1
    out = decided[0]
    for df in decided[1:]:
        out = out.unionByName(df)
    return out


def mix(docs: DataFrame, size: str = "size", source: str = "source", seed: int = 1) -> DataFrame:
    """``docs`` with ``source_size``, ``target`` and ``copies`` (0 to 2).

    Columns of these names are replaced, others pass through. A null source is a source of its own. Documents of size 0 and sources without words get no
    target beyond 0. Ties and repeated rows draw one by one, and equal input gives equal draws in any
    partitioning unless rows are equal in all columns. No rows give no rows.
    """
    source_columns(docs, size, source)
    docs = docs.drop(*{"source_size", "target", "copies"} - {size, source})
    cols = [F.col("row")[c] for c in docs.columns]
    rows = packed(docs).select("row", F.col("row")[size].alias("size"), F.col("row")[source].alias("source"))
    rows = materialize(rows.select("*", F.xxhash64(*cols).alias("h"), F.xxhash64(F.lit(1), *cols).alias("k1")), "mix-rows")
    totals = {r[0]: r[1] for r in rows.groupBy("source").agg(F.sum("size").cast("long")).collect()}
    goal = targets(totals)
    spark = docs.sparkSession
    known = [(i, s, totals[s], float(goal[s]), goal[s] / totals[s] if totals[s] else 0.0) for i, s in enumerate(goal)]
    shares = spark.createDataFrame(known, "sid int, name string, source_size long, target double, f double")
    joined = rows.join(shares, F.col("source").eqNullSafe(F.col("name")))
    whole = F.floor(F.col("f") + EPS)
    part = F.greatest(F.lit(0.0), F.col("f") - whole).alias("p")
    units = joined.select("sid", "size", part, "h", "k1", "row", "source_size", "target", whole.alias("whole"))
    drawn = sample(units, seed)
    copies = (F.col("whole") + F.col("p").cast("long")).cast("long").alias("copies")
    return drawn.select(*[F.col("row")[c].alias(c) for c in docs.columns], "source_size", "target", copies)


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source`` and ``size``: the number of words; a null text has none."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", words.alias("size"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, with ``mix_size``, ``mix_target`` and ``mix_copies`` (1 or 2).

    Rows equal in all columns draw as one and share their copies. Columns of these names are replaced.
    """
    docs = docs.drop("mix_size", "mix_target", "mix_copies")
    keyed = packed(docs).select("row", *row_key(docs, "row"))
    words = F.coalesce(F.regexp_count("row.text", F.lit(WORD)), F.lit(0)).cast("long")
    units = keyed.select("_k1", "_k2", "row.source", words.alias("size")).dropDuplicates(["_k1", "_k2"])
    taken = mix(units).where("copies > 0").select("_k1", "_k2", F.col("size").alias("mix_size"), F.col("target").alias("mix_target"), F.col("copies").alias("mix_copies"))
    taken = materialize(taken, "mix-taken")
    return keyed.join(taken, ["_k1", "_k2"]).select("row.*", "mix_size", "mix_target", "mix_copies")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(sized(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
