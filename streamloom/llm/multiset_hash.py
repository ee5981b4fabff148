"""Document fingerprints by a homomorphic multiset hash of paragraphs.

A fingerprint is a vector of counters; each paragraph adds a vector of its own, modulo powers of
two, so the order of paragraphs does not matter and a paragraph is inserted or deleted by adding or
subtracting. A paragraph is a line; a long line is cut into pieces, see ``paragraphs``.
The vector has two parts:

- 16 counters modulo 2^64, to all of which every paragraph adds: equal multisets have equal sums,
  and others differ but for a chance of 2^-1024;
- 12 tiers of 32 counters modulo 2^16, where a paragraph adds to one counter of each tier it belongs
  to: all to the first, a quarter, a sixteenth and so on to the next, one of 4^11 to the last, which
  holds few paragraphs of the longest text. Where two documents share paragraphs, counters agree, so
  the share of counters that agree tells how alike they are.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import source_columns, table

WIDE, TIERS, LANES = 16, 12, 32
#: Tiers that are always written; of the others those up to the last one that holds a paragraph.
WRITTEN = 4
#: Where text without spaces is cut: every eighth character of the first planes, so that the place follows from the text alone.
_EIGHTH = "".join(map(re.escape, map(chr, [*range(0x20, 0xD800, 8), *range(0xE000, 0x30000, 8)])))
_PIECE = re.compile(r".{24,72}?(?:[。！？、，]|(?<=[.!?,;:|])(?= ))|.{48,}?(?= )|.+")
_LONG, _CUT = 96, re.compile(rf".{{24,96}}?[{_EIGHTH}]|.{{1,96}}")


def paragraphs(text: str | None) -> list[str]:
    """Lines, cut after a mark from 24 characters on and at a space from 48 on; what is longer than 96 then is cut where the text gives a place."""
    pieces = _PIECE.findall(text) if text else []
    return pieces if max(map(len, pieces), default=0) <= _LONG else [x for p in pieces for x in ([p] if len(p) <= _LONG else _CUT.findall(p))]


def _vectors(parts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the wide and of the narrow vectors of ``parts``."""
    digests = [hashlib.shake_128(p.encode("utf-8", "surrogatepass")).digest(WIDE * 8 + 24) for p in parts]
    wide, narrow = np.zeros(WIDE, np.uint64), np.zeros(TIERS * LANES, np.uint16)
    if digests:
        words = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, WIDE + 3)
        with np.errstate(over="ignore"):
            wide = words[:, :WIDE].sum(0, dtype=np.uint64)
            level = words[:, WIDE]
            for t in range(TIERS):
                own = (level >> np.uint64(32)) & np.uint64((1 << (2 * t)) - 1) == 0
                if not own.any():
                    break  # a tier's paragraphs belong to all tiers before
                where = words[own, WIDE + 1 + t // 8]
                lane = ((where >> np.uint64(8 * (t % 8))) & np.uint64(LANES - 1)).astype(np.int64) + t * LANES
                np.add.at(narrow, lane, (level[own] & np.uint64(0xFFFF)).astype(np.uint16) | np.uint16(1))
    return wide, narrow


class Fingerprint:
    """A fingerprint that grows and shrinks by paragraphs."""

    def __init__(self, wide: np.ndarray | None = None, narrow: np.ndarray | None = None):
        self.wide = np.zeros(WIDE, np.uint64) if wide is None else wide
        self.narrow = np.zeros(TIERS * LANES, np.uint16) if narrow is None else narrow

    @classmethod
    def of(cls, text: str | None) -> Fingerprint:
        return cls(*_vectors(paragraphs(text)))

    @classmethod
    def parse(cls, hexed: str) -> Fingerprint:
        raw = bytes.fromhex(hexed)
        narrow = np.zeros(TIERS * LANES, np.uint16)
        written = np.frombuffer(raw[8 * WIDE :], "<u2")
        narrow[: len(written)] = written
        return cls(np.frombuffer(raw[: 8 * WIDE], "<u8").copy(), narrow)

    def __add__(self, other: Fingerprint) -> Fingerprint:
        with np.errstate(over="ignore"):
            return Fingerprint(self.wide + other.wide, self.narrow + other.narrow)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        with np.errstate(over="ignore"):
            return Fingerprint(self.wide - other.wide, self.narrow - other.narrow)

    def __eq__(self, other) -> bool:
        return isinstance(other, Fingerprint) and bool((self.wide == other.wide).all() and (self.narrow == other.narrow).all())

    __hash__ = None

    def hex(self) -> str:
        tiers = max(WRITTEN, int(self.narrow.nonzero()[0].max(initial=0)) // LANES + 1)
        return struct.pack(f"<{WIDE}Q", *self.wide.tolist()).hex() + struct.pack(f"<{tiers * LANES}H", *self.narrow[: tiers * LANES].tolist()).hex()


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """0 to 1: an estimate of the shared part of both multisets' union, from the first tier with empty counters.

    With equal sums it is 1. A tier's counters that agree without being empty hold shared
    paragraphs only; the others hold the rest, and both numbers are freed of the counters that
    several paragraphs met in.
    """
    if a == b:
        return 1.0
    for t in range(TIERS):
        x, y = a.narrow[t * LANES : (t + 1) * LANES], b.narrow[t * LANES : (t + 1) * LANES]
        same = int(((x == y) & (x != 0)).sum())
        differ = int((x != y).sum())
        if differ <= LANES * 7 // 8 or t == TIERS - 1:
            break
    if not same:
        return 0.0
    free = max(LANES - differ, 0.5)
    other = -np.log(free / LANES)  # paragraphs a counter that are not shared
    both = -np.log(max(free - same, 0.5) / free)  # shared paragraphs a counter
    return float(min(1.0, max(0.0, both / (both + other))))


def _runs(docs: DataFrame, goal: int) -> DataFrame:
    """``docs`` with ``run``: ranges of ids, from the largest id down; null ids come last, equal ids stay together.

    There are four ranges for each shuffle partition, fewer if they would have less than ``goal``
    rows. The driver gets the least id of each range and nothing else; ids alone are shuffled for it.
    """
    spark = docs.sparkSession
    n = docs.count()
    wanted = max(1, min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // goal)))
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").repartitionByRange(wanted, "doc_id")
    least = ids.groupBy(F.spark_partition_id()).agg(F.min("doc_id").alias("least")) if wanted > 1 else ids.limit(0).withColumnRenamed("doc_id", "least")
    cuts = sorted(r["least"] for r in least.collect())[1:]
    if not cuts:
        return docs.withColumn("run", F.when(F.col("doc_id").isNull(), 1).otherwise(0).cast("long"))
    bounds = np.array(cuts, np.int64)

    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(len(bounds) - np.searchsorted(bounds, ids.to_numpy(np.int64), side="right"))

    run = F.pandas_udf(place, "long")(F.coalesce("doc_id", F.lit(0).cast("long")))
    return docs.withColumn("run", F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(run).cast("long"))


def with_next(docs: DataFrame, goal: int = 5_000) -> DataFrame:
    """Sorted runs of documents for ``neighbours``: each run is followed by a copy of the next one's first row.

    The order is by descending id, then text hash; after the last comes the first.
    """
    dealt = _runs(docs, goal).select("run", "doc_id", "text", F.xxhash64("text").alias("th"), F.lit(0).alias("halo"))
    order = F.struct(F.coalesce(-F.col("doc_id"), F.lit(0)), "th")
    heads = dealt.groupBy("run").agg(F.min_by(F.struct("doc_id", "text", "th"), order).alias("head"))
    runs = sorted(r[0] for r in heads.select("run").collect())
    back = {r: runs[i - 1] for i, r in enumerate(runs)}
    if not runs:
        return dealt
    to = docs.sparkSession.createDataFrame(list(back.items()), "run long, before long")
    halo = heads.join(to, "run").select(F.col("before").alias("run"), "head.*", F.lit(1).alias("halo"))
    both = dealt.unionByName(halo.select("run", "doc_id", "text", "th", "halo"))
    parts = max(1, min(len(runs), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return both.repartition(parts, "run").sortWithinPartitions("run", "halo", F.col("doc_id").desc_nulls_last(), "th")


def neighbours(docs: DataFrame) -> DataFrame:
    """The fingerprint of every text and of its edited text, and how alike they and the next one's are.

    In the edited text the last third of the code points gives way to the first as many (or all)
    of the next document, by descending id, after the last the first. A null text is empty, an only
    document follows itself, rows with equal id follow each other by text hash, a null id comes
    last. Texts may be of any length; other columns are left out. No rows give no rows.
    """
    source_columns(docs, "doc_id", "text")
    docs = docs.select("doc_id", "text")

    def row(doc, after) -> tuple:
        (i, text, own), (_, other, theirs) = doc, after
        third = len(text) // 3
        edited = text[: len(text) - third] + other[:third]
        changed = Fingerprint.of(edited) if third else own
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return i, len(text), sha, own.hex(), changed.hex(), likeness(own, changed), likeness(own, theirs)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=names).assign(doc_id=pd.array([r[0] for r in out], "Int64"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in batches:
            out = []
            for number, i, text, halo in zip(pdf["run"], pdf["doc_id"], pdf["text"], pdf["halo"]):
                text = text or ""
                now = (None if i is None else int(i), text, Fingerprint.of(text))
                if last is not None and last[0] == number:
                    out.append(row(last[1], now))
                last = None if halo else (number, now)
                if len(out) == 1000:
                    yield frame(out)
                    out = []
            yield frame(out)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    # ids travel as text: pandas would round large ones beside nulls
    return with_next(docs).withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, schema)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"))
