"""SimHash near-duplicates: pigeonhole blocks, a join on them, Hamming verification."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, packed, release, row_key, source_columns, table
from .graph import connected_components

WIDTH, SEED, RADIUS, BLOCKS = 3, 42, 2, 4
#: Blocks of bits up to this many fingerprints are compared pair by pair, larger ones by midpoints.
PAIRWISE = 32


def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    """64 bits; a bit is set if over half the shingle hashes have it. No word: 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return 0
    if n <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[s : e - 1], seed) for s, e in zip([0, *ends], ends[width - 1 :])]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = np.array(hashes[at : at + 8192], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int((counts * 2 > len(hashes)) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def add_fingerprints(df: DataFrame, text: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """The columns of ``df`` but for ``text``, and ``_fp``: the fingerprint as a signed long."""
    keep = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width, seed) for t in batch.column(text).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(fps)], names=[*keep, "_fp"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text), "_fp long"])
    return df.mapInArrow(run, schema)


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, pairwise: int = PAIRWISE) -> DataFrame:
    """Edges ``a``, ``b`` that join exactly the fingerprints (column ``fp``, distinct) within ``radius``.

    Fingerprints within ``radius`` bits agree on ``blocks - radius`` of the blocks, so they meet in
    one bucket of such a choice of blocks. Buckets of up to ``pairwise`` fingerprints are joined on
    the bucket and verified. In larger ones each fingerprint names all values half the radius away
    in the bits still free; two within the radius name a common one, and all that name it are
    linked to the smallest, again verified. So no bucket makes more rows than its size times a
    constant, and the components are those of all pairs. For a ``radius`` above 2 larger buckets
    are joined as well.
    """
    spark = fps.sparkSession
    size, sign = 64 // blocks, lambda x: x - (1 << 64) if x >> 63 else x
    choices = list(combinations(range(blocks), blocks - radius))
    masks = [sum(((1 << size) - 1) << (size * b) for b in choice) for choice in choices]
    free = [[i for i in range(64) if not m >> i & 1] for m in masks]
    keyed = fps.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(sign(m))) for m in masks])).alias("choice", "block"),
    )
    sizes = keyed.groupBy("choice", "block").agg(F.count("*").alias("n")).where("n > 1")
    found = materialize(keyed.join(sizes, ["choice", "block"]), "simhash-blocks")
    few = found if radius != 2 else found.where(F.col("n") <= pairwise)
    one, two = few.select("choice", "block", F.col("fp").alias("a")), few.select("choice", "block", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = one.join(two, ["choice", "block"]).where(F.col("a") < F.col("b")).where(near).select("a", "b")
    if radius == 2:
        steps = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(sign(1 << i)) for i in bits]) for bits in free])
        many = found.where(F.col("n") > pairwise).select(
            "choice", "fp", F.explode(F.get(steps, F.col("choice"))).alias("step")
        )
        mid = many.select("choice", F.col("fp").bitwiseXOR(F.col("step")).alias("mid"), "fp")
        low = mid.groupBy("choice", "mid").agg(F.min("fp").alias("a"), F.count("*").alias("m")).where("m > 1")
        stars = mid.join(low, ["choice", "mid"]).select("a", F.col("fp").alias("b")).where("a <> b").where(near)
        pairs = pairs.unionByName(stars.distinct())
    out = materialize(pairs.distinct(), "simhash-links")
    release(found)
    return out


def components(docs: DataFrame, width: int = WIDTH, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` and the other columns of ``docs`` but for the text.

    Null and empty texts have fingerprint 0 and link like any other; texts of any length count
    whole. Repeated rows stay rows and share a component. A null ``doc_id`` keeps its row and is no
    candidate for ``component_id`` (null if the whole component has none). No rows: no rows.
    Columns named ``fp``, ``_fp``, ``component`` or ``component_id`` are replaced.
    """
    source_columns(docs, "doc_id", "text")
    docs = docs.drop("fp", "component", "component_id", "_fp")
    rows = materialize(add_fingerprints(docs, "text", width, seed).withColumnRenamed("_fp", "fp"), "simhash")
    ids = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-ids")
    edges = links(ids.select("fp"), radius)
    found = connected_components(edges).withColumnRenamed("node", "fp")
    each = ids.join(found, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    each = materialize(each, "simhash-each")
    least = each.groupBy("component").agg(F.min("least").alias("component_id"))
    named = each.join(least, "component").select("fp", "component_id", "component")
    release(edges)
    return rows.join(named, "fp", "left")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest ``doc_id``, with the columns of ``docs``.

    Ties (repeated ids) go to the smallest row hash; rows equal in all columns count as one. Columns
    of any name pass through.
    """
    rows = packed(docs)
    rows = rows.select("row", *row_key(docs, "row"))
    keys = rows.select("row.doc_id", "row.text", "_k1", "_k2")
    each = components(keys)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k1", "_k2")).alias("first")
    kept = each.groupBy("component").agg(first).select("first._k1", "first._k2")
    kept = materialize(kept, "simhash-kept")
    return rows.join(kept, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select("row.*")


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
