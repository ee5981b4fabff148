"""N-gram Jaccard join by T-occurrence search over inverted lists, split as DivideSkip does.

A document is the set of its distinct word shingles. Two sets of Jaccard index J or more have at
least T = ceil(J n) shingles in common, n the larger size, so each finds the other in T of its n
inverted lists. The T - e longest lists are put aside (e grows with n): of the n - T + e others both
have at least e in common. Those short lists are heap-merged and give the candidates; the lists put
aside are binary-probed, through the sorted set of the candidate, and what reaches the overlap stays.

"Longest" follows one order of all shingles: those in one document only, shared ones, those outside
the half of all shingles that is counted, and those in more than ``SHORT`` documents, each by hash.
The first of these can link nothing, so most documents end there. Lists that are longer than
``SHORT`` among the merged ones are not merged either: pairs that could share e lists only there
are found by comparison with a few central members of each list, and where a list still has
documents of several components, by comparison across those, inside a join and by parity sketches.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialize, release, source_columns, table, tidy
from .graph import connected_components
from .rolling import Rolling

WIDTH, PERCENT = 5, 80
#: Inverted lists of up to so many sets are merged.
SHORT = 32
#: Comparisons of long lists with a member of their own before all components are compared.
ROUNDS = 4
#: Bits of each of the two maps of shared and of long lists, least and most (16 MB).
MAP_LEAST, MAP_MOST = 1 << 20, 1 << 27
#: 64-bit words of a parity sketch.
SKETCH = 8


def normal(text: bytes | None) -> bytes:
    """Words in A-Z lower case with one space between."""
    return b" ".join(text.lower().split()) if text else b""


def shingles(words: bytes, rolling: Rolling, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a normal text; fewer words than ``width`` are one shingle."""
    a = np.frombuffer(words, np.uint8)
    if not len(a):
        return np.empty(0, np.uint64)
    blank = np.flatnonzero(a == 32)
    start, end = np.r_[0, blank + 1], np.r_[blank, len(a)]
    k = min(width, len(start))
    return np.unique(rolling(a, start[: len(start) - k + 1], end[k - 1 :]))


def required(n: np.ndarray | int, percent: int = PERCENT):
    """T: the least overlap that any set similar to one of ``n`` shingles has with it."""
    return -(-percent * n // 100)


def extra(n):
    """e: how many of the merged lists two similar sets share, by the smaller one's size."""
    return 1 + n // 10


def half(hashes: np.ndarray) -> np.ndarray:
    """Whether a shingle is of the half that is counted."""
    return (hashes & np.uint64(1)).astype(bool)


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(1)) & np.uint64(len(bits) * 64 - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def bit_map(lists: DataFrame) -> np.ndarray:
    """A bit for each ``h``, up to 16 MB whatever their number; a full map changes the order of the lists, not the result."""
    n, size = lists.count(), MAP_LEAST
    while size < MAP_MOST and size < 16 * n:
        size *= 2
    at = F.shiftrightunsigned("h", 1).bitwiseAND(F.lit(size - 1))
    found = lists.select(F.shiftrightunsigned(at, 6).alias("word"), F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 1) & 63 AS int))").alias("bit"))
    found = found.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(size >> 6, np.uint64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits


def counted_lists(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """``h`` and ``long`` of the counted shingles that stand in two texts or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            sets = [shingles(normal(t), rolling, width) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(flat[half(flat)].view(np.int64))], names=["h"])

    found = texts.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    return materialize(found.select("h", (F.col("n") > SHORT).alias("long")), "join-lists")


def merged_lists(hashes: np.ndarray, shared: np.ndarray, long: np.ndarray, percent: int) -> np.ndarray:
    """Of the n - T + e first lists in the order those that may hold another set."""
    n = len(hashes)
    p = n - required(n, percent) + extra(n)
    own = half(hashes)
    rank = np.where(own, np.where(marked(shared, hashes), np.where(marked(long, hashes), 3, 1), 0), 2)
    if np.count_nonzero(rank == 0) >= p:
        return hashes[:0]
    first = np.lexsort((hashes, rank))[:p]
    return hashes[first[rank[first] > 0]]


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity bits: the sketches of two sets differ in at most as many bits as the sets in shingles."""
    bits = np.bincount((hashes >> np.uint64(64 - (SKETCH * 64 - 1).bit_length())).astype(np.int64), minlength=SKETCH * 64) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def indexed(rows: DataFrame, shared: np.ndarray, long: np.ndarray, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``row``, ``c`` (16-byte hash of the words, null without any), ``n`` and, where a partner is possible, ``lists``, ``hashes`` (the set) and ``parity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            c, n, lists, sets, parity = [], [], [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = normal(text)
                hashes = shingles(words, rolling, width)
                c.append(xxhash.xxh3_128_digest(words) if words else None)
                n.append(len(hashes))
                few = merged_lists(hashes, shared, long, percent)
                lists.append(few.view(np.int64) if len(few) else None)
                sets.append(hashes.tobytes() if len(few) else None)
                parity.append(sketch(hashes) if len(few) else None)
            many = pa.list_(pa.int64())
            arrays = [batch.column("row"), pa.array(c, pa.binary()), pa.array(n, pa.int64()), pa.array(lists, many), pa.array(sets, pa.binary()), pa.array(parity, many)]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "c", "n", "lists", "hashes", "parity"])

    own = StructType.fromDDL("c binary, n long, lists array<long>, hashes binary, parity array<long>")
    schema = StructType([rows.schema["row"], *own.fields])
    return materialize(rows.mapInArrow(run, schema), "join-rows")


def merged(lists: list[dict]) -> Iterator[tuple[bytes, int]]:
    """Members of inverted lists (``m`` in order, ``w`` equal lists) and in how many lists each is, by a heap."""
    runs = [[(m, x["w"]) for m in x["m"]] for x in lists]
    for member, same in groupby(heapq.merge(*runs), key=lambda x: x[0]):
        yield member, sum(w for _, w in same)


def candidates(postings: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``a`` > ``b`` and ``seen``: pairs of sets that may share enough lists, from the lists of up to ``SHORT`` sets.

    A member is written as its hash, its size and the number of its longer lists, 24 bytes, which sort by the hash.
    """
    # lists with the same members are one list with a weight
    few = postings.where(F.col("size") <= SHORT).select("h", F.concat("c", F.unhex(F.lpad(F.hex("n"), 8, "0")), F.unhex(F.lpad(F.hex("long"), 8, "0"))).alias("m"))
    few = few.groupBy("h").agg(F.sort_array(F.collect_list("m")).alias("m")).groupBy("m").agg(F.count("*").cast("int").alias("w"))
    asked = few.select(F.explode("m").alias("q"), F.struct("m", "w").alias("x")).groupBy("q").agg(F.collect_list("x").alias("lists"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda m, at: int.from_bytes(m[at : at + 4], "big")
        for batch in batches:
            a, b, seen = [], [], []
            for q, lists in zip(batch.column("q").to_pylist(), batch.column("lists").to_pylist()):
                n, long = number(q, 16), number(q, 20)
                for m, k in merged(lists):
                    if m >= q:
                        break
                    size = number(m, 16)
                    like = 100 * min(n, size) >= percent * max(n, size)
                    if like and k + min(long, number(m, 20)) >= extra(min(n, size)):
                        a.append(q[:16])
                        b.append(m[:16])
                        seen.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(seen, pa.int64())], names=["a", "b", "seen"])

    return materialize(asked.mapInArrow(run, "a binary, b binary, seen long"), "join-candidates")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``a``, ``b`` whose overlap reaches the Jaccard index: each shingle of the smaller set is probed in the larger one."""
    x, y = (sets.select(F.col("c").alias(k), F.col("hashes").alias(f"h_{k}")) for k in "ab")
    both = pairs.select("a", "b").join(x, "a").join(y, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = []
            for s, t in zip(batch.column("h_a"), batch.column("h_b")):
                s, t = sorted((np.frombuffer(v.as_buffer(), np.uint64) for v in (s, t)), key=len)
                overlap = np.count_nonzero(t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s)
                fine.append(100 * int(overlap) >= percent * (len(s) + len(t) - int(overlap)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(fine, pa.bool_()))

    return materialize(both.mapInArrow(run, "a binary, b binary"), "join-links")


def across(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """``a``, ``b``, ``part_a`` and ``part_b`` of the pairs ``a``, ``b`` of different components."""
    x, y = (parts.toDF(k, f"part_{k}") for k in "ab")
    return pairs.join(x, "a").join(y, "b").where("part_a <> part_b")


def joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``c`` and ``part`` (the smallest set that is reached) after further ``links`` (``a``, ``b``) join components of ``parts``."""
    if links.isEmpty():
        return parts
    tops = connected_components(across(links, parts).select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))).toDF("part", "top")
    out = materialize(parts.join(tops, "part", "left").select("c", F.coalesce("top", "part").alias("part")), "join-parts")
    release(links)
    return out


def alike(n: str, m: str, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def long_prefix(postings: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``h``, ``c``, ``n`` and ``long``: of each set's long lists all but the e - 1 longest, by one order of all lists.

    Sets that share no short list are similar only if they share e long ones, e by the least size that a partner
    can have, so one of those they share is among the first long - e + 1 of both.
    """
    first = F.col("long") - F.floor((F.col("n") * percent + 99) / 1000)
    rows = postings.where((F.col("size") > SHORT) & (first > 0))
    nth = F.row_number().over(Window.partitionBy("c").orderBy("size", "h"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= first).select("h", "c", "n", "long")


def long_links(heavy: DataFrame, sets: DataFrame, parts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``parts`` joined by the links of sets that may share only lists of more than ``SHORT`` sets.

    ``heavy``: ``h``, ``c``, ``n``, ``long`` and ``parity`` for each such list and set (``long_prefix``). In a round
    each list names one member, first the one with the largest part of long lists, later any, and
    the members of other components are compared with it. The last round, after ``ROUNDS`` of them
    or one that links less than a tenth of what it compares, compares all members of different
    components in the lists that still have some, by sizes and sketches inside the join.
    """
    k, last = 0, False
    while not last:
        now = heavy.join(parts, "c")
        central = F.struct(F.col("long") / F.col("n") if k == 0 else F.lit(0.0), F.xxhash64("c", F.lit(k)))
        hub = F.max_by(F.struct("c", "part", "n"), central).alias("hub")
        mixed = now.groupBy("h").agg(F.min("part").alias("least"), F.max("part").alias("most"), hub)
        mixed = materialize(mixed.where("least <> most").select("h", "hub"), "join-mixed")
        if mixed.isEmpty():
            break
        last = last or k >= ROUNDS
        if not last:
            met = now.join(mixed, "h").where((F.col("part") != F.col("hub.part")) & alike("n", "hub.n", percent))
            pairs = met.select(F.col("c").alias("a"), F.col("hub.c").alias("b"))
        else:
            x, y = (now.join(mixed, "h", "left_semi").select("h", *[F.col(c).alias(f"{c}{i}") for c in ("c", "n", "part", "parity")]) for i in "xy")
            far = sum((F.bit_count(F.get("parityx", F.lit(w)).bitwiseXOR(F.get("parityy", F.lit(w)))) for w in range(SKETCH)), F.lit(0))
            near = far * (100 + percent) <= (F.col("nx") + F.col("ny")) * (100 - percent)
            pairs = x.join(y, "h").where((F.col("cx") > F.col("cy")) & (F.col("partx") != F.col("party")) & alike("nx", "ny", percent) & near)
            pairs = pairs.select(F.col("cx").alias("a"), F.col("cy").alias("b"))
        pairs = materialize(pairs.distinct(), "join-pairs")
        links = verified(pairs, sets, percent)
        fruitless = not last and 10 * links.count() < pairs.count()
        parts = joined(parts, links)
        release(mixed, pairs)
        k = ROUNDS if fruitless else k + 1
    return parts


def linked(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``c`` and ``part`` (the smallest ``c`` that links reach) of the texts that may have a link to another one."""
    one = F.first(F.struct("n", "lists", "hashes", "parity")).alias("x")
    sets = materialize(rows.where("lists IS NOT NULL").groupBy("c").agg(one).select("c", "x.*"), "join-sets")
    each = sets.select("c", "n", F.explode("lists").alias("h"))
    sizes = each.groupBy("h").agg(F.count("*").alias("size")).where("size > 1")
    each = materialize(each.join(sizes, "h"), "join-lists")
    long = each.groupBy("c").agg(F.sum((F.col("size") > SHORT).cast("long")).alias("long"))
    postings = materialize(each.join(long, "c"), "join-postings")
    pairs = candidates(postings, percent)
    best = pairs.groupBy("a").agg(F.max_by("b", "seen").alias("b"))
    parts = joined(sets.select("c", F.col("c").alias("part")), verified(best, sets, percent))
    parts = joined(parts, verified(across(pairs, parts), sets, percent))
    heavy = materialize(long_prefix(postings, percent).join(sets.select("c", "parity"), "c"), "join-heavy")
    release(each, postings, pairs)
    return long_links(heavy, sets, parts, percent)


def join_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The columns of ``docs`` but for ``text``, ``n_shingles`` (size of the set) and ``component_id``.

    ``component_id`` is the smallest ``doc_id`` that a document reaches by links, its own included.
    Null and empty texts, and those of blanks alone, have no shingle, link with nothing and keep
    their own id. A null ``doc_id`` keeps its row and is no candidate (null if the whole component
    has none). Repeated rows stay rows; texts of any length count whole; no rows give no rows.
    Columns named ``n_shingles`` or ``component_id`` are replaced, all others pass through.
    """
    source_columns(docs, "doc_id", "text")
    docs = docs.drop("n_shingles", "component_id")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "text")
    lists = counted_lists(docs.select("text"), width)
    tidy(docs.sparkSession)
    rows = indexed(rows, bit_map(lists), bit_map(lists.where("long")), width, percent)
    release(lists)
    parts = linked(rows, percent)
    least = rows.where("c IS NOT NULL").groupBy("c").agg(F.min("row.doc_id").alias("least"))
    named = materialize(least.join(parts, "c", "left").select("c", "least", F.coalesce("part", "c").alias("part")), "join-named")
    top = named.groupBy("part").agg(F.min("least").alias("component_id"))
    found = named.join(top, "part").select("c", "component_id")
    out = rows.select("row", "c", F.col("n").alias("n_shingles")).join(found, "c", "left")
    own = F.when(F.col("c").isNull(), F.col("row.doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return out.select("row.*", "n_shingles", own)


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
