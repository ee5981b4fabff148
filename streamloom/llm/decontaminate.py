"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

DataFrame and SQL functions only. Words are runs of letters and digits, lower-cased; of scripts
without spaces each character is a word. A shingle is five words in a row, and an item of fewer
words is one shingle of all of them. A window and an item are similar if their multisets of shingles
are: the sum of the smaller counts over that of the larger, 0.8 or more. Only windows that hold
enough shingles of items of their size are made: no other can be similar.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, materialize, packed, source_columns, table

WIDTH, SIMILARITY = 5, 0.8
#: Bits that differ at most, blocks of a fingerprint. 17 // 6 = 2: some block differs in two bits or fewer.
RADIUS, BLOCKS = 17, 6
#: Shingles of the benchmark that are broadcast at most (16 bytes each); beyond, the join shuffles.
BROADCAST_SHINGLES = 2_000_000


#: Scripts that are written without spaces.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"


def words(text: Column) -> Column:
    lower = F.lower(text)
    apart = F.when(lower.rlike(UNSPACED), F.regexp_replace(lower, f"({UNSPACED})", " $1 ")).otherwise(lower)
    return F.filter(F.split(apart, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(word_list: Column, width: int = WIDTH) -> Column:
    """Hashes of the shingles in order, repeats included; no word, no shingle."""

    def cut(w: Column) -> Column:
        many = F.transform(
            F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])
        )
        one = F.array(F.xxhash64(F.array_join(w, " ")))
        return F.when(F.size(w) >= width, many).when(F.size(w) > 0, one).otherwise(F.array().cast("array<bigint>"))

    return bound(word_list, cut)


def simhash(hashes: Column) -> Column:
    """64-bit SimHash of an array of hashes: a bit is set if over half of them have it."""

    def bits(hs: Column) -> Column:
        def bit(total: Column, i: Column) -> Column:
            ones = F.aggregate(hs, F.lit(0), lambda n, h: n + F.getbit(h, i).cast("int"))
            return F.when(ones * 2 > F.size(hs), total.bitwiseOR(F.get(powers, i))).otherwise(total)

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit)

    powers = F.array(*[F.lit((1 << i) - ((1 << 64) if i == 63 else 0)) for i in range(64)])
    return bound(hashes, bits)


def block_bounds(blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """First bit and width of each block."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def block_values(fp: Column, blocks: int = BLOCKS) -> list[Column]:
    return [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << n) - 1)) for a, n in block_bounds(blocks)]


def flips(width: int, most: int) -> list[int]:
    """All values of ``width`` bits with ``most`` bits set or fewer."""
    return [sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(width), k)]


def multiset_similarity(x: Column, y: Column) -> Column:
    """Sum of smaller counts over sum of larger counts."""
    both = F.array_intersect(x, y)
    count = lambda a, v: F.size(F.filter(a, lambda u: u == v))
    repeated = F.aggregate(both, F.lit(0), lambda n, v: n + F.least(count(x, v), count(y, v)))
    plain = (F.size(F.array_distinct(x)) == F.size(x)) | (F.size(F.array_distinct(y)) == F.size(y))
    common = F.when(plain, F.size(both)).otherwise(repeated)
    total = F.size(x) + F.size(y) - common
    return F.when(total > 0, common / total).otherwise(F.lit(0.0))


def items_of(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``key``, ``item_id``, ``words`` (number), ``n`` (shingles), ``hs``; items without a word can't be found and are left out.

    The key tells items apart by id and text, so that null and repeated ids are items of their own.
    """
    each = benchmark.select("item_id", "text", words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    key = F.xxhash64(F.col("item_id").isNull(), "item_id", "text").alias("key")
    return each.select(key, "item_id", F.size("w").alias("words"), shingles(F.col("w"), width).alias("hs")).select(
        "key", "item_id", "words", F.size("hs").alias("n"), "hs"
    )


def sized(parts: DataFrame) -> DataFrame:
    """``parts``, to be broadcast if it has ``BROADCAST_SHINGLES`` rows or fewer."""
    parts = materialize(parts, "item-shingles")
    return F.broadcast(parts) if parts.count() <= BROADCAST_SHINGLES else parts


def ends(at: Column, n: Column, similarity: float) -> Column:
    """Starts of the windows of ``n`` shingles that end at one of the sorted positions ``at`` and hold enough of them.

    The first of the best windows ends at a shared shingle, or else the one before would be as
    good, or is the first of the text. A similar window of full size has 2J/(1+J) n shared
    shingles or more, the first of a text, which may be shorter, Jn.
    """
    full, part = (F.ceil(n * F.lit(share) - 1e-9).cast("int") for share in (2 * similarity / (1 + similarity), similarity))
    least = lambda p: F.when(p >= n - 1, full).otherwise(part)
    enough = lambda p, i: F.get(at, i + 1 - least(p)) > p - n
    return F.transform(F.filter(at, enough), lambda p: F.greatest(p - n + 1, F.lit(0)))


def windows(docs: DataFrame, items: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """Item-sized windows of each document that hold enough shingles of the items of that size, see ``ends``.

    A shingle counts once for each size of the items that have it, however many they are.
    Columns: ``doc_id``, ``th`` (text hash), ``start`` (word), ``n`` and ``win`` (shingle hashes).
    """
    parts = sized(items.select("n", F.explode("hs").alias("h")).distinct())
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    shared = (
        keyed.select("doc_id", "th", F.posexplode(shingles(words(F.col("text")), width)).alias("pos", "h"))
        .join(parts, "h")
        .groupBy("doc_id", "th", "n")
        .agg(F.array_sort(F.collect_set("pos")).alias("pos"))
    )
    found = shared.select("doc_id", "th", "n", F.explode(F.array_distinct(ends(F.col("pos"), F.col("n"), similarity))).alias("start"))
    places = materialize(
        found.groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(F.collect_list(F.struct("start", "n")).alias("at")),
        "windows-at",
    )
    rows = keyed.join(places, [F.col("doc_id").eqNullSafe(F.col("_d")), F.col("th") == F.col("_t")])
    cut = bound(
        shingles(words(F.col("text")), width),
        lambda hs: F.transform(
            F.col("at"), lambda a: F.struct(a["start"].alias("start"), a["n"].alias("n"), F.slice(hs, a["start"] + 1, a["n"]).alias("win"))
        ),
    )
    return rows.select("doc_id", "th", F.explode(cut).alias("w")).select("doc_id", "th", "w.*")


def short_hits(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame | None:
    """Where items of fewer than ``width`` words stand, word by word: ``doc_id``, ``th``, ``key``, ``start``; null if there is no such item."""
    sizes = sorted(r[0] for r in items.where(F.col("words") < width).select("words").distinct().collect())
    if not sizes:
        return None
    parts = sized(items.where(F.col("words") < width).select("key", "words", F.get("hs", F.lit(0)).alias("h")))

    def runs(w: Column) -> Column:
        some = lambda n: F.transform(
            F.filter(F.sequence(F.lit(0), F.size(w)), lambda i: i <= F.size(w) - n),
            lambda i: F.struct(F.lit(n).alias("words"), i.alias("start"), F.xxhash64(F.array_join(F.slice(w, i + 1, n), " ")).alias("h")),
        )
        return F.concat(*[some(n) for n in sizes])

    cut = F.explode(bound(words(F.col("text")), runs)).alias("r")
    each = docs.select("doc_id", F.xxhash64("text").alias("th"), cut).select("doc_id", "th", "r.*")
    return each.join(parts, ["words", "h"]).groupBy("doc_id", "th", "key").agg(F.min("start").alias("start"))


def leaks(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS
) -> DataFrame:
    """``doc_id``, ``th`` (text hash), ``item_id``, ``start_word``, ``similarity`` of each item that a document holds.

    The best window of each document and item; ties go to the first. Null and empty texts hold
    nothing, texts may be of any length, an item below five words is found where all its words
    stand in a row. Repeated rows count once; items with a null id or an id that repeats with
    another text are items of their own. Other columns are left out. Empty tables give no rows.
    """
    source_columns(docs, "doc_id", "text")
    source_columns(benchmark, "item_id", "text")
    every = materialize(items_of(benchmark, width).withColumn("fp", simhash(F.col("hs"))), "items")
    items = every.where(F.col("words") >= width)
    wins = windows(docs, items, width, similarity)
    wins = materialize(
        wins.select("*", F.xxhash64("win").alias("c1"), F.xxhash64(F.lit(2), "win").alias("c2")), "windows"
    )
    texts = wins.groupBy("c1", "c2", "n").agg(F.first("win").alias("win"))
    texts = materialize(texts.withColumn("fp", simhash(F.col("win"))), "window-texts")
    named = lambda fp: F.posexplode(F.array(*block_values(F.col(fp), blocks))).alias("block", "value")
    steps = F.array(*[F.array(*[F.lit(v).cast("long") for v in flips(n, radius // blocks)]) for _, n in block_bounds(blocks)])
    index = items.select("key", "n", F.col("fp").alias("ifp"), named("fp")).select(
        "key", "n", "ifp", "block", "value", F.explode(F.get(steps, F.col("block"))).alias("step")
    )
    index = index.select("key", "n", "ifp", "block", F.col("value").bitwiseXOR(F.col("step")).alias("value"))
    asked = texts.select("c1", "c2", "n", "fp", named("fp"))
    near = (
        asked.join(index, ["n", "block", "value"])
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= radius)
        .select("c1", "c2", "n", "key")
        .distinct()
    )
    full = near.join(texts.select("c1", "c2", "n", "win"), ["c1", "c2", "n"]).join(items.select("key", "hs"), "key")
    same = full.select("c1", "c2", "n", "key", multiset_similarity(F.col("win"), F.col("hs")).alias("similarity"))
    same = materialize(same.where(F.col("similarity") >= similarity), "window-hits")
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best")
    hits = wins.select("doc_id", "th", "start", "n", "c1", "c2").join(same, ["c1", "c2", "n"])
    found = hits.groupBy("doc_id", "th", "key").agg(best)
    found = found.select("doc_id", "th", "key", (-F.col("best.back")).alias("start_word"), F.col("best.similarity").alias("similarity"))
    short = short_hits(docs, every, width)
    if short is not None:
        found = found.unionByName(short.select("doc_id", "th", "key", F.col("start").alias("start_word"), F.lit(1.0).alias("similarity")))
    return found.join(every.select("key", "item_id"), "key").select("doc_id", "th", "item_id", "start_word", "similarity")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` less the documents that hold an item of ``benchmark``; all columns pass through, whatever their names."""
    found = materialize(leaks(docs, benchmark).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).distinct(), "leaks")
    here = packed(docs).withColumn("th", F.xxhash64("row.text"))
    return here.join(found, [F.col("row.doc_id").eqNullSafe(F.col("_d")), F.col("th") == F.col("_t")], "left_anti").select("row.*")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "item_id", "start_word", F.round("similarity", 6).alias("similarity"))
