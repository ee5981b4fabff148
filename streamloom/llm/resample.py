"""Importance resampling toward a target distribution of hashed n-grams.

Spark functions only: n-gram arrays are exploded, each feature falls into a bucket by its crc32,
grouped counts of both tables give a gain for each bucket, a broadcast join of the gains and a sum
give a document's weight, and a distributed sort ranks the documents with Gumbel noise added, which
draws without replacement in proportion to the exponential of the weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, packed, release, row_key, source_columns, table
from .ranks import positions

BUCKETS, GRAMS, SEED = 10_000, 3, 42
#: Percent of the eligible documents that are drawn, and the words that make one eligible.
SHARE, LEAST_WORDS = 5, 20
#: Fixed value: what stands between words, ASCII but for digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OWN = ("n_features", "weight", "score", "rank")


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) runs of digits, letters and all that isn't ASCII; null texts have none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def features(rows: DataFrame, *carried: str, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """``carried``, ``n_words``, ``first`` (1 once a row) and ``bucket`` for each run of up to ``grams`` words of ``words``.

    A row without words gives rows without a bucket.
    """
    each = rows.select(*carried, "words", F.size("words").alias("n_words"))
    last = F.greatest(F.col("n_words") - 1, F.lit(0))
    each = each.select(*carried, "words", "n_words", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    word = [F.get("words", F.col("i") + k) for k in range(grams)]
    joined = [F.concat(*[x for w in word[: k + 1] for x in (F.lit(" "), w)][1:]) for k in range(grams)]
    hashed = F.array(*[F.crc32(g.cast("binary")) % buckets for g in joined])
    each = each.select(*carried, "n_words", "i", F.posexplode(hashed).alias("gram", "bucket"))
    first = ((F.col("i") == 0) & (F.col("gram") == 0)).cast("int").alias("first")
    return each.where("bucket IS NOT NULL OR (i = 0 AND gram = 0)").select(*carried, "n_words", first, "bucket")


def bucket_counts(texts: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and ``n``, how many features of all texts fall into it; at most ``buckets`` rows."""
    found = features(texts.select(words(F.col("text")).alias("words")), grams=grams, buckets=buckets)
    return found.where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(texts: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and ``gain``: floor(1000 ln) of the smoothed share of the bucket in ``target`` over that in ``texts``.

    A row for each bucket that either side has; the others are not needed.
    """
    both = [materialize(bucket_counts(t, grams, buckets), f"resample-counts-{k}") for k, t in enumerate((texts, target))]
    total, aim = (c.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for c in both)
    s, t = (F.coalesce(c, F.lit(0)).cast("double") + 1 for c in ("s", "t"))
    each = both[0].withColumnRenamed("n", "s").join(both[1].withColumnRenamed("n", "t"), "bucket", "full")
    gain = F.floor(1000 * F.log(t * float(total + buckets) / (s * float(aim + buckets))))
    out = materialize(each.select("bucket", gain.alias("gain")), "resample-gains")
    release(*both)
    return out


def weights(rows: DataFrame, gain: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """``_k1``, ``_k2``, ``n_words``, ``copies``, ``n_features`` and ``weight`` (sum of the gains) of rows (``_k1``, ``_k2``, ``text``).

    Sums combine before the shuffle; rows with equal keys are one with several ``copies``.
    """
    found = features(rows.select("_k1", "_k2", words(F.col("text")).alias("words")), "_k1", "_k2", grams=grams, buckets=buckets)
    found = found.join(F.broadcast(gain), "bucket", "left").groupBy("_k1", "_k2")
    sums = found.agg(
        F.max("n_words").alias("n_words"), F.sum("first").alias("copies"), F.count("bucket").alias("n"), F.coalesce(F.sum("gain"), F.lit(0)).alias("w")
    )
    return sums.selectExpr("_k1", "_k2", "n_words", "copies", "n div copies AS n_features", "w div copies AS weight")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 G) of a Gumbel variable that ``seed`` and the id determine; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS,
    grams: int = GRAMS, buckets: int = BUCKETS, seed: int = SEED, keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (default all) of every document, ``n_features``, ``weight``, ``score`` and ``rank``.

    ``rank`` is 1, 2, 3 ... for the ``share`` percent (rounded down) of the documents of
    ``least_words`` words or more that score highest, and null for all others; ties go to the
    smaller ``doc_id``, null ids last, then to the smaller row hash. Null and empty texts have no
    features and weight 0; texts of any length count whole. Rows equal in all columns stay rows,
    with ranks of their own. An empty ``target`` is a flat one; no documents give no rows. Columns
    of any other name pass through, the four results replace columns of their names.
    """
    source_columns(docs, "doc_id", "text")
    source_columns(target, "text")
    docs = docs.drop(*OWN)
    keep = [c for c in keep or docs.columns if c not in OWN]
    rows = packed(docs)
    rows = rows.select("row", *row_key(docs, "row"))
    gain = gains(docs.select("text"), target.select("text"), grams, buckets)
    each = materialize(weights(rows.select("row.text", "_k1", "_k2"), gain, grams, buckets), "resample-weights")
    eligible = F.col("n_words") >= least_words
    n = each.where(eligible).agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    kept = rows.select(F.struct(*[F.col("row")[c].alias(c) for c in keep]).alias("row"), F.col("row.doc_id").alias("id"), "_k1", "_k2")
    scored = kept.join(each, ["_k1", "_k2"]).select("*", (F.col("weight") + noise(F.col("id"), seed)).alias("score"))
    ranked = positions(
        scored, eligible.desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("_k1"), F.col("_k2"), name="resample-sorted"
    )
    drawn = F.when(F.col("position") < share * n // 100, F.col("position") + 1)
    return ranked.select("row.*", "n_features", "weight", "score", drawn.alias("rank"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
