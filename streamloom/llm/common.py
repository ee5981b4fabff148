"""What the training-data operators share: written tables, row keys and text rules."""

from __future__ import annotations

import atexit
import gc
import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Executors may lack this package on their path: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])

#: What separates words, and the ASCII letters that get lower-cased.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_ROOTS: dict[str, str] = {}


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(col, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application under ``spark.checkpoint.dir``.

    Where the setting is missing (tests on one machine) a folder under the warehouse serves.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        _ROOTS[app] = f"{base.rstrip('/')}/{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_drop, spark, _ROOTS[app])
    return _ROOTS[app]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # the session is gone and so are its files' owner
        return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def release(*dfs: DataFrame) -> None:
    """Deletes written tables that no later step reads."""
    for df in dfs:
        if path := getattr(df, "_written_at", None):
            _drop(df.sparkSession, path)


def tidy(spark: SparkSession) -> None:
    """Shuffle files go once the driver's garbage that names them is collected."""
    gc.collect()
    spark._jvm.System.gc()


def row_key(df: DataFrame, inside: str | None = None) -> list[Column]:
    """Two 64-bit hashes of a whole row; only rows equal in every column share them. ``inside``: the struct that holds the columns."""
    cols = [(F.col(inside)[c] if inside else F.col(f"`{c}`")).cast("string") for c in df.columns]
    null = F.concat_ws("", *[F.when(c.isNull(), "0").otherwise("1") for c in cols])
    return [
        F.xxhash64(null, *cols).alias("_k1"),
        F.xxhash64(F.lit("second"), null, *reversed(cols)).alias("_k2"),
    ]


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, not at each use inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def packed(df: DataFrame, name: str = "row") -> DataFrame:
    """All columns of ``df`` as one struct, so that no name of ours can meet one of the caller's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


#: 64-bit words of a bit map that is broadcast: least and most (2 and 32 MB). About 16 bits for each value until the most is reached.
MAP_LEAST, MAP_MOST = 1 << 18, 1 << 22


def perhaps_in(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` less most of those whose ``key`` (a hash) is not in ``wanted``, by a broadcast bit map of bounded size.

    A full map lets all rows pass: the join that follows decides in any case.
    """
    n = wanted.count()
    words = MAP_LEAST
    while words < MAP_MOST and words * 4 < n:
        words *= 2
    word = F.shiftrightunsigned(key, 6).bitwiseAND(F.lit(words - 1)).alias("_word")
    bits = wanted.select(word, F.expr(f"shiftleft(1L, cast({key} & 63 as int))").alias("_bit"))
    bits = bits.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    here = rows.select("*", word).join(F.broadcast(bits), "_word")
    return here.where(F.expr(f"getbit(_bits, cast({key} & 63 as int)) = 1")).drop("_word", "_bits")


def source_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; there are {df.columns}")
