"""Tables that batches grow: sums that a repeated batch can't add twice, and keys that have been seen."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import delete, list_dir, make_dir, move


class StoredSums:
    """A stored table of sums by key: ``apply`` adds a batch's rows to it.

    Rows lie in ``buckets`` folders by a hash of their key, each with a version named by the batch
    that wrote it. A batch reads, of the buckets that it touches alone, the newest version of an
    earlier batch, and writes its own; a file that names the batch commits it. So a batch that runs
    again, after a failure at any point or after its commit, gives the same table, and readers see
    whole batches. Batches must come in rising order; only the newest may be repeated.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], sums: list[str], buckets: int = 16):
        self.spark, self.path, self.keys, self.sums, self.buckets = spark, path.rstrip("/"), keys, sums, buckets
        make_dir(spark, f"{self.path}/_committed")

    def last(self) -> int:
        """The newest committed batch, -1 if there is none."""
        return max((int(n) for n, _ in list_dir(self.spark, f"{self.path}/_committed") if n.isdigit()), default=-1)

    def versions(self, bucket: int) -> list[int]:
        names = [n for n, _ in list_dir(self.spark, f"{self.path}/bucket={bucket}")]
        return sorted(int(n[8:]) for n in names if re.fullmatch(r"version=\d+", n))

    def files(self, before: int, buckets: list[int]) -> list[str]:
        """The newest version of each bucket that is older than ``before``."""
        found = [(b, max((v for v in self.versions(b) if v < before), default=None)) for b in buckets]
        return [f"{self.path}/bucket={b}/version={v}" for b, v in found if v is not None]

    def read(self) -> DataFrame | None:
        """The table as of the newest committed batch; null before the first."""
        paths = self.files(self.last() + 1, list(range(self.buckets)))
        return self.spark.read.parquet(*paths).select(*self.keys, *self.sums) if paths else None

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def apply(self, rows: DataFrame, batch: int) -> None:
        last = self.last()
        if batch < last:
            raise ValueError(f"batch {batch} is older than {last}, which is committed")
        added = [F.sum(c).alias(c) for c in self.sums]
        stage = f"{self.path}/_stage-{uuid.uuid4().hex}"
        rows.groupBy(*self.keys).agg(*added).write.parquet(f"{stage}/new")
        new = self.spark.read.parquet(f"{stage}/new")
        touched = [r[0] for r in new.select(self.bucket()).distinct().collect()]  # at most ``buckets``
        if paths := self.files(batch, touched):
            old = self.spark.read.parquet(*paths).select(*self.keys, *self.sums)
            new = new.unionByName(old).groupBy(*self.keys).agg(*added)
        new.withColumn("bucket", self.bucket()).write.partitionBy("bucket").parquet(f"{stage}/out")
        for b in touched:
            make_dir(self.spark, f"{self.path}/bucket={b}")
            delete(self.spark, f"{self.path}/bucket={b}/version={batch}")
            move(self.spark, f"{stage}/out/bucket={b}", f"{self.path}/bucket={b}/version={batch}")
        make_dir(self.spark, f"{self.path}/_committed/{batch}")
        delete(self.spark, stage)
        for b in touched:  # what no repeated batch needs
            for v in [v for v in self.versions(b) if v < batch][:-1]:
                delete(self.spark, f"{self.path}/bucket={b}/version={v}")


class SeenSet:
    """Keys that have been seen, in a table bucketed by their hash and partitioned by generation and batch.

    ``split`` joins a batch with the partitions of its own generations alone. The table is read by
    bucket, so only the batch is shuffled. In front of the join a bit map of the generation's keys,
    of ``bits`` bits whatever their number, lets rows go by that are new for certain. A batch sees
    the keys of earlier batches only and replaces its own, so that it may be repeated.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 16, bits: int = 1 << 23):
        self.spark, self.name, self.path, self.buckets, self.bits = spark, name, path.rstrip("/"), buckets, bits
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (h BIGINT, k BIGINT, gen BIGINT, batch BIGINT) USING parquet "
            f"PARTITIONED BY (gen, batch) CLUSTERED BY (h) SORTED BY (h) INTO {buckets} BUCKETS LOCATION '{self.path}/keys'"
        )
        make_dir(spark, f"{self.path}/keys")
        spark.sql(f"MSCK REPAIR TABLE {name}")
        spark.catalog.refreshTable(name)

    @staticmethod
    def hashes(keys: list[Column]) -> list[Column]:
        """128 bits of the key columns; nulls are equal to each other and to nothing else."""
        texts = [x for k in keys for x in (k.isNull(), k.cast("string"))]
        return [F.xxhash64(*texts).alias("_h"), F.xxhash64(F.lit("second"), *texts).alias("_k")]

    def map_of(self, generations: list[int], batch: int) -> DataFrame | None:
        """``_gen``, ``_word`` and ``_set``: the bits of the keys that earlier batches brought."""
        paths = [f"{self.path}/bits/{n}" for n, _ in list_dir(self.spark, f"{self.path}/bits") if n.isdigit() and int(n) < batch]
        if not paths:
            return None
        rows = self.spark.read.parquet(*paths).where(F.col("gen").isin(generations))
        return rows.groupBy(F.col("gen").alias("_gen"), F.col("word").alias("_word")).agg(F.bit_or("bits").alias("_set"))

    def word(self, h: str) -> Column:
        return F.shiftrightunsigned(F.col(h), 6).bitwiseAND(F.lit(self.bits // 64 - 1))

    def marked(self, df: DataFrame, keys: list[Column], generation: Column, batch: int) -> DataFrame:
        """``df`` and ``seen``: whether an earlier batch brought the key in the same generation. Repeats within ``df`` are left to the caller."""
        rows = df.select("*", *self.hashes(keys), generation.cast("long").alias("_gen"))
        generations = [r[0] for r in rows.select("_gen").distinct().collect()]  # those within the retention
        bits = self.map_of(generations, batch)
        if bits is None:
            return rows.withColumn("seen", F.lit(False)).drop("_h", "_k", "_gen")
        rows = rows.withColumn("_word", self.word("_h")).join(F.broadcast(bits), ["_gen", "_word"], "left")
        maybe = F.coalesce(F.expr("getbit(_set, cast(_h & 63 AS int)) = 1"), F.lit(False))
        rows = rows.withColumn("_maybe", maybe).drop("_word", "_set")
        table = self.spark.table(self.name).where(F.col("gen").isin(generations) & (F.col("batch") < batch))
        known = table.select("h", "k", "gen").toDF("_th", "_tk", "_tg")
        # joined on the bucketed column alone, so that the table stays where it lies; as plain equalities the others would be keys as well
        same = (F.col("_h") == F.col("_th")) & (F.col("_k").bitwiseXOR(F.col("_tk")) == 0) & (F.col("_gen").bitwiseXOR(F.col("_tg")) == 0)
        asked, new = rows.where("_maybe"), rows.where("NOT _maybe").withColumn("seen", F.lit(False))
        met = asked.join(known, same, "left_semi").withColumn("seen", F.lit(True))
        unmet = asked.join(known, same, "left_anti").withColumn("seen", F.lit(False))
        return met.unionByName(unmet).unionByName(new).drop("_h", "_k", "_gen", "_maybe")

    def add(self, df: DataFrame, keys: list[Column], generation: Column, batch: int) -> None:
        """Adds the keys of ``df`` as those of ``batch``, in place of what it has added before."""
        self.drop(lambda g, b: b == batch)
        new = df.select(*self.hashes(keys), generation.cast("long").alias("gen")).toDF("h", "k", "gen").distinct()
        rows = new.withColumn("batch", F.lit(batch).cast("long")).repartition(self.buckets, "h")
        rows.write.mode("append").format("parquet").partitionBy("gen", "batch").bucketBy(self.buckets, "h").sortBy("h").saveAsTable(self.name)
        bits = rows.select("gen", self.word("h").alias("word"), F.expr("shiftleft(1L, cast(h & 63 AS int))").alias("bit"))
        bits.groupBy("gen", "word").agg(F.bit_or("bit").alias("bits")).write.mode("overwrite").parquet(f"{self.path}/bits/{batch}")

    def partitions(self) -> list[tuple[int, int]]:
        """Generation and batch of each partition."""
        found = self.spark.sql(f"SHOW PARTITIONS {self.name}").collect()
        return [tuple(int(x.partition("=")[2]) for x in r[0].split("/")) for r in found if "__HIVE" not in r[0]]

    def drop(self, gone) -> int:
        """Drops the partitions for which ``gone(generation, batch)`` holds, files included, and says how many."""
        parts = [p for p in self.partitions() if gone(*p)]
        for g, b in parts:
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (gen={g}, batch={b})")
            delete(self.spark, f"{self.path}/keys/gen={g}/batch={b}")
        return len(parts)
