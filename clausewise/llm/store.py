"""Shared scratch space and small session helpers.

Intermediate results are cut by writing Parquet below ``spark.checkpoint.dir``, which
every executor can read, so a lost executor costs a re-read and never a lost block.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; the warehouse where that is unset, unless executors elsewhere could not share it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        if root.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the scratch root, deleted when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the scratch folder and read it back (lineage ends here)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Filters hold 32 bits a key, at most 2**26 bits (8 MB) and then no less than eight a key; beyond that their users join instead.
MOST_BITS = 26
#: Arrow batches on their way to Python: a few megabytes, as every task holds some on both sides.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch limits to ``BATCH``; smaller settings of the user stay."""
    for key, most in BATCH.items():
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or int(now) <= 0 or int(now) > int(most):
            spark.conf.set(key, most)


class Filter:
    """Membership of bigint keys in a bit array that is sent to all executors: one bit a key, at its low bits.

    False positives are possible; every user accepts them. ``make`` returns None for more keys than the
    largest array is meant for.
    """

    def __init__(self, words, bits: int):
        self.words, self.bits = words, bits

    @staticmethod
    def make(keys: DataFrame, column: str, most_bits: int | None = None):
        """A filter of the ``column`` of ``keys``, which is counted first."""
        import numpy as np

        most = MOST_BITS if most_bits is None else most_bits
        n = max(1, keys.count())
        if 8 * n > 1 << most:
            return None
        bits = max(16, min(most, math.ceil(math.log2(32 * n))))
        packed = (
            keys.select(F.expr(f"pmod({column}, {1 << bits}L)").alias("b"))
            .groupBy(F.shiftright("b", 6).cast("int").alias("w"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("v"))
            .toArrow()
        )
        words = np.zeros(1 << (bits - 6), dtype=np.uint64)
        words[packed.column("w").to_numpy()] = packed.column("v").to_numpy().view(np.uint64)
        return Filter(keys.sparkSession.sparkContext.broadcast(words), bits)

    def passes(self, keys):
        """Which of the uint64 ``keys`` may be in."""
        import numpy as np

        words, b = self.words.value, keys & np.uint64((1 << self.bits) - 1)
        return (words[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) != 0
