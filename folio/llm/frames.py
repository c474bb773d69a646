"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but space, \t, \n, \v, \f, \r.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine where that is unset (tests) a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="folio-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """`df` written once to the shared checkpoint folder: later reads neither recompute it nor depend on one executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """`df` written once as compressed Parquet to the shared folder, for larger tables; and what deletes it when it's no longer read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folio-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)

    def drop() -> None:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    return spark.read.parquet(path), drop


def for_workers(df: DataFrame) -> DataFrame:
    """`df`, whose session from now on sends Python workers Arrow batches of at most BATCH_BYTES (or one row), unless it has a bound of its own. Else long texts make batches of 64 MB on both sides."""
    if df.sparkSession.conf.get(BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(BATCH_SETTING, BATCH_BYTES)
    return df


def release() -> None:
    """Gives a Python worker's free memory back at the end of a task; workers outlive their stage, beside those of others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / F.lit(float(1 << 53))


def hashed_sample(df: DataFrame, key: str, most: int, count: int, seed: int = 29) -> DataFrame:
    """At most `most` of the `count` rows, those with the least hashes of the key. A threshold leaves about twice as many for the sort, so that none of its tasks grows with the table."""
    u = unit_hash(F.col(key), seed)
    return df.where(u < min(1.0, 2.0 * most / max(count, 1))).orderBy(u, key).limit(most)
