"""Places of rows in groups of any size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine where that is unset (tests) a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="folio-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def settled(df: DataFrame) -> DataFrame:
    """`df`, a narrow table that is read several times, computed once into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """`df`, a wide table that is read several times with different columns, written once as Parquet below the shared folder.

    Results may still read it, so it stays; the `folio-*` folders there can go when the results are written.
    """
    path = f"{shared_folder(df.sparkSession)}/folio-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, by, order: str, name: str, width: int = 10_000, ties=()) -> DataFrame:
    """`df` with each row's number, from 0, in its group by an integer column, then by those in `ties`; rows without it come first.

    Rows are sorted in ranges of `width` values, and a range's first number is the sum of the counts before it, so that
    no group is sorted in one task. Null is a group of its own.
    """
    # one key that may hold nulls: the window and the join share one exchange of whole rows
    key = F.struct(*by, F.coalesce(F.expr(f"`{order}` div {width}"), F.lit(-(1 << 62))).alias("_range"))
    ranged = df.withColumn("_key", key)
    held = ranged.groupBy("_key").agg(F.count("*").alias("_held"))
    before = Window.partitionBy(*[f"_key.{c}" for c in by]).orderBy("_key._range").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("_key", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_key").orderBy(order, *ties)
    placed = ranged.withColumn("_inside", F.row_number().over(inside) - 1)
    return placed.join(starts, "_key").select(*df.columns, (F.col("_before") + F.col("_inside")).alias(name))
