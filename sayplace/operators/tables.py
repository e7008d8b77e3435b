"""Tables in the shared folder, and ranks of all rows without one task that sorts them all."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder all executors share (spark.checkpoint.dir), gone when the session's JVM ends.

    Where the setting is unset, a local session gets a temporary folder; on a cluster it is an error, as
    each machine would write to a disk of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sayplace-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base}/{name}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared folder."""
    path = shared_path(df.sparkSession, f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: Sequence[Column | str], out: str) -> DataFrame:
    """df with out: the place of each row in this order, from 0 without gaps; the order has to tell all rows apart.

    Rows go to ranges of the order, each range is sorted by itself and begins where the one before it
    ends. Which rows are in a range depends on a sample, so the ranges are written before they are counted.
    """
    keys = [c if isinstance(c, Column) else F.col(c) for c in order]
    ranges = written(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    counts = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # As many rows as there are shuffle partitions.
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    return ranges.join(F.broadcast(starts), "_range").withColumn(out, (F.col("_start") + within - 1).cast("long")).drop("_range", "_start")
