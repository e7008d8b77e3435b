"""Codecs are projections and joins to static tables, so they run on a stream of points as they are; no state is kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sayplace.operators.codecs import Plane


def encode_stream(points: DataFrame, codec: Plane, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """A streaming (or any) DataFrame of points with their cells, words and status."""
    return codec.encode(points, lat, lng)


def outside_rate(points: DataFrame, codec: Plane, time: str, window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """By windows of event time: how many points came and how many the mask doesn't cover. Late rows are waited for so long."""
    df = encode_stream(points.withWatermark(time, late), codec)
    return df.groupBy(F.window(time, window)).agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("status") == "outside").alias("outside"))


def encode_available(spark: SparkSession, path: str, codec: Plane) -> DataFrame:
    """Stream a table of orders through the codec into a table, until all that is there has run through."""
    from sayplace.operators.tables import shared_path
    from sayplace.plans.queries import with_point

    folder = shared_path(spark, f"stream-{uuid.uuid4().hex}")
    # A path may be a file or a folder of files; a stream wants a folder, so the parent is read with a filter on names.
    parent, _, name = path.rpartition("/")
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", name if _is_file(spark, path) else "*.parquet").parquet(parent if _is_file(spark, path) else path)
    out = encode_stream(with_point(rows.select("o_orderkey"), "o_orderkey"), codec)
    query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
