"""Shared parts: tables in the shared folder, gapless numbering, fixed-size key filters, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).

    Where the setting is unset, a local session gets a temporary folder, as in tests; on a cluster it is an
    error, as each machine would write to a disk of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sayplace-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def bound_batches(spark: SparkSession, rows: int = 256) -> None:
    """Texts can be long: keep the Arrow batches that Python workers hold small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


_HELD: dict = {}


def give_back() -> None:
    """What a worker has freed goes back to the machine: workers live on, and the next stage's memory would come on top."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def held(token: str, make):
    """What make() gives, made once a worker and kept until another operator of this package holds something there."""
    if _HELD.get("token") != token:
        _HELD.clear()
        give_back()
        _HELD.update(token=token, value=make())
    return _HELD["value"]


def released(run):
    """A map of Arrow batches that gives back memory when its task ends."""

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return around


class Workspace:
    """Tables written in the shared folder: they cut lineage, survive lost executors and go when the session's JVM ends, or with drop()."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, str] = {}
        self._fs(self.root)[0].deleteOnExit(self._fs(self.root)[1])

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self.paths.pop(id(t), None)
            if path:
                fs, p = self._fs(path)
                fs.delete(p, True)


def partition_bucket(buckets: int) -> Column:
    """The scan partition's number, folded to a fixed count. Only meaningful in a table that is then written."""
    return F.pmod(F.spark_partition_id(), F.lit(buckets))


def gapless(staged: DataFrame, group: list[str], bucket: str, order: list[str], out: str) -> DataFrame:
    """Number the rows of each group 0, 1, 2 ... without bringing a group into one task.

    staged: a written table with a bucket column. Rows are numbered within (group, bucket), and each
    bucket begins where the one before it ended. The table of beginnings has groups x buckets rows at
    most, both fixed by parameters of the caller, so it is broadcast.
    """
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = staged.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n")).select(
        *group, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*group, bucket).orderBy(*order)
    numbered = staged.withColumn("_rank", F.row_number().over(within))
    return numbered.join(F.broadcast(starts), [*group, bucket]).withColumn(
        out, (F.col("_start") + F.col("_rank") - 1).cast("long")).drop("_start", "_rank")


#: The least and the most bits of a filter: half a megabyte and 32. In between, eight for each key.
FILTER_LEAST, FILTER_MOST = 1 << 22, 1 << 28
#: Fixed value: the bits of what bitmap_construct_agg makes.
SLICE_SHIFT = 15


def key_filter(keys: DataFrame, column: str, hashed: bool = False):
    """A broadcast bitmap over xxhash64 of a column, or over the column if it is a hash already. keys is read twice.

    It never misses a key and may admit others. It has bits enough for its keys up to a fixed size; beyond
    that it admits more, which costs time and not results.
    """
    bits = FILTER_LEAST
    while bits < min(FILTER_MOST, 8 * keys.count()):
        bits *= 2
    at = F.pmod(F.col(column) if hashed else F.xxhash64(F.col(column)), F.lit(bits))
    # Slices are made whole before they come to the driver: bytes, as a row for each word takes a hundred times its size there.
    placed = keys.select((F.shiftright(at, SLICE_SHIFT)).cast("int").alias("s"), at.bitwiseAND(F.lit((1 << SLICE_SHIFT) - 1)).alias("_at")).repartition("s")
    slices = placed.groupBy("s").agg(F.bitmap_construct_agg("_at").alias("b"))
    bitmap = np.zeros(bits // 64, np.uint64)
    for batch in slices.toArrow().to_batches():
        for s, b in zip(batch.column(0).to_numpy(), batch.column(1)):
            bitmap[s << SLICE_SHIFT - 6 : (s + 1) << SLICE_SHIFT - 6] = np.frombuffer(b.as_buffer(), "<u8")
    return keys.sparkSession.sparkContext.broadcast(bitmap)


def admits(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """hashes: xxhash64 of the keys, as int64."""
    at = hashes.astype(np.int64) % (len(bitmap) * 64)
    return (bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


#: The rows of a key go to one task up to so many, or up to one in HOT_SHARE of all rows; beyond that to several.
HOT_ROWS, HOT_SHARE = 512, 10_000


def hot_join(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame, n: str, total: int) -> DataFrame:
    """rows joined with table on a key, without a task that gets all rows of a hot one.

    counts: the number n of rows of each key; total: the number of all. A hot key's rows are dealt over
    as many salts as they need, and the table's row of it is copied to these: the copies are 2 * HOT_SHARE
    at most, whatever the data, and the hot keys, which are broadcast, HOT_SHARE.
    """
    limit = max(HOT_ROWS, total // HOT_SHARE)
    hot = F.broadcast(counts.filter(F.col(n) > limit).select(key, F.ceil(F.col(n) / limit).alias("_copies")))
    dealt = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.coalesce("_copies", F.lit(1).cast("long")))).drop("_copies")
    copied = table.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_copies", F.lit(1)) - 1))).drop("_copies")
    return dealt.join(copied, [key, "_salt"]).drop("_salt")


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), a != b: rows (node, root), root the smallest id reachable.

    Large-star and small-star steps in turn, each a map-side combined aggregation and a join over a table
    in the shared folder, until nothing changes; the count of rounds follows the logarithm of the
    component's size. A node of many edges isn't gathered: only minima are taken, and hot nodes' edges
    meet theirs in several tasks.
    """
    current = ws.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last, total = None, current.count()
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ws.write(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")))
        large = hot_join(both, least.drop("n"), "a", least, "n", 2 * total).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = ws.write(large.filter("a != b").distinct())
        low = ws.write(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
        small = hot_join(large, low.drop("n"), "a", low, "n", 2 * total).filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = ws.write(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        state = after.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        ws.drop(current, large, least, low)
        current, total = after, state[0]
        if state == last:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = state
