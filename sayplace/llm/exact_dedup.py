"""Exact deduplication by skew-safe combining: local, salted and global merges, comparing whole contents each time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sayplace.llm.common import Workspace, admits, bound_batches, key_filter, released

#: A group of copies is spread over so many salts before its winners meet.
SALTS = 16


def normalise(text: str | None) -> bytes:
    """A-Z lower-cased and nothing else, as UTF-8; null as empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _digests(digest_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = [hashlib.sha256(normalise(t)).digest() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([d[:digest_bytes] for d in full], pa.binary()), pa.array([d.hex() for d in full], pa.string())],
                names=["id", "digest", "sha"])

    return run


def _contents(digest_bytes: int, wanted):
    """Whole normalised contents of rows whose digest the filter admits, equal ones of a batch merged."""
    import numpy as np
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = wanted.value
        for batch in batches:
            merged: dict[tuple[int, bytes], list] = {}
            ids, salts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, text, salt in zip(ids, batch.column(1).to_pylist(), salts):
                content = normalise(text)
                digest = hashlib.sha256(content).digest()[:digest_bytes]
                h = np.array([xxhash.xxh64_intdigest(digest, 42)], np.uint64).view(np.int64)
                if not admits(bitmap, h)[0]:
                    continue
                known = merged.get((salt, content))
                if known is None:
                    merged[salt, content] = [digest, i, 1]
                else:
                    known[2] += 1
                    if i is not None and (known[1] is None or i > known[1]):
                        known[1] = i
            keys, values = list(merged), list(merged.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array([v[0] for v in values], pa.binary()), pa.array([k[0] for k in keys], pa.int32()),
                 pa.array([k[1] for k in keys], pa.binary()), pa.array([v[1] for v in values], pa.int64()),
                 pa.array([v[2] for v in values], pa.int64())], names=["digest", "salt", "content", "top", "n"])

    return run


def exact_dedup(df: DataFrame, key: str, text: str, salts: int = SALTS, digest_bytes: int = 32) -> DataFrame:
    """Rows (id, keep_id, group_size, kept, text_sha256), one for every row of df.

    Texts are equal when identical after lower-casing A-Z; a null text is the empty text. Of equal
    texts the largest id stays (a null id is below all others). Rows that repeat an id and its text
    stay or go together. Empty tables give empty results; other columns are left out.

    1. A narrow table of ids and digests; only digests that occur more than once go further, found by
       a map-side combined count and sent to the scan as a bitmap of fixed size.
    2. Their whole contents: equal ones of a batch merge locally, then by (digest, salt, content), then
       the salts' winners by (digest, content). Contents, not digests, decide each merge.
    3. Ids meet their group by (digest, salt), so a group of a third of all rows is spread too. Where
       different contents share a digest, they meet by content instead.
    """
    spark = df.sparkSession
    bound_batches(spark)
    ws = Workspace(spark, "exact-dedup")
    source = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    salted = source.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    narrow = ws.write(source.mapInArrow(released(_digests(digest_bytes)), "id long, digest binary, sha string"))
    many = ws.write(narrow.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest"))

    def contents(digests: DataFrame) -> DataFrame:
        return salted.mapInArrow(released(_contents(digest_bytes, key_filter(digests, "digest"))), "digest binary, salt int, content binary, top long, n long")

    by_salt = contents(many).groupBy("digest", "salt", "content").agg(F.max("top").alias("top"), F.sum("n").alias("n"))
    # The winners lie by digest from here on: the merge, and the count of contents that share a digest, need no further shuffle.
    winners = by_salt.repartition(F.col("digest")).groupBy("digest", "content").agg(
        F.max("top").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts"))
    shared = winners.groupBy("digest").agg(
        F.count(F.lit(1)).alias("variants"), F.max(F.struct("keep_id", "group_size", "salts")).alias("w"))
    one = ws.write(shared.select("digest", "variants", F.col("w.keep_id").alias("keep_id"), F.col("w.group_size").alias("group_size"), F.explode("w.salts").alias("salt")))
    known = narrow.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    rows = known.join(one, ["digest", "salt"], "left")
    clashing = one.filter("variants > 1").select("digest").distinct()
    if not clashing.isEmpty():
        apart = winners.join(clashing, "digest", "left_semi").select("digest", "content", "keep_id", "group_size")
        whole = salted.mapInArrow(_whole(digest_bytes), "id long, digest binary, sha string, content binary")
        exact = whole.join(clashing, "digest", "left_semi").join(apart, ["digest", "content"]).select("id", "sha", "keep_id", "group_size")
        rows = rows.join(clashing, "digest", "left_anti").select("id", "sha", "keep_id", "group_size").unionByName(exact)
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return rows.select(
        "id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))


def _whole(digest_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = [normalise(t) for t in batch.column(1).to_pylist()]
            full = [hashlib.sha256(c).digest() for c in contents]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([d[:digest_bytes] for d in full], pa.binary()), pa.array([d.hex() for d in full], pa.string()), pa.array(contents, pa.binary())],
                names=["id", "digest", "sha", "content"])

    return run
