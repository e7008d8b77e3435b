"""Token counts by a two-tier lookup on the map side: a broadcast table of frequent pieces, then what each worker remembers."""

from __future__ import annotations

import os
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sayplace.llm.common import bound_batches, held, released
from sayplace.llm.tokenizer import CACHE_CHARS, Remembered, byte_level_pieces, counted, grouped

#: Each task reports its commonest pieces, so many at most; the broadcast table has so many in all.
PER_TASK, TABLE = 1024, 65536
#: A task's counter is cut to a quarter, the commonest, when it has grown to this.
COUNTER = 400_000


def ship(spark: SparkSession, path: str) -> str:
    """Send the tokenizer's file to the executors; returns the name to open it by."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def local(name: str) -> str:
    return SparkFiles.get(name)


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(byte_level_pieces(text or ""))
            if len(counts) > COUNTER:
                counts = Counter(dict(counts.most_common(COUNTER // 4)))
    best = [(p, n) for p, n in counts.most_common(PER_TASK) if n > 1 and len(p) <= CACHE_CHARS]
    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], names=["piece", "n"])


def _count(name: str, token: str, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Remembered:
            pieces, lengths = table.value
            return Remembered(local(name), counted, dict(zip(pieces.split("\0"), lengths)) if lengths else {})

        known: Remembered = held(token, made)
        for keys, texts in grouped(batches):
            cut = [byte_level_pieces(t, known.specials) for t in texts]
            counts = known.lookup(cut, sum)
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array([len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(counts, pa.int64())],
                names=["id", "n_bytes", "n_tokens"])

    return run


def frequent(df: DataFrame, text: str) -> list[str]:
    """The commonest pieces over all rows: each task sends the head of its own count, so no pre-token is shuffled."""
    heads = df.select(F.col(text)).mapInArrow(released(_common), "piece string, n long")
    rows = heads.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(TABLE).collect()
    return [r["piece"] for r in rows if "\0" not in r["piece"]]


def token_counts(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """Rows (id, n_bytes, n_tokens), one for every row of df, as the tokenizers library counts whole texts.

    Without begin, end or added special tokens; strings of special tokens inside a text are what the
    library takes them for. Null and empty texts have 0. Repeated rows give repeated rows; other columns
    are left out. The broadcast table has a fixed number of short pieces, and workers forget the older of
    two generations, so memory doesn't follow the input; the tables change speed only.
    """
    spark = df.sparkSession
    bound_batches(spark)
    name = ship(spark, path)
    pieces = frequent(df, text)
    # Pieces have 64 characters at most, so their lengths fit in a byte each.
    lengths = Remembered(path, counted).encode(pieces) if pieces else []
    table = spark.sparkContext.broadcast(("\0".join(pieces), bytes(lengths)))
    return df.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(
        released(_count(name, uuid.uuid4().hex, table)), f"id {df.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long")
