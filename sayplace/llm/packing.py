"""Packing by minimum bin slack: bitset subset sums over a histogram of remaining lengths, with backtracked counts."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sayplace.llm.common import Workspace, bound_batches, gapless, held, released
from sayplace.llm.token_count import local, ship
from sayplace.llm.tokenizer import grouped
from sayplace.llm.word_ids import WordIds

#: Rows of one length are numbered in so many buckets; full windows, which may be most rows, in more.
BUCKETS, FULL_BUCKETS = 16, 4096

#: Texts are looked up together until they have so many characters.
GROUP_CHARS = 3_000_000


def pattern(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, the longest that is left among them, whose sum is closest to capacity.

    Reachable sums are the bits of one integer; each length enters in chunks of 1, 2, 4 ... of the copies
    that are left and fit, longest first, until the capacity is reached. The bits before each chunk are
    kept, and walking back over them gives how many of each length the best sum takes.
    """
    anchor = max(counts)
    room = capacity - anchor
    reach, mask = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        copies = min(counts[length] - (length == anchor), room // length)
        chunk = 1
        while copies > 0 and not reach >> room & 1:
            take = min(chunk, copies)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            copies -= take
            chunk *= 2
        if reach >> room & 1:
            break
    best = reach.bit_length() - 1
    chosen = {anchor: 1}
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            chosen[length] = chosen.get(length, 0) + take
            best -= length * take
    return chosen


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, copies in a sequence, first sequence, offset) that place every piece.

    A pattern is repeated as long as its lengths last, so each pattern leaves some length with less than
    it takes; the work and the rows follow the number of different lengths (the capacity at most), not
    the number of pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        chosen = pattern(left, capacity)
        times = min(left[n] // take for n, take in chosen.items())
        offset = 0
        for n, take in chosen.items():
            rows.append((n, rank[n], take, sequence, offset))
            offset += n * take
            rank[n] += take * times
            left[n] -= take * times
            if not left[n]:
                del left[n]
        sequence += times
    return rows


def _pieces(name: str, token: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: WordIds = held(token, lambda: WordIds(local(name)))
        end = struct.pack("<I", end_id)
        for ids_of, texts in grouped(batches, GROUP_CHARS):
            all_ids, bounds = known.lookup(texts)
            keys, starts, lengths, crcs, totals = [], [], [], [], []
            for key, first, last in zip(ids_of.to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                ids = all_ids[first:last].astype("<u4", copy=False).tobytes() + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    keys.append(key)
                    starts.append(start)
                    lengths.append(len(part) // 4)
                    crcs.append(zlib.crc32(part))
                    totals.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, ids_of.type), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals))],
                names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def _place(placed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = placed.value
        # Rows are sorted by (length, first rank); lengths fit in 22 bits beside 41 of rank.
        keys = (rows[:, 0] << 41) + rows[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            _, first, copies, sequence, offset = rows[np.searchsorted(keys, (length << 41) + rank, "right") - 1].T
            at = rank - first
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "start", "length", "ids_crc32", "doc_tokens")),
                 pa.array(sequence + at // copies), pa.array(offset + at % copies * length)],
                names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(df: DataFrame, key: str, text: str, path: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Rows (id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one for every piece.

    A document's ids (null text: empty) and the end id are cut into whole windows and a rest; rests share
    windows. Every row of df has one piece at least, also repeated rows and null ids; an empty table gives
    an empty result; other columns are left out. Offsets in a sequence run from 0 without gaps.

    Texts are read once and ids don't leave the scan: a piece is its length and checksum. The driver
    holds the histogram of lengths and the plan, both bounded by the capacity; pieces get their rank
    among those of their length, by which each finds its place in the broadcast plan.
    """
    spark = df.sparkSession
    if capacity >= 1 << 22:
        raise ValueError("capacity must be below 2**22")
    bound_batches(spark)
    ws = Workspace(spark, "packing")
    kind = df.schema[key].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = df.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(
        released(_pieces(ship(spark, path), uuid.uuid4().hex, capacity, end_id)), schema)
    buckets = F.when(F.col("length") == capacity, F.lit(FULL_BUCKETS)).otherwise(F.lit(BUCKETS))
    staged = ws.write(pieces.withColumn("bucket", F.pmod(F.spark_partition_id(), buckets)))
    counts = {r["length"]: r["n"] for r in staged.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 5)
    ranked = gapless(staged, ["length"], "bucket", ["id", "start", "ids_crc32", "doc_tokens"], "rank")
    return ranked.select("id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(
        _place(spark.sparkContext.broadcast(rows)), f"{schema}, sequence_id long, offset long")
