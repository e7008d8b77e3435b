import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from sayplace.llm.sharding import SHARD_BITS, rendezvous, shard


def expected(key, n):
    """The law, by hand: xxHash64 chained over the key and the shard; the low bits are the shard."""
    seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    best = None
    for s in range(n):
        h = xxhash.xxh64_intdigest(struct.pack("<i", s), seed)
        h = h - (1 << 64) if h >= 1 << 63 else h
        score = h >> SHARD_BITS << SHARD_BITS | s
        best = score if best is None or score > best else best
    return best & (1 << SHARD_BITS) - 1


def test_odd_rows(odd_documents):
    source = odd_documents.collect()
    rows = shard(odd_documents, "doc_id", "text", 5, buckets=3).collect()
    assert len(rows) == len(source)
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in source)
    assert Counter((r.key, r.size, r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert r.shard == expected(r.key, 5)
        assert r.grown_shard == expected(r.key, 6) and r.grown_shard in (r.shard, 5)
        slots[r.shard].append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def test_empty(no_documents):
    assert shard(no_documents, "doc_id", "text", 5).count() == 0


def test_few_rows_move(spark):
    df = spark.range(20000).select(rendezvous(F.col("id"), 40).alias("a"), rendezvous(F.col("id"), 41).alias("b"))
    moved = df.filter("a != b")
    assert moved.filter("b != 40").count() == 0
    assert 350 < moved.count() < 650
    sizes = [r["count"] for r in df.groupBy("a").count().collect()]
    assert len(sizes) == 40 and max(sizes) < 650 and min(sizes) > 370


def test_weights(spark):
    df = spark.range(20000).select(rendezvous(F.col("id"), 3, [1.0, 2.0, 1.0]).alias("a"), rendezvous(F.col("id"), 3, [1.0, 3.0, 1.0]).alias("b"), rendezvous(F.col("id"), 3, [0.0, 1.0, 0.0]).alias("c"))
    sizes = {r["a"]: r["count"] for r in df.groupBy("a").count().collect()}
    assert abs(sizes[1] - 10000) < 500 and abs(sizes[0] - 5000) < 400
    # A heavier shard only gains.
    assert df.filter("a != b and b != 1").count() == 0
    assert df.filter("c != 1").count() == 0
    with pytest.raises(ValueError):
        rendezvous(F.col("id"), 2, [0.0, 0.0])
    with pytest.raises(ValueError):
        rendezvous(F.col("id"), 0)
