from collections import Counter

from pyspark.sql import functions as F

from sayplace.llm.sharding import rendezvous, shard


def test_weighted_shards(spark):
    df = spark.range(6000).select("id", F.col("id").cast("string").alias("text"))
    rows = shard(df, "id", "text", 3, weights=[1.0, 2.0, 0.0], grown_weight=3.0).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == 6000 and set(sizes) == {0, 1} and abs(sizes[1] - 4000) < 200
    assert all(r.grown_shard in (r.shard, 3) for r in rows) and abs(sum(r.grown_shard == 3 for r in rows) - 3000) < 200
    want = {r.id: r.s for r in df.select("id", rendezvous(F.col("id"), 3, [1.0, 2.0, 0.0]).alias("s")).collect()}
    assert {r.key: r.shard for r in rows} == want
    assert sorted(r.slot for r in rows if r.shard == 1) == list(range(sizes[1]))
