"""Sharding by rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sayplace.llm.common import Workspace, gapless, partition_bucket

#: The low bits of a score hold the shard, so that one greatest() gives the winner; the most shards there can be.
SHARD_BITS = 16


def _scores(key: Column, shards: range) -> list[Column]:
    keep = F.lit(-(1 << SHARD_BITS))
    return [F.xxhash64(key, F.lit(s)).bitwiseAND(keep).bitwiseOR(F.lit(s).cast("long")) for s in shards]


def _most(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.greatest(*columns)


def _shard_of(score: Column) -> Column:
    return score.bitwiseAND(F.lit((1 << SHARD_BITS) - 1)).cast("int")


def rendezvous(key: Column, n_shards: int, weights: list[float] | None = None) -> Column:
    """The shard whose score for this key is highest.

    A shard's score depends on the key and that shard alone, so one more shard takes rows only into
    itself: about 1/(n+1) of them. weights: a shard's share of the rows, in proportion; a shard's
    weight can change without moving rows between other shards. A null key has a shard too.
    """
    if not 1 <= n_shards <= 1 << SHARD_BITS:
        raise ValueError(f"between 1 and {1 << SHARD_BITS} shards")
    if weights is None:
        return _shard_of(_most(_scores(key, range(n_shards))))
    if len(weights) != n_shards or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("a weight of 0 or more for each shard, not all 0")
    tries = []
    for s, w in enumerate(weights):
        if w > 0:
            u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(s)), 11).cast("double") + 0.5) / float(1 << 53)
            tries.append(F.struct((F.lit(float(w)) / -F.log(u)).alias("score"), F.lit(s).alias("shard")))
    return F.array_max(F.array(*tries))["shard"]


def shard(df: DataFrame, key: str, text: str, n_shards: int, buckets: int = 64, weights: list[float] | None = None, grown_weight: float = 1.0) -> DataFrame:
    """Rows (key, size, text_crc32, shard, slot, grown_shard) for every row of df.

    size: UTF-8 bytes of the text plus 16; a null text counts as empty. slot: gapless from 0 in each
    shard. grown_shard: the shard with one shard more. weights: as of rendezvous(), equal if None;
    grown_weight: with weights, that of the one more. Texts are read once and not shuffled; slots come
    from a narrow table. Repeated rows get a slot each; a null key is a key like any other. Other
    columns of df are left out, so their names can't clash.
    """
    ws = Workspace(df.sparkSession, "shard")
    body = F.coalesce(F.col(text), F.lit(""))
    if weights is None:
        before = _most(_scores(F.col(key), range(n_shards)))
        after = _scores(F.col(key), range(n_shards, n_shards + 1))[0]
        now, grown = _shard_of(F.col("_score")), _shard_of(F.greatest("_score", "_next"))
    else:
        before, after = rendezvous(F.col(key), n_shards, weights), rendezvous(F.col(key), n_shards + 1, [*weights, grown_weight])
        now, grown = F.col("_score"), F.col("_next")
    rows = df.select(
        F.col(key).alias("key"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        before.alias("_score"), after.alias("_next"))
    rows = rows.select(
        "key", "size", "text_crc32", now.alias("shard"),
        grown.alias("grown_shard"), partition_bucket(buckets).alias("_bucket"))
    numbered = gapless(ws.write(rows), ["shard"], "_bucket", ["key", "text_crc32", "size"], "slot")
    return numbered.drop("_bucket")
