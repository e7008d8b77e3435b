"""Near-duplicates by bottom-k sketches: inverted lists of retained values, union-sketch estimates, exact Jaccard."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sayplace.llm.common import Workspace, admits, bound_batches, components, hot_join, key_filter, released

#: Values a sketch retains, and standard deviations of doubt that estimates allow for: a pair at the
#: threshold is missed with a chance of about one in ten million. Sets of no more values are kept whole,
#: so for them lists and estimates are exact.
SKETCH, DOUBT = 128, 5.5
#: Counters for the common order of values; a fixed number, so the broadcast has a fixed size (1 MB).
#: Any order that all sets share gives right results; a true one gives fewer candidates.
COUNTERS, COUNTER_SHIFT = 1 << 18, 30
#: Leaders each list compares all its members with; and shingles of the sets that one task compares at a time.
LEADERS, BLOCK = 4, 500_000
SALTS = 16
NULL_ID = -(1 << 63)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        v = self[word] = xxhash.xxh64_intdigest(word)
        return v


_HASHES = _WordHashes()
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of so many words; of the whole sequence where it is shorter.

    Words: [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, which is how bytes.split() cuts UTF-8.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_HASHES) > 50_000:
        _HASHES.clear()
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(size, len(h))
    out = h[: len(h) - width + 1].copy()
    for k in range(1, width):
        out *= _ODD
        out += h[k : len(h) - width + 1 + k]
    # One hash function for all values: a bijective finish of the polynomial, so low values are as good as random.
    out += np.uint64(width)
    out ^= out >> np.uint64(30)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def shared_at_least(n: int, m: int, threshold: float, k: int = SKETCH) -> int:
    """So many values are in the sketches of two sets of these sizes that have the threshold, but for the chance that DOUBT allows.

    Their union has (n + m) / (1 + threshold) elements. Its k smallest are drawn without putting back, and
    those that are common lie in both sketches; a union of no more than k is drawn whole.
    """
    union = (n + m) / (1 + threshold)
    if union <= k:
        return math.ceil(threshold * union - 1e-9)
    spread = math.sqrt(threshold * (1 - threshold) * k * (union - k) / (union - 1))
    return max(1, math.floor(threshold * k - DOUBT * spread))


def prefix_length(n: int, threshold: float, k: int = SKETCH) -> int:
    """Of a sketch in any order that all sets share, the first so many hold a value of every similar set's first ones."""
    least = min(shared_at_least(n, math.ceil(threshold * n - 1e-9), threshold, k), shared_at_least(n, math.floor(n / threshold + 1e-9), threshold, k))
    return min(n, k) - least + 1


def union_estimate(a: np.ndarray, b: np.ndarray, k: int = SKETCH) -> float:
    """The share of the union's k smallest values that lie in both sets, from sorted sets or their sketches."""
    x, y = a[:k], b[:k]
    both = np.concatenate((x, y))
    both.sort()
    twice = both[1:][both[1:] == both[:-1]]
    union = np.unique(both)[:k]
    return float(np.searchsorted(twice, union[-1], "right")) / len(union)


def whole_percent(threshold: float) -> int:
    """The threshold in hundredths, by which sets are compared in whole numbers."""
    percent = round(threshold * 100)
    if abs(threshold * 100 - percent) > 1e-9 or not 0 < percent <= 100:
        raise ValueError("a threshold of whole hundredths")
    return percent


def likely(a: np.ndarray, b: np.ndarray, n: int, m: int, threshold: float) -> bool:
    """Whether two sets of n and m elements may have the threshold, from their sketches: by their sizes, then by the union's estimate."""
    if 100 * min(n, m) < whole_percent(threshold) * max(n, m):
        return False
    return union_estimate(a, b) >= shared_at_least(n, m, threshold) / min(SKETCH, (n + m) / (1 + threshold)) - 1e-9


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """The exact Jaccard similarity of whole sets, in integers: inter / union >= threshold."""
    inter = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * inter >= whole_percent(threshold) * (len(a) + len(b) - inter)


_LONGS = pa.list_(pa.int64())


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    values = np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _unlists(column: pa.ListArray) -> list[np.ndarray]:
    values, offsets = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, size) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), _lists([s[:SKETCH] for s in sets])],
                names=["id", "n", "digest", "sketch"])

    return run


def _bucket(values: np.ndarray) -> np.ndarray:
    """The counter of each value: bits that the filter of values doesn't use."""
    return (values >> np.uint64(COUNTER_SHIFT) & np.uint64(COUNTERS - 1)).astype(np.int64)


def _entries(threshold: float, order, shared):
    """(value, id, n, own) of each sketch's prefix in the common order: values of one set first, then by their counter; the former need no list.

    own: the share of values that no other set has, small for sets in the middle of their like.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, bitmap = order.value, shared.value
        for batch in batches:
            ids, ns, owns, values = [], [], [], []
            for i, n, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _unlists(batch.column(2))):
                several = s[admits(bitmap, s.view(np.int64))]
                room = prefix_length(n, threshold) - (len(s) - len(several))
                if room <= 0 or not len(several):
                    continue
                first = several[np.lexsort((several, counts[_bucket(several)]))][:room]
                values.append(first)
                ids += [i] * len(first)
                ns += [n] * len(first)
                owns += [(len(s) - len(several)) / len(s)] * len(first)
            flat = np.concatenate(values).view(np.int64) if values else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(owns, pa.float64())], names=["value", "id", "n", "own"])

    return run


def _sets(size: int, wanted):
    """Whole sets of the documents that the filter admits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(admits(wanted.value, batch.column(2).to_numpy())))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingle_set(t, size) for t in batch.column(1).to_pylist()])], names=["id", "shingles"])

    return run


def _admitted(wanted):
    """Rows whose hash, the last column, the filter admits, without it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            yield batch.filter(pa.array(admits(wanted.value, batch.column(last).to_numpy()))).select(list(range(last)))

    return run


def _doubted(others):
    """Whether the filter of those that aren't representatives admits a row. In one worker a task: each takes memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(admits(others.value, batch.column(3).to_numpy()))], names=["id", "n", "sketch", "doubtful"])

    return run


def _estimated(threshold: float):
    """Pairs whose sketches say that they may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = zip(_unlists(batch.column("sa")), _unlists(batch.column("sb")), batch.column("na").to_pylist(), batch.column("nb").to_pylist())
            yes = pa.array([likely(a, b, n, m, threshold) for a, b, n, m in sketches], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(yes), batch.column("b").filter(yes)], names=["a", "b"])

    return run


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = [similar(a, b, threshold) for a, b in zip(_unlists(batch.column("sa")), _unlists(batch.column("sb")))]
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(yes, pa.bool_())), batch.column("b").filter(pa.array(yes, pa.bool_()))], names=["a", "b"])

    return run


def _compared(threshold: float):
    """Links between a block's queries and its other sets, by an inverted index of the queries' values."""
    percent = whole_percent(threshold)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, roots = table["id"].to_numpy(), table["root"].to_numpy()
        asks = table["query"].to_numpy(zero_copy_only=False)
        column = table["shingles"].chunk(0) if table["shingles"].num_chunks else pa.array([], _LONGS)
        sets = _unlists(column)
        queries = np.flatnonzero(asks)
        sizes = np.array([len(sets[q]) for q in queries], np.int64)
        values = np.concatenate([sets[q] for q in queries])
        owner = np.repeat(np.arange(len(queries)), sizes)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        a, b = [], []
        for k in np.flatnonzero(~asks):
            mine = sets[k]
            low, high = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
            met = high > low
            if not met.any():
                continue
            low, runs = low[met], (high - low)[met]
            at = np.repeat(low - np.concatenate(([0], np.cumsum(runs)[:-1])), runs) + np.arange(runs.sum())
            inter = np.bincount(owner[at], minlength=len(queries))
            like = (100 * inter >= percent * (sizes + len(mine) - inter)) & (roots[queries] != roots[k])
            for q in queries[like]:
                a.append(min(ids[q], ids[k]))
                b.append(max(ids[q], ids[k]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _rest(ws: Workspace, placed: DataFrame, sets_of, threshold: float) -> DataFrame:
    """Links that the leaders left, exactly: members outside their list's largest part against all members of their lists.

    The outsiders are dealt into blocks of so many shingles, those of a list together, since what they
    are to be compared with is much the same. A block meets each set once, however many lists they
    share, in parts of bounded size. No pair of sets is made into a row unless it is a link.
    """
    by_root = placed.groupBy("value", "root").agg(F.count(F.lit(1)).alias("m"))
    lists = by_root.groupBy("value").agg(F.max(F.struct("m", "root")).alias("w"), F.sum("m").alias("m"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    part = ws.write(placed.join(lists.select("value", F.col("w.root").alias("main"), "m"), "value").select("value", "id", "n", "root", "main", "m"))
    outside = part.filter("root != main")
    homes = outside.groupBy("id").agg(F.max(F.struct("m", "value"))["value"].alias("home"), F.max("n").alias("n"), F.max("root").alias("root"))
    weight = homes.groupBy("home").agg(F.sum("n").alias("hn"))
    total = weight.filter(F.col("hn") <= BLOCK).agg(F.sum("hn")).first()[0] or 0
    small = F.pmod(F.xxhash64("home"), F.lit(max(1, -(-total // BLOCK))))
    large = F.pmod(F.xxhash64("id"), F.ceil(F.col("hn") / BLOCK))
    block = F.when(F.col("hn") > BLOCK, F.xxhash64("home", large)).otherwise(F.xxhash64(F.lit(-1), small))
    blocks = ws.write(homes.join(weight, "home").select("id", "n", "root", block.alias("block")))
    wanted = outside.select("id", "value").join(blocks.select("id", "block"), "id").select("block", "value").distinct()
    met = ws.write(wanted.join(part.select("value", "id", "n", "root"), "value").groupBy("block", "id").agg(F.max("n").alias("n"), F.max("root").alias("root")))
    split = met.groupBy("block").agg(F.ceil(F.sum("n") / (4 * BLOCK)).alias("splits"))
    split = ws.write(split)
    asked = met.join(split, "block").select("block", F.pmod(F.xxhash64("id"), F.col("splits")).alias("split"), "id", "root", F.lit(False).alias("query"))
    asking = blocks.join(split, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1)).alias("split"), "id", "root", F.lit(True).alias("query"))
    rows = asked.unionByName(asking)
    rows = rows.join(sets_of(rows), "id")
    return ws.write(rows.groupBy("block", "split").applyInArrow(_compared(threshold), "a long, b long").distinct())


def _links(ws: Workspace, source: DataFrame, reps: DataFrame, size: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verified links (a, b) between representatives of equal sets, enough of them to connect all that are similar: those with leaders, all others, and the components of the former."""
    spark = reps.sparkSession
    percent = whole_percent(threshold)
    several = reps.select(F.explode("sketch").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    several = ws.write(several)
    bucket = F.shiftrightunsigned("value", COUNTER_SHIFT).bitwiseAND(F.lit(COUNTERS - 1))
    table = several.groupBy(bucket.alias("bucket")).agg(F.max("m").alias("m")).toArrow()
    counts = np.zeros(COUNTERS, np.int32)
    counts[table["bucket"].to_numpy()] = np.minimum(table["m"].to_numpy(), np.iinfo(np.int32).max)
    order, shared = spark.sparkContext.broadcast(counts), key_filter(several, "value", hashed=True)
    listed = ws.write(reps.select("id", "n", "sketch").mapInArrow(released(_entries(threshold, order, shared)), "value long, id long, n long, own double"))
    # Leaders of each list of several sets: those in the middle of their like, which most others are similar to.
    few = F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")
    tops = listed.groupBy("value", few).agg(F.min(F.struct("own", "id", "n")).alias("l"), F.count(F.lit(1)).alias("m")).groupBy("value").agg(
        F.slice(F.sort_array(F.collect_list("l")), 1, LEADERS).alias("leaders"), F.sum("m").alias("m")).filter("m > 1")
    lists = ws.write(tops.select("value", "m", F.transform("leaders", lambda l: F.struct(l["id"].alias("leader"), l["n"].alias("nl"))).alias("leaders")))
    entries = ws.write(hot_join(listed.select("value", "id", "n"), lists.select("value", "leaders"), "value", lists, "m", listed.count()))
    ws.drop(listed, several)
    met = entries.select("id", "n", F.explode("leaders").alias("l")).select("id", "n", "l.leader", "l.nl").filter("id != leader").filter(f"100 * least(n, nl) >= {percent} * greatest(n, nl)")
    # A pair's overlap: how many retained values list both.
    overlaps = met.groupBy(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).agg(F.count(F.lit(1)).alias("overlap"))
    pairs = ws.write(overlaps.select("a", "b", "overlap"))
    # The union of sketches is estimated first; whole sets are made for what is left, and for what _rest compares.
    paired = ws.write(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sketches = reps.select("id", "n", "sketch", F.xxhash64("id").alias("h")).mapInArrow(_admitted(key_filter(paired, "id")), "id long, n long, sketch array<long>")

    def with_ends(pairs: DataFrame, table: DataFrame, **columns: str) -> DataFrame:
        """Pairs with columns of the table for either end."""
        many = pairs.count()
        out = pairs
        for end in "ab":
            own = table.select(F.col("id").alias(end), *(F.col(c).alias(f"{name}{end}") for name, c in columns.items()))
            out = hot_join(out, own, end, pairs.groupBy(end).agg(F.count(F.lit(1)).alias("k")), "k", many)
        return out.select("a", "b", *(f"{name}{end}" for name in columns for end in "ab"))

    rows = with_ends(pairs.select("a", "b"), sketches, n="n", s="sketch")
    likely_pairs = ws.write(rows.mapInArrow(released(_estimated(threshold)), "a long, b long").distinct())

    def sets_of(needed: DataFrame) -> DataFrame:
        """Rows (id, shingles): whole sets, those of these ids among them; an id that repeats has several."""
        needed = ws.write(needed.select("id").distinct())
        made = source.select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(released(_sets(size, key_filter(needed, "id"))), "id long, shingles array<long>")
        return ws.write(made)

    sets = sets_of(likely_pairs.select(F.explode(F.array("a", "b")).alias("id")))
    rows = with_ends(likely_pairs, sets, s="shingles")
    found = ws.write(rows.mapInArrow(released(_verified(threshold)), "a long, b long").distinct())
    roots = components(ws, found)
    placed = ws.write(entries.join(roots.withColumnRenamed("node", "id"), "id", "left").select("value", "id", "n", F.coalesce("root", "id").alias("root")))
    return found, _rest(ws, placed, sets_of, threshold), roots


def near_dedup(df: DataFrame, key: str, text: str, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """Rows (id, n_shingles, component_id, kept), one for every row of df.

    Words are cut at ASCII white space after lower-casing A-Z; a document's set holds its distinct runs of
    `size` words, or its whole sequence where it is shorter. Documents whose sets have a Jaccard similarity
    of the threshold or more are linked; component_id is the smallest id reachable and kept marks it.
    Documents without words (null, empty, white space) link with nothing. A null id counts as the smallest
    and comes back as null. Repeated rows give repeated rows; other columns are left out. An empty table
    gives an empty result. Sets are of 64-bit hashes.

    1. One scan writes each document's set size, set digest and sketch (the k smallest hashes). Equal sets
       become one representative, merged by salted aggregation, so copies never meet pair by pair.
    2. Inverted lists of retained values: all sketches are put in one order, rare values first (values of
       one set, by a bitmap, then by a table of counts; both of fixed size, from counts over all sketches),
       and only a prefix is listed, which loses no pair of the threshold but for the chance given by
       DOUBT. Values of one set need no list, so a document that shares little has no entries at all.
    3. Each list pairs its members with a few leaders; a pair's overlap is the number of lists that have
       both. The union of the two sketches estimates the similarity first, and whole sets are made and
       compared only for pairs that it leaves; links join components. Members that are still outside their list's largest component
       are compared with all of the list, in blocks, by whole sets. So a group of near copies costs a few
       comparisons a member, and nothing is capped.
    """
    spark = df.sparkSession
    bound_batches(spark)
    ws = Workspace(spark, "near-dedup")
    source = df.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text).alias("text"))
    sketched = ws.write(source.mapInArrow(released(_sketches(size)), "id long, n long, digest binary, sketch array<long>"))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")
    classes = sketched.filter("n > 0").select("digest", "id", salt).groupBy("digest", "salt").agg(F.min("id").alias("id")).groupBy("digest").agg(
        F.min("id").alias("cid"), F.collect_set("salt").alias("salts"))
    classes = ws.write(classes)
    spread = classes.select("digest", "cid", F.explode("salts").alias("salt"))
    members = ws.write(sketched.select("id", "n", "digest", salt).join(spread, ["digest", "salt"], "left").select("id", "n", F.coalesce("cid", "id").alias("cid")))
    # Sketches of representatives; a filter of the others' ids spares most of them the shuffle.
    others = key_filter(members.filter("id != cid"), "id")
    rows = sketched.filter("n > 0").select("id", "n", "sketch", F.xxhash64("id").alias("h")).mapInArrow(_doubted(others), "id long, n long, sketch array<long>, doubtful boolean")
    doubtful = rows.filter("doubtful").join(classes.select(F.col("cid").alias("id")).distinct(), "id", "left_semi")
    reps = ws.write(rows.filter("not doubtful").unionByName(doubtful).drop("doubtful"))
    ws.drop(sketched)
    links, rest, roots = _links(ws, source, reps, size, threshold)
    # An id that repeats with other texts is in several classes, which it joins.
    several = members.filter("n > 0").groupBy("id").agg(F.min("cid").alias("first"), F.max("cid").alias("last")).filter("first != last")
    again = members.filter("n > 0").join(several, "id").filter("cid != first").select(F.col("cid").alias("a"), F.col("first").alias("b"))
    more = ws.write(rest.unionByName(again))
    if not more.isEmpty():
        roots = components(ws, links.unionByName(more))
    # A class of a third of all rows: its one root is copied to each salt.
    salted = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    to = roots.select(F.col("node").alias("cid"), "root", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = salted.join(to, ["cid", "salt"], "left")
    root = F.when(F.col("n") > 0, F.coalesce("root", "cid")).otherwise(F.col("id"))
    rows = rows.select("id", F.col("n").alias("n_shingles"), root.alias("component_id"))
    null = lambda c: F.nullif(F.col(c), F.lit(NULL_ID))
    return rows.select(null("id").alias("id"), "n_shingles", null("component_id").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))
