"""Choosing a list of words none of which can be taken for another: greedy by priority, as a distributed fixed point."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sayplace.operators.phonetics import sound_pairs, syllables
from sayplace.operators.spelling import contained_pairs, families, keystroke_pairs, parts
from sayplace.operators.tables import numbered, written

#: Reasons in the order in which a candidate is tested.
KINDS = ["shared piece", "shared root", "contained", "sound", "spelling"]
PREFIX = 3
#: Words and conflicts that one task decides at a time.
BLOCK = 4_000_000


def band(rank: Column, base: float = 4.0) -> Column:
    """Coarse bands of familiarity: the logarithm of the rank."""
    return F.floor(F.log(rank + 2) / F.log(F.lit(base)) + 1e-12)


def ordered(pool: DataFrame) -> DataFrame:
    """pool, rows (word, rank, isolation, position), without homophones and with `order`: by band, the most isolated first, then rank."""
    kept = pool.filter("isolation > 0")
    return numbered(kept, [band(F.col("rank")), F.desc("isolation"), "rank", "position"], "order").withColumn("order", F.col("order") + 1)


def conflicts(words: DataFrame, vocabulary: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Rows (word, other, kind): why a candidate can't stand beside a chosen one; kind indexes KINDS, the first that applies.

    words: rows (word, phonemes). Every reason joins on a key: pieces, roots, substrings, sounds, deletions.
    """
    keys, near = claims(words, vocabulary), close(words, threshold)
    shared = keys.join(keys.select(F.col("word").alias("other"), "key"), "key").filter("word != other").select("word", "other", "kind")
    return shared.unionByName(near).groupBy("word", "other").agg(F.min("kind").alias("kind"))


def claims(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows (word, key, kind): what a word takes up; words with the same key conflict, for the later one's kind (of KINDS): a piece, else a root."""
    # Each part is a query of its own here and in close(): the plan of all in one takes much of the driver's memory, again after each stage.
    names = words.select("word").distinct()
    pieces = written(parts(names, vocabulary).select("word", F.col("part").alias("key"), F.lit(0).alias("kind")))
    roots = written(families(names, vocabulary).select("word", F.col("member").alias("key"), F.lit(1).alias("kind")))
    return pieces.unionByName(roots).groupBy("word", "key").agg(F.min("kind").alias("kind"))


def close(words: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Rows (word, other, kind) of the conflicts that aren't about keys: contained, sound, spelling."""
    names = words.select("word").distinct()
    both = lambda df: df.unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = {2: both(written(contained_pairs(names))), 3: written(sound_pairs(words, words, threshold).select("a", "b")), 4: both(written(keystroke_pairs(names)))}
    edges = reduce(DataFrame.unionByName, (df.withColumn("kind", F.lit(k)) for k, df in found.items()))
    return edges.filter("a != b").groupBy(F.col("a").alias("word"), F.col("b").alias("other")).agg(F.min("kind").alias("kind"))


def _decided(table: pa.Table) -> pa.Table:
    """Which vertices are taken, one after the other: rows with `other` are conflicts with earlier ones, rows with `key` their keys, all others the vertices."""
    table = table.combine_chunks()
    arc, keyed = table.filter(pc.is_valid(table["other"])), table.filter(pc.is_valid(table["key"]))
    ids = np.sort(table.filter(pc.and_(pc.is_null(table["other"]), pc.is_null(table["key"])))["order"].to_numpy())
    every = np.arange(len(ids) + 1)
    later, earlier = (np.searchsorted(ids, arc[c].to_numpy()) for c in ("order", "other"))
    by = np.argsort(earlier, kind="stable")
    later, begins = later[by], np.searchsorted(earlier[by], every)
    owner, key = np.searchsorted(ids, keyed["order"].to_numpy()), np.unique(keyed["key"].to_numpy(), return_inverse=True)[1]
    by = np.argsort(owner, kind="stable")
    key, starts = key[by], np.searchsorted(owner[by], every)
    blocked, taken, used = np.zeros(len(ids), bool), np.zeros(len(ids), bool), np.zeros(len(key), bool)
    for k in range(len(ids)):
        own = key[starts[k] : starts[k + 1]]
        if not blocked[k] and not used[own].any():
            taken[k] = used[own] = True
            blocked[later[begins[k] : begins[k + 1]]] = True
    return pa.table({"order": ids, "taken": taken})


def first_fit(vertices: DataFrame, edges: DataFrame, claim: str | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Rows (word, order, taken): the set that taking vertices in order makes, each if no taken one is joined to it.

    vertices: rows (word, order), order unique; edges: rows (word, other), in both directions. The first
    vertices in order go to one task with the conflicts among them, about BLOCK rows in all, which takes
    them one after the other; the neighbours of those taken go, and the next block is what is first then.
    So the rounds are as many as blocks and don't depend on how long chains of conflicts are.

    claim: a column of vertices; words with the same one are joined to each other, without a row for each pair.
    keys: rows (word, key), any number for a word; as claim.
    """
    names = written(vertices.select("word", "order"))
    number = names.schema["order"].dataType
    arcs = written(edges.select("word", "other").join(names, "word").join(names.select(F.col("word").alias("other"), F.col("order").alias("other_order")), "other")
                   .filter("other_order < order").select("order", F.col("other_order").alias("other")).distinct())
    held = [keys.join(names, "word").select("order", F.concat(F.lit("k"), "key").alias("key"))] if keys is not None else []
    held += [vertices.filter(F.col(claim).isNotNull()).select("order", F.concat(F.lit("c"), F.col(claim).cast("string")).alias("key"))] if claim else []
    owned = written(reduce(DataFrame.unionByName, held).distinct()) if held else names.select("order", F.lit("").alias("key")).limit(0)
    left, decided = names.select("order"), None
    none = lambda kind: F.lit(None).cast(kind)
    while not left.isEmpty():
        rows = left.select("order", none(number).alias("other"), none("string").alias("key"))
        rows = rows.unionByName(arcs.withColumn("key", none("string"))).unionByName(owned.select("order", none(number).alias("other"), "key"))
        rows = written(rows)
        total, last = rows.count(), None
        if total > BLOCK:
            last = max(rows.approxQuantile("order", [BLOCK / total], 0.001)[0], left.agg(F.min("order")).first()[0])
            rows = rows.filter(F.col("order") <= last)
        now = written(rows.withColumn("_one", F.lit(0)).groupBy("_one").applyInArrow(_decided, f"order {number.simpleString()}, taken boolean"))
        decided = now if decided is None else decided.unionByName(now)
        if last is None:
            break
        taken, after = now.filter("taken").select("order"), F.col("order") > last
        gone = arcs.filter(after).join(taken.withColumnRenamed("order", "other"), "other", "left_semi").select("order")
        used = owned.join(taken, "order", "left_semi").select("key").distinct()
        gone = written(gone.unionByName(owned.filter(after).join(used, "key", "left_semi").select("order")).distinct())
        decided = decided.unionByName(gone.withColumn("taken", F.lit(False)))
        left = written(left.filter(after).join(gone, "order", "left_anti"))
        owned = written(owned.join(left, "order", "left_semi").select("order", "key"))
        arcs = written(arcs.join(left, "order", "left_semi").join(left.withColumnRenamed("order", "other"), "other", "left_semi").select("order", "other"))
    return names.withColumn("taken", F.lit(False)) if decided is None else names.join(decided, "order").select("word", "order", "taken")


def select(candidates: DataFrame, edges: DataFrame, size: int | None = None, prefix: int = PREFIX, keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The chosen words, rows (word, order, round), and the tallies of what was turned away, rows (kind, n).

    candidates: rows (word, order); edges: of conflicts(), or of close() with keys of claims(), of which
    no pairs are made: the same list, by rows in proportion to the words. First come words whose first letters are still
    free, then all others, in order, so a free prefix is a preference and never costs a word. A word is
    tallied each time it is tested, under the first reason, until the list has its size.
    """
    start = F.substring("word", 1, prefix)
    pairs = written(edges.select("word", "other", "kind"))
    keys = written(keys) if keys is not None else None
    one = written(first_fit(candidates.select("word", "order", start.alias("p")), pairs, claim="p", keys=keys))
    first = one.filter("taken").select("word", "order")
    # The second round begins with those of the first already on the list.
    top = candidates.agg(F.max("order")).first()[0] or 0
    shifted = candidates.join(first.select("word"), "word", "left_anti").select("word", (F.col("order") + top).alias("order")).unionByName(first)
    two = written(first_fit(shifted, pairs.select("word", "other"), keys=keys).withColumn("round", F.when(F.col("order") <= top, 1).otherwise(2)))
    chosen = two.filter("taken").select("word", "order", "round")
    if size is not None:
        chosen = chosen.orderBy("order").limit(size)
    chosen = written(chosen)
    full = size is not None and chosen.count() >= size
    last = (chosen.agg(F.max("order")).first()[0] or 0) if full else 2 * top + 1
    by = chosen.select(F.col("word").alias("other"), F.col("order").alias("other_order"))
    tests = one.filter("not taken").select("word", "order", F.lit(1).alias("round")).unionByName(two.filter("not taken").select("word", "order", F.lit(2).alias("round")))
    met = tests.filter(F.col("order") <= last).join(pairs, "word").join(by, "other").filter("other_order < order")
    met = met.select("word", "round", "kind")
    if keys is not None:
        taken = keys.join(by.withColumnRenamed("other", "word"), "word").groupBy("key").agg(F.min("other_order").alias("other_order"))
        met = met.unionByName(tests.filter(F.col("order") <= last).join(keys, "word").join(taken, "key").filter("other_order < order").select("word", "round", "kind"))
    reasons = met.groupBy("word", "round").agg(F.min("kind").alias("kind"))
    # In the first round a word whose prefix is taken isn't tested at all.
    claimed = by.groupBy(F.substring("other", 1, prefix).alias("p")).agg(F.min("other_order").alias("other_order"))
    skipped = one.select("word", "order", start.alias("p")).join(claimed, "p").filter("other_order < order").select("word", F.lit(1).alias("round"))
    tallies = reasons.join(skipped, ["word", "round"], "left_anti").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    named = F.element_at(F.array(*(F.lit(k) for k in KINDS)), F.col("kind") + 1)
    return chosen.withColumn("order", F.when(F.col("round") == 2, F.col("order") - top).otherwise(F.col("order"))), tallies.select(named.alias("kind"), "n")


def select_kinds(candidates: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("a", "n", "v"), prefix: int = PREFIX) -> DataFrame:
    """Rows (kind, word, order, round): a list of its own for each kind; only words of a kind stand in each other's way.

    candidates: rows (word, order, kind); edges: of conflicts() among all of them.
    """
    lists = []
    for kind in kinds:
        own = written(candidates.filter(F.col("kind") == kind).select("word", "order"))
        names = own.select("word")
        among = edges.join(names, "word", "left_semi").join(names.withColumnRenamed("word", "other"), "other", "left_semi")
        chosen, _ = select(own, among, prefix=prefix)
        lists.append(chosen.select(F.lit(kind).alias("kind"), "word", "order", "round"))
    return reduce(DataFrame.unionByName, lists)


def distinct_sounds(pool: DataFrame, threshold: float, size: int | None = None) -> DataFrame:
    """Rows (word, order): words in order, each if none taken before sounds like it; the first of these if a size is wanted.

    pool: rows (word, phonemes, order), order unique.
    """
    rows = written(pool.select("word", "phonemes", "order"))
    near = sound_pairs(rows, rows, threshold).select(F.col("a").alias("word"), F.col("b").alias("other"))
    taken = first_fit(rows.select("word", "order"), near).filter("taken").select("word", "order")
    return taken if size is None else taken.orderBy("order").limit(size)


def histograms(words: DataFrame) -> DataFrame:
    """Rows (what, value, n) of a list (word, phonemes, isolation): its words by isolation and by syllables."""
    both = words.select(F.explode(F.array(
        F.struct(F.lit("isolation").alias("what"), F.col("isolation").cast("double").alias("value")),
        F.struct(F.lit("syllables").alias("what"), syllables(F.col("phonemes")).cast("double").alias("value")))).alias("h"))
    return both.groupBy("h.what", "h.value").agg(F.count(F.lit(1)).alias("n"))


def statistics(words: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """One row about a list (word): its size, prefixes that only one word has, lengths, and the SHA-256 of its sorted lines."""
    unique = words.groupBy(F.substring("word", 1, prefix).alias("p")).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") == 1).alias("unique_prefixes"))
    rows = words.agg(
        F.count(F.lit(1)).alias("n_words"), F.min(F.length("word")).alias("shortest"), F.max(F.length("word")).alias("longest"), F.round(F.avg(F.length("word")), 6).alias("mean_length"),
        F.sha2(F.concat(F.array_join(F.array_sort(F.collect_list("word")), "\n"), F.lit("\n")), 256).alias("sha256"))
    return rows.crossJoin(unique)


def part_of_speech(counts: DataFrame, overrides: DataFrame, share: float = 0.5) -> DataFrame:
    """Rows (word, kind): an override's kind ('-': none), else the kind most of a word's tagged senses have, if it is a, n or v and has that share.

    counts: rows (word, kind, n); ties go to n, v, a, r in turn.
    """
    rank = F.array_position(F.array(*(F.lit(k) for k in "nvar")), F.col("kind"))
    best = counts.groupBy("word").agg(F.max_by("kind", F.struct("n", -rank)).alias("kind"), F.max("n").alias("n"), F.sum("n").alias("total"))
    clear = best.filter(F.col("kind").isin("a", "n", "v") & (F.col("n") >= share * F.col("total"))).select("word", "kind")
    own = overrides.select("word", F.col("kind").alias("own"))
    rows = clear.join(own, "word", "full").select("word", F.coalesce(F.nullif("own", F.lit("-")), F.when(F.col("own").isNull(), F.col("kind"))).alias("kind"))
    return rows.filter("kind is not null")
