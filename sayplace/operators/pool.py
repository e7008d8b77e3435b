"""Ordered reject chains: each candidate word has the first reason that applies, or none and so is in the pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sayplace.operators.phonetics import phonemes, syllables
from sayplace.operators.spelling import inflections, with_variants

#: Levels from easiest to hardest, and the rank up to which a word of so many letters may be.
LEVELS = ["A1", "A2", "B1", "B2", "C1", "C2"]
LENGTH_BUDGET = {4: 55000, 5: 55000, 6: 45000, 7: 38000, 8: 28000, 9: 19000}
FREQUENCY_RANK = 55000


def affordable(word: Column, rank: Column, budget: dict[int, int] = LENGTH_BUDGET) -> Column:
    """Whether a word of its length may be so rare: longer words must be commoner."""
    limit = F.lit(0)
    for n, most in budget.items():
        limit = F.when(F.length(word) == n, most).otherwise(limit)
    return rank <= limit


def flagged(df: DataFrame, words: DataFrame, out: str) -> DataFrame:
    """df with whether its word is among the words: a left join, so one pass keeps all flags."""
    key = f"_{out}"
    return df.join(words.select(F.col("word").alias(key)).distinct(), F.col("word") == F.col(key), "left").withColumn(out, F.col(key).isNotNull()).drop(key)


def spoken(pronunciations: DataFrame) -> DataFrame:
    """Rows (word, phonemes, ways): the first pronunciation without stress, and how many there are that differ without it."""
    rows = pronunciations.select("word", "position", phonemes(F.col("pronunciation")).alias("phonemes"))
    return rows.groupBy("word").agg(F.min_by("phonemes", "position").alias("phonemes"), F.countDistinct("phonemes").alias("ways"))


def first_reason(tests: list[tuple[str, Column]]) -> Column:
    out = F.lit(None).cast("string")
    for why, applies in reversed(tests):
        out = F.when(applies, why).otherwise(out)
    return out


def graded_pool(graded: DataFrame, pronunciations: DataFrame, offensive: DataFrame, dictionary: DataFrame, other_dictionary: DataFrame, places: DataFrame, excluded: DataFrame, meanings: DataFrame, allowed: DataFrame,
                levels: tuple[str, ...] = tuple(LEVELS), letters: tuple[int, int] = (3, 10), beats: tuple[int, int] = (1, 3)) -> DataFrame:
    """graded, rows (word, level), with phonemes and the reason a word is turned away, null in the pool.

    dictionary, other_dictionary: rows (word, proper); meanings: rows (word, category); the rest rows (word).
    """
    names = graded.select("word")
    common = dictionary.filter("not proper")
    everything = common.select("word").unionByName(other_dictionary.filter("not proper").select("word"))
    df = graded.join(spoken(pronunciations), "word", "left")
    for out, table in [
        ("offensive", offensive), ("proper", dictionary.filter("proper")), ("place", places), ("common", common), ("excluded", excluded), ("meaning", meanings), ("allowed", allowed),
        ("variant", with_variants(names, everything)), ("inflected", inflections(names, pronunciations.select("word")))]:
        df = flagged(df, table, out)
    w, n = F.col("word"), F.length("word")
    has_common = not common.isEmpty()
    reason = first_reason([
        ("level", ~F.col("level").isin(*levels)), ("letters", ~w.rlike("^[a-z]+$")), ("length", ~n.between(*letters)), ("unspoken", F.col("phonemes").isNull()), ("two_ways", F.col("ways") > 1),
        ("syllables", ~syllables(F.col("phonemes")).between(*beats)), ("offensive", F.col("offensive")), ("proper", F.col("proper")), ("place", F.col("place")), ("uncommon", F.lit(has_common) & ~F.col("common")),
        ("variant", F.col("variant")), ("inflected", F.col("inflected")), ("excluded", F.col("excluded")), ("meaning", F.col("meaning") & ~F.col("allowed"))])
    return df.select("word", "level", "phonemes", reason.alias("reason"))


def frequency_pool(pronunciations: DataFrame, ranked: DataFrame, offensive: DataFrame, names: DataFrame, places: DataFrame, dictionary: DataFrame, other_dictionary: DataFrame, excluded: DataFrame, meanings: DataFrame, allowed: DataFrame, bonus: DataFrame | None = None,
                   letters: tuple[int, int] = (4, 9), beats: tuple[int, int] = (1, 3), rarest: int = FREQUENCY_RANK) -> DataFrame:
    """Rows (word, rank, phonemes, reason) of every pronounced word; ranked: rows (word, rank, n). bonus: words that count as the rarest allowed if unranked."""
    ranks = ranked.select("word", "rank")
    if bonus is not None:
        ranks = ranks.unionByName(bonus.select("word").distinct().join(ranks, "word", "left_anti").withColumn("rank", F.lit(rarest)))
    df = spoken(pronunciations).join(ranks, "word", "left")
    all_words = df.select("word")
    common = dictionary.filter("not proper")
    both = common.select("word").unionByName(other_dictionary.filter("not proper").select("word")).unionByName(pronunciations.select("word"))
    for out, table in [
        ("offensive", offensive), ("name", names), ("place", places), ("common", common), ("proper", dictionary.filter("proper")), ("excluded", excluded), ("meaning", meanings), ("allowed", allowed),
        ("inflected", inflections(all_words, all_words, ranked.select("word", "n"))), ("variant", with_variants(all_words, both))]:
        df = flagged(df, table, out)
    w, n = F.col("word"), F.length("word")
    has_common = not common.isEmpty()
    reason = first_reason([
        ("letters", ~w.rlike("^[a-z]+$")), ("length", ~n.between(*letters)), ("two_ways", F.col("ways") > 1), ("syllables", ~syllables(F.col("phonemes")).between(*beats)),
        ("rare", F.col("rank").isNull() | (F.col("rank") > rarest)), ("long_for_rank", ~affordable(w, F.col("rank"))), ("offensive", F.col("offensive")), ("name", F.col("name")), ("place", F.col("place")),
        ("uncommon", F.lit(has_common) & ~F.col("common")), ("proper", F.col("proper")), ("excluded", F.col("excluded")), ("meaning", F.col("meaning") & ~F.col("allowed")), ("inflected", F.col("inflected")), ("variant", F.col("variant"))])
    return df.select("word", "rank", "phonemes", reason.alias("reason"))


def of_levels(pool: DataFrame, graded: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """The rows of a pool (word, reason, ...) with the reason 'not_graded' where there is none yet and no wanted level has the word; graded: rows (word, level)."""
    wanted = graded.filter(F.upper("level").isin(*(x.upper() for x in levels))).select("word")
    df = flagged(pool, wanted, "_graded")
    return df.withColumn("reason", F.coalesce("reason", F.when(~F.col("_graded"), F.lit("not_graded")))).drop("_graded")


def tallies(pool: DataFrame) -> DataFrame:
    """Rows (reason, n): how many words each reason turned away."""
    return pool.filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def reference_words(pronunciations: DataFrame, frequency: DataFrame, size: int = 30_000) -> DataFrame:
    """Rows (word, phonemes): the commonest words that have a pronunciation."""
    return spoken(pronunciations).join(frequency, "word").orderBy(F.desc("n"), "position").limit(size).select("word", "phonemes")
