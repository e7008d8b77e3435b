"""Spoken and written addresses as text: parsing into words and an optional number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The words of numbers.
UNITS = {"zero": 0, "oh": 0, "nought": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9}
TEENS = {"ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19}
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def parse_words(text: Column) -> Column:
    """A struct (words, status): words between points, commas and plain spaces, in lower case; status empty where there are none."""
    parts = F.filter(F.split(F.translate(F.lower(stripped(text)), ", ", ".."), r"\."), lambda w: w != "")
    return F.when(text.isNotNull(), F.struct(F.when(F.size(parts) > 0, parts).alias("words"), F.when(F.size(parts) > 0, "ok").otherwise("empty").alias("status")))


def _value(word: Column, table: dict[str, int]) -> Column:
    """From a literal map, folded once; a chain of conditions would make the generated code too long."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), word)


def with_spoken_number(df: DataFrame, tokens: str, out: str) -> DataFrame:
    """out: a number from 00 to 99 that an array of tokens says, null if they don't: '42', '4 2', 'forty two', 'four two', 'oh seven'.

    Each step is a projection of its own, so that what is used often is worked out once.
    """
    t = F.col(tokens)
    df = df.withColumns({
        "_joined": F.array_join(t, ""), "_written": F.forall(t, lambda x: x.rlike("^[0-9]+$")), "_a": F.get(t, F.lit(0)), "_b": F.get(t, F.lit(1))})
    df = df.withColumns({
        "_unit_a": _value(F.col("_a"), UNITS), "_unit_b": _value(F.col("_b"), UNITS), "_teen": _value(F.col("_a"), TEENS), "_ten": _value(F.col("_a"), TENS)})
    one = F.coalesce("_unit_a", "_teen", "_ten")
    two = F.when(F.col("_ten").isNotNull() & (F.col("_unit_b") > 0), F.col("_ten") + F.col("_unit_b")).otherwise(F.col("_unit_a") * 10 + F.col("_unit_b"))
    number = (
        F.when(F.size(t) == 0, F.lit(None).cast("int")).when(F.col("_written"), F.when(F.length("_joined") <= 2, F.col("_joined").try_cast("int")))
        .when(F.size(t) == 1, one).when(F.size(t) == 2, two))
    return df.withColumn(out, number).drop("_joined", "_written", "_a", "_b", "_unit_a", "_unit_b", "_teen", "_ten")


def parse_full(df: DataFrame, said: str, words: str = "words", number: str = "number", status: str = "status") -> DataFrame:
    """words, and the number that the longest run of number words and digits at the end says, with a status.

    status: ok, empty (no tokens), no_words (only a number) or bad_number (a run that isn't 00 to 99); null
    text has a null status. Words and number are null where it isn't ok.
    """
    known = [*UNITS, *TEENS, *TENS]
    df = df.withColumn("_tokens", F.filter(F.split(F.lower(stripped(F.col(said))), r"(?U)[\s.,;:/-]+"), lambda t: t != ""))
    # The last token that isn't a number's ends the words.
    marks = F.transform("_tokens", lambda t, k: F.when(t.isin(*known) | t.rlike("^[0-9]+$"), F.lit(0)).otherwise(k + 1))
    df = df.withColumn("_end", F.coalesce(F.array_max(marks), F.lit(0)))
    df = df.withColumn("_run", F.slice("_tokens", F.col("_end") + 1, F.greatest(F.size("_tokens") - F.col("_end"), F.lit(0))))
    df = with_spoken_number(df, "_run", "_number")
    why = (
        F.when(F.col(said).isNull(), F.lit(None).cast("string")).when(F.size("_tokens") == 0, "empty").when(F.col("_end") == 0, "no_words")
        .when((F.size("_run") > 0) & F.col("_number").isNull(), "bad_number").otherwise("ok"))
    df = df.withColumn("_why", why)
    good = F.col("_why") == "ok"
    df = df.withColumns({"_words": F.when(good, F.slice("_tokens", F.lit(1), F.col("_end"))), "_number": F.when(good, F.col("_number"))})
    kept = [c for c in df.columns if not c.startswith("_") and c not in (words, number, status)]
    return df.select(*kept, F.col("_words").alias(words), F.col("_number").alias(number), F.col("_why").alias(status))
