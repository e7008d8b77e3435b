"""Readers of pronunciations, frequencies, word files, cased dictionaries, name tables and sense databases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sayplace.operators.tables import numbered


def lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Rows (position, line): a file's lines with their order. Positions grow along the file; they aren't gapless."""
    if encoding == "UTF-8":
        rows = spark.read.text(path)
    else:
        rows = spark.read.schema("value string").csv(path, encoding=encoding, sep="\x01", quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return rows.select(F.monotonically_increasing_id().alias("position"), F.col("value").alias("line"))


def pronunciations(spark: SparkSession, path: str) -> DataFrame:
    """Rows (word, pronunciation, position) of a pronouncing dictionary: comments (;;;) are skipped, WORD(2) is an alternate of WORD."""
    rows = lines(spark, path).filter(~F.col("line").startswith(";;;")).select("position", F.filter(F.split("line", r"\s+"), lambda t: t != "").alias("t")).filter(F.size("t") >= 2)
    word = F.regexp_replace(F.lower(F.get("t", F.lit(0))), r"\([^(]*\)$", "")
    return rows.select(word.alias("word"), F.array_join(F.slice("t", F.lit(2), F.size("t")), " ").alias("pronunciation"), "position")


def frequencies(spark: SparkSession, path: str) -> DataFrame:
    """Rows (word, n, position) of lines of a word and a count; other lines are skipped, the last of a word counts, at its first place."""
    rows = lines(spark, path).select("position", F.filter(F.split("line", r"\s+"), lambda t: t != "").alias("t")).filter(F.size("t") == 2)
    counts = rows.select("position", F.get("t", F.lit(0)).alias("word"), F.get("t", F.lit(1)).cast("long").alias("n"))
    return counts.groupBy("word").agg(F.max_by("n", "position").alias("n"), F.min("position").alias("position"))


def ranked(frequency: DataFrame) -> DataFrame:
    """frequency with `rank`, 0 for the commonest; ties in the file's order."""
    return numbered(frequency, [F.desc("n"), "position"], "rank")


def words(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows (word) of word files: # begins a comment, words between white space, lower case, each once."""
    rows = spark.read.text(list(paths)).select(F.explode(F.split(F.lower(F.regexp_replace("value", "#.*$", "")), r"\s+")).alias("word"))
    return rows.filter("word != ''").distinct()


def cased_dictionary(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows (word, proper): ASCII words of a dictionary with capitals intact; a word may be both."""
    w = F.trim("value")
    rows = spark.read.text(list(paths)).filter(w.rlike("^[A-Za-z]+$"))
    return rows.select(F.lower(w).alias("word"), w.rlike("^[A-Z]").alias("proper")).distinct()


def places(cities: DataFrame, others: DataFrame, population: int = 200_000) -> DataFrame:
    """Rows (word): names in letters alone of cities (name, population) of that size and of other places (name)."""
    names = cities.filter(F.col("population") >= population).select("name").unionByName(others.select("name"))
    return names.select(F.lower("name").alias("word")).filter(F.col("word").rlike(r"^\p{L}+$")).distinct()


def surnames(spark: SparkSession, path: str, top: int = 25_000) -> DataFrame:
    """Rows (word): the first column of the first rows of a CSV file, without its header."""
    # The first rows in order, each task's own first ones before those of all.
    rows = lines(spark, path).orderBy("position").limit(top + 1).withColumn("n", F.row_number().over(Window.orderBy("position"))).filter("n > 1")
    first = F.from_csv("line", "name string")
    return rows.select(F.lower(first["name"]).alias("word")).filter("word is not null").distinct()


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """Rows (word, kind) of lines `word kind`; # begins a comment, the last of a word counts."""
    rows = lines(spark, path).select("position", F.filter(F.split(F.regexp_replace("line", "#.*$", ""), r"\s+"), lambda t: t != "").alias("t")).filter(F.size("t") == 2)
    return rows.groupBy(F.get("t", F.lit(0)).alias("word")).agg(F.max_by(F.get("t", F.lit(1)), "position").alias("kind"))


def _tokens(line: Column | str) -> Column:
    return F.filter(F.split(line, " +"), lambda t: t != "")


def synsets(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows (kind, offset, words, pointers, gloss) of a sense database's data file of one part of speech.

    pointers: (symbol, offset, kind) of what a sense is a kind of (@), an instance of (@i) or derived from (+).
    """
    rows = lines(spark, path, "ISO-8859-1").filter(~F.col("line").startswith("  "))
    rows = rows.select(_tokens(F.substring_index("line", "|", 1)).alias("t"), F.when(F.col("line").contains("|"), F.lower(F.trim(F.regexp_replace("line", r"^[^|]*\|", "")))).otherwise("").alias("gloss")).filter(F.size("t") >= 4)
    rows = rows.withColumn("n", F.conv(F.get("t", F.lit(3)), 16, 10).cast("int"))
    rows = rows.withColumn("p", F.get("t", 4 + 2 * F.col("n")).cast("int"))
    named = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.replace(F.lower(F.get(F.col("t"), 4 + 2 * k)), F.lit("_"), F.lit(" ")))
    at = 5 + 2 * F.col("n")
    pointers = F.when(F.col("p") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("p") - 1, F.lit(0))), lambda k: F.struct(
        F.get(F.col("t"), at + 4 * k).alias("symbol"), F.get(F.col("t"), at + 4 * k + 1).alias("offset"), F.get(F.col("t"), at + 4 * k + 2).alias("kind"))))
    kept = F.filter(F.coalesce(pointers, F.array().cast("array<struct<symbol: string, offset: string, kind: string>>")), lambda p: p["symbol"].isin("@", "@i", "+"))
    return rows.select(F.lit(kind).alias("kind"), F.get("t", F.lit(0)).alias("offset"), named.alias("words"), kept.alias("pointers"), "gloss")


def senses(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows (word, kind, place, offset, tagged) of an index file: a word's senses, the commonest at place 0, and how often it was tagged."""
    rows = lines(spark, path, "ISO-8859-1").filter(~F.col("line").startswith("  ")).select(_tokens("line").alias("t")).filter(F.size("t") >= 6)
    at = 4 + F.get("t", F.lit(3)).cast("int")
    rows = rows.select(F.replace(F.lower(F.get("t", F.lit(0))), F.lit("_"), F.lit(" ")).alias("word"), F.get("t", at).cast("int").alias("n"), F.get("t", at + 1).cast("long").alias("tagged"), F.expr("slice(t, 4 + cast(t[3] as int) + 3, size(t))").alias("offsets"))
    return rows.select("word", F.lit(kind).alias("kind"), "n", "tagged", F.posexplode("offsets").alias("place", "offset")).filter("place < n").select("word", "kind", "place", "offset", "tagged")


def tagged_counts(senses: DataFrame) -> DataFrame:
    """Rows (word, kind, n) of senses(): one more than how often a word was tagged as a part of speech."""
    return senses.groupBy("word", "kind").agg((F.max("tagged") + 1).alias("n"))


def write_list(df: DataFrame, path: str) -> None:
    """A list as text, sorted, one word to a line, in one file: lists have a few thousand words."""
    df.select("word").coalesce(1).sortWithinPartitions("word").write.text(path)
