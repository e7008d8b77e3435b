"""Ordered word lists: spelled by position, heard by broadcast lookups."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cached_property
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of the built-in lists are made of these by rule: two syllables, and an ending for their kind.
CONSONANTS, VOWELS = "bdfgklmnprst", "aio"
#: The sizes of the three kinds, and the ending that keeps them apart.
KINDS = {"adjective": (367, "y"), "noun": (800, "n"), "verb": (419, "s")}


def syllable_words(ending: str = "") -> list[str]:
    """Every pair of open syllables in alphabetical order, with an ending: 1,296 words."""
    syllables = [c + v for c, v in product(CONSONANTS, VOWELS)]
    return [a + b + ending for a, b in product(syllables, syllables)]


@dataclass(frozen=True)
class Vocabulary:
    """A list whose positions are digit values. Not to be longer than a few thousand words: it is broadcast."""

    words: tuple[str, ...]

    def __post_init__(self) -> None:
        if len(set(self.words)) != len(self.words) or len(self.words) > 100_000:
            raise ValueError("each word once, and no more than can be broadcast")

    @classmethod
    def read(cls, spark: SparkSession, path: str, size: int | None = None, sha256: str | None = None) -> Vocabulary:
        """From a text file of words between white space; the hash is of the file's bytes."""
        raw = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
        if sha256 and hashlib.sha256(raw).hexdigest() != sha256:
            raise ValueError(f"{path} isn't the expected list")
        words = tuple(raw.decode().split())
        if size and len(words) != size:
            raise ValueError(f"{path} has {len(words)} words, not {size}")
        return cls(words)

    def __len__(self) -> int:
        return len(self.words)

    @cached_property
    def joined(self) -> str:
        return " ".join(self.words)

    @cached_property
    def padded(self) -> tuple[bytearray, int]:
        """The words' bytes, each filled up with spaces to the longest, and how many that has."""
        width = max((len(w.encode()) for w in self.words), default=0)
        return bytearray(b"".join(w.encode().ljust(width) for w in self.words)), width

    def spell(self, digit: Column) -> Column:
        """The word at a position: a piece of one binary literal, found without a search and small in a plan, not a join."""
        raw, width = self.padded
        return F.rtrim(F.substring(F.lit(raw), (digit * width + 1).cast("int"), F.lit(width)).cast("string"))

    def table(self, spark: SparkSession) -> DataFrame:
        """Rows (word, position). Made by a plan alone, so that several broadcasts of one list are one."""
        rows = spark.range(0, 1, 1, 1).select(F.posexplode(F.split(F.lit(self.joined), " ")).alias("position", "word"))
        return rows.select("word", F.col("position").cast("long").alias("position"))

    def hear(self, df: DataFrame, word: Column, out: str) -> DataFrame:
        """out: the position of a word, null where it isn't on the list; a broadcast hash join.

        The key is exploded from an array of one: else the planner, looking for partitions to prune, writes it
        out down to the scan, and a permutation's rounds multiply on the way.
        """
        key = f"_word_{out}"
        rows = self.table(df.sparkSession).select(F.col("word").alias(key), F.col("position").alias(out))
        return df.withColumn(f"{key}_heard", F.explode(F.array(word))).join(F.broadcast(rows), F.col(f"{key}_heard") == F.col(key), "left").drop(key, f"{key}_heard")

    def all_known(self, words: Column) -> Column:
        """Whether every word of an array of any length is on the list."""
        return F.size(F.array_except(words, F.split(F.lit(self.joined), " "))) == 0


def built_in() -> Vocabulary:
    return Vocabulary(tuple(syllable_words()))


def built_in_kinds() -> dict[str, Vocabulary]:
    return {kind: Vocabulary(tuple(syllable_words(ending)[:size])) for kind, (size, ending) in KINDS.items()}
