"""The three address codecs as DataFrame transforms. None raises on data: a status column says what is wrong."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sayplace.functions.numbers import digits, div, hex_of, horner, settled, sha_mod
from sayplace.operators import cells, points
from sayplace.operators.feistel import Feistel
from sayplace.operators.mask import Grid, built_in_runs
from sayplace.operators.vocabulary import Vocabulary, built_in, built_in_kinds


def _hear(df: DataFrame, words: str, lists: Sequence[Vocabulary], number: str) -> DataFrame:
    """number: what the words spell, and _p0, _p1 ...: their positions, null for words that aren't on their list."""
    for k, v in enumerate(lists):
        df = v.hear(df, F.get(F.col(words), F.lit(k)), f"_p{k}")
    return df.withColumn(number, horner([F.col(f"_p{k}") for k in range(len(lists))], [len(v) for v in lists]))


def _spoken(value: Column, lists: Sequence[Vocabulary]) -> Column:
    said = F.array(*(v.spell(d) for v, d in zip(lists, digits(value, [len(v) for v in lists]))))
    return settled(F.when(value.isNotNull(), said))


def spoken_text(words: Column) -> Column:
    return F.array_join(words, ".")


@dataclass(frozen=True)
class World:
    """Five words for a cell of the hexagonal index, with a check of what the words have to spare."""

    words: Vocabulary = field(default_factory=built_in)
    length: int = 5

    @cached_property
    def scramble(self) -> Feistel:
        half = math.isqrt(len(self.words) ** self.length)
        if half * half != len(self.words) ** self.length:
            raise ValueError("the words' space must be a square number")
        return Feistel(half, half)

    @cached_property
    def check(self) -> int:
        return self.scramble.space // cells.SLOTS

    @property
    def used(self) -> int:
        return cells.SLOTS * self.check

    def check_of(self, cell: Column) -> Column:
        return sha_mod(hex_of(cell, 8), self.check)

    def encode(self, df: DataFrame, cell: str, out: str = "words") -> DataFrame:
        """out: the words of a cell id; null for null."""
        df = df.withColumn("_value", cells.ordinal(F.col(cell)) * self.check + self.check_of(F.col(cell)))
        df = self.scramble.forward(df, "_value", "_number")
        return df.withColumn(out, _spoken(F.col("_number"), [self.words] * self.length)).drop("_value", "_number")

    def decode(self, df: DataFrame, words: str, out: str = "cell", status: str = "status") -> DataFrame:
        """out: the cell an array of words names, else null and a status: unknown_word, wrong_count, no_such_address, no_such_cell or check_failed, tested in this order."""
        df = _hear(df, words, [self.words] * self.length, "_number")
        df = self.scramble.back(df, "_number", "_value")
        df = df.withColumn("_cell", cells.cell(div(F.col("_value"), self.check)))
        said = F.col(words)
        unknown = F.when(F.size(said) == self.length, F.col("_number").isNull()).otherwise(~self.words.all_known(said))
        why = (
            F.when(said.isNull(), F.lit(None).cast("string")).when(unknown, "unknown_word").when(F.size(said) != self.length, "wrong_count")
            .when(F.col("_value") >= self.used, "no_such_address").when(~cells.valid(F.col("_cell")), "no_such_cell")
            .when(self.check_of(F.col("_cell")) != F.col("_value") % self.check, "check_failed").otherwise("ok"))
        df = df.withColumn(status, why).withColumn(out, F.when(F.col(status) == "ok", F.col("_cell")))
        return df.drop("_number", "_value", "_cell", *(f"_p{k}" for k in range(self.length)))


    def encode_point(self, df: DataFrame, lat: str, lng: str, out: str = "words", cell: str = "cell") -> DataFrame:
        """cell and out: the cell that holds a point and its words; null where there is no point."""
        return self.encode(df.withColumn(cell, points.cell_at(F.col(lat), F.col(lng))), cell, out)

    def decode_point(self, df: DataFrame, words: str, lat: str = "lat", lng: str = "lng", cell: str = "cell", status: str = "status") -> DataFrame:
        """lat, lng: the centre of the cell that words name; null with any status but ok."""
        df = self.decode(df, words, cell, status).withColumn("_centre", points.centre(F.col(cell)))
        return df.withColumns({lat: F.col("_centre.lat"), lng: F.col("_centre.lng")}).drop("_centre")


@dataclass(frozen=True)
class Plane:
    """Three words for a square cell of the grid, and an optional number from 00 to 99: a quarter of the cell and a check."""

    grid: Grid = field(default_factory=lambda: Grid(tuple(built_in_runs())))
    words: Vocabulary = field(default_factory=built_in)
    length: int = 3
    parts: int = 2

    @cached_property
    def scramble(self) -> Feistel:
        half = math.isqrt(len(self.words) ** self.length)
        if half * half != len(self.words) ** self.length:
            raise ValueError("the words' space must be a square number")
        return Feistel(half, half, key=b"uk", hash_bytes=4)

    @cached_property
    def k(self) -> int:
        return self.grid.per_side(self.scramble.space)

    @property
    def count(self) -> int:
        return len(self.grid.squares) * self.k**2

    @property
    def check(self) -> int:
        return 100 // self.parts**2

    def check_of(self, cell: Column, part: Column) -> Column:
        return sha_mod(F.concat(F.lit(b"ukd".hex()), hex_of(cell, 8), hex_of(part, 1)), self.check)

    def encode(self, df: DataFrame, lat: str, lng: str, out: str = "words", status: str = "status", cell: str = "cell") -> DataFrame:
        """cell and out: a point's cell and its words; null and the status outside where the mask doesn't cover it."""
        df = self.grid.cell(df, lat, lng, self.k, cell)
        df = self.scramble.forward(df, cell, "_number").withColumn(out, _spoken(F.col("_number"), [self.words] * self.length))
        known = F.col(lat).isNotNull() & F.col(lng).isNotNull()
        return df.withColumn(status, F.when(known, F.when(F.col(cell).isNull(), "outside").otherwise("ok"))).drop("_number")

    def number(self, df: DataFrame, lat: str, lng: str, cell: str, out: str = "number") -> DataFrame:
        """out: the optional number of a point in its cell."""
        df = df.withColumn("_part", self.grid.part(F.col(lat), F.col(lng), self.k, self.parts))
        return df.withColumn(out, (F.col("_part") * self.check + self.check_of(F.col(cell), F.col("_part"))).cast("long")).drop("_part")

    def decode_cell(self, df: DataFrame, words: str, out: str = "cell", status: str = "status") -> DataFrame:
        """out: the cell an array of words names, else null and a status: unknown_word, wrong_count or no_such_address."""
        df = _hear(df, words, [self.words] * self.length, "_number")
        df = self.scramble.back(df, "_number", "_value")
        said = F.col(words)
        unknown = F.when(F.size(said) == self.length, F.col("_number").isNull()).otherwise(~self.words.all_known(said))
        why = (
            F.when(said.isNull(), F.lit(None).cast("string")).when(unknown, "unknown_word").when(F.size(said) != self.length, "wrong_count")
            .when(F.col("_value") >= self.count, "no_such_address").otherwise("ok"))
        df = df.withColumn(status, why).withColumn(out, F.when(F.col(status) == "ok", F.col("_value")))
        return df.drop("_number", "_value", *(f"_p{k}" for k in range(self.length)))

    def decode(self, df: DataFrame, words: str, lat: str = "lat", lng: str = "lng", number: str | None = None, cell: str = "cell", status: str = "status") -> DataFrame:
        """lat, lng: the centre of the cell, or of its quarter where a number is given that fits; else number_range or number_mismatch."""
        df = self.decode_cell(df, words, cell, status)
        if number is None:
            return self.grid.centre(df, cell, self.k, lat, lng)
        n = F.col(number)
        df = df.withColumn("_part", F.when(n.between(0, 99), div(n.cast("long"), self.check)))
        fits = self.check_of(F.col(cell), F.col("_part")) == n % self.check
        why = F.when(F.col(status) != "ok", F.col(status)).when(n.isNull(), F.col(status)).when(~n.between(0, 99), "number_range").when(~fits, "number_mismatch").otherwise("ok")
        df = df.withColumn("_why", why).drop(status).withColumnRenamed("_why", status)
        df = self.grid.centre(df, cell, self.k, "_lat", "_lng")
        df = self.grid.centre(df, cell, self.k, "_plat", "_plng", part="_part", parts=self.parts)
        good = F.col(status) == "ok"
        return df.withColumns({
            lat: F.when(good, F.when(n.isNull(), F.col("_lat")).otherwise(F.col("_plat"))),
            lng: F.when(good, F.when(n.isNull(), F.col("_lng")).otherwise(F.col("_plng")))}).drop("_lat", "_lng", "_plat", "_plng", "_part")

    @staticmethod
    def text(words: Column, number: Column | None = None) -> Column:
        """The words with points between, and the number's two digits where there is one."""
        if number is None:
            return spoken_text(words)
        return F.when(number.isNull(), spoken_text(words)).otherwise(F.concat(spoken_text(words), F.lit(" "), F.lpad(number.cast("string"), 2, "0")))


@dataclass(frozen=True)
class Phrase:
    """An adjective, a noun, a verb and a noun for a cell of the grid, with a check of at least one in least_check."""

    grid: Grid = field(default_factory=lambda: Grid(tuple(built_in_runs())))
    lists: dict[str, Vocabulary] = field(default_factory=built_in_kinds)
    least_check: int = 20
    pattern: tuple[str, ...] = ("adjective", "noun", "verb", "noun")

    @property
    def slots(self) -> list[Vocabulary]:
        return [self.lists[kind] for kind in self.pattern]

    @cached_property
    def scramble(self) -> Feistel:
        a, b, c, d = (len(v) for v in self.slots)
        return Feistel(a * b, c * d, key=b"ukp", half_bytes=8)

    @cached_property
    def k(self) -> int:
        return math.isqrt(self.scramble.space // (len(self.grid.squares) * self.least_check))

    @property
    def count(self) -> int:
        return len(self.grid.squares) * self.k**2

    @cached_property
    def check(self) -> int:
        return self.scramble.space // self.count

    @property
    def used(self) -> int:
        return self.count * self.check

    def check_of(self, cell: Column) -> Column:
        return sha_mod(F.concat(F.lit(b"ukp-check".hex()), hex_of(cell, 8)), self.check)

    def encode(self, df: DataFrame, lat: str, lng: str, out: str = "words", status: str = "status", cell: str = "cell") -> DataFrame:
        """cell and out: a point's cell and its phrase; null and the status outside where the mask doesn't cover it."""
        df = self.grid.cell(df, lat, lng, self.k, cell)
        df = df.withColumn("_value", F.col(cell) * self.check + self.check_of(F.col(cell)))
        df = self.scramble.forward(df, "_value", "_number").withColumn(out, _spoken(F.col("_number"), self.slots))
        known = F.col(lat).isNotNull() & F.col(lng).isNotNull()
        return df.withColumn(status, F.when(known, F.when(F.col(cell).isNull(), "outside").otherwise("ok"))).drop("_value", "_number")

    def kind_of(self, df: DataFrame, word: Column, out: str) -> DataFrame:
        """out: the first kind whose list has the word."""
        for kind, v in self.lists.items():
            df = v.hear(df, word, f"_k_{kind}")
        found = F.coalesce(*(F.when(F.col(f"_k_{kind}").isNotNull(), kind) for kind in self.lists))
        return df.withColumn(out, found).drop(*(f"_k_{kind}" for kind in self.lists))

    def decode_cell(self, df: DataFrame, words: str, out: str = "cell", status: str = "status", hint: str | None = None) -> DataFrame:
        """out: the cell a phrase names, else null and a status: wrong_count, unknown_word, no_such_address or check_failed.

        A word must be on its own slot's list; hint: what kind the first word that isn't would be.
        """
        df = _hear(df, words, self.slots, "_number")
        df = self.scramble.back(df, "_number", "_value").withColumn("_cell", div(F.col("_value"), self.check))
        said = F.col(words)
        why = (
            F.when(said.isNull(), F.lit(None).cast("string")).when(F.size(said) != len(self.pattern), "wrong_count").when(F.col("_number").isNull(), "unknown_word")
            .when(F.col("_value") >= self.used, "no_such_address").when(self.check_of(F.col("_cell")) != F.col("_value") % self.check, "check_failed").otherwise("ok"))
        df = df.withColumn(status, why).withColumn(out, F.when(F.col(status) == "ok", F.col("_cell")))
        if hint:
            wrong = F.coalesce(*(F.when(F.col(f"_p{k}").isNull(), F.get(said, F.lit(k))) for k in range(len(self.pattern))))
            df = self.kind_of(df, F.when(F.col(status) == "unknown_word", wrong), hint)
        return df.drop("_number", "_value", "_cell", *(f"_p{k}" for k in range(len(self.pattern))))

    def decode(self, df: DataFrame, words: str, lat: str = "lat", lng: str = "lng", cell: str = "cell", status: str = "status") -> DataFrame:
        return self.grid.centre(self.decode_cell(df, words, cell, status), cell, self.k, lat, lng)
