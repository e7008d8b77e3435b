"""Measurements of codecs: distances, quantiles, collisions, shared words and what a wrong word does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sayplace.functions.numbers import settled
from sayplace.functions.plane import Projection, great_circle
from sayplace.operators.mask import HEIGHT, SIDE, SOUTH, WEST, WIDTH, Grid
from sayplace.operators.vocabulary import Vocabulary


def upper_median(df: DataFrame, value: str, by: list[str] | None = None, accuracy: int = 10_000) -> DataFrame:
    """Rows (by..., median): of n values in order, number n div 2 counted from 0; exact.

    A sketch, which map tasks make and one merges, says between which two values the median lies: its ranks
    are off by n / accuracy at most. Of a group only the different values between these two are sorted, a
    part of about 4 / accuracy of its rows; what is below is a count. df is read twice.
    """
    by = by or []
    edge = 2 / accuracy
    rows = df.filter(F.col(value).isNotNull()).select(*by, value)
    ends = rows.groupBy(*by).agg(F.percentile_approx(value, F.array(F.lit(0.5 - edge), F.lit(0.5 + edge)), F.lit(accuracy)).alias("_ends"), F.count(F.lit(1)).alias("_total"))
    ends = ends.select(*(F.col(b).alias(f"_of_{b}") for b in by), F.col("_ends")[0].alias("_low"), F.col("_ends")[1].alias("_high"), "_total")
    same = [F.col(b).eqNullSafe(F.col(f"_of_{b}")) for b in by]
    met = rows.join(ends, same) if by else rows.crossJoin(F.broadcast(ends))
    near = met.filter(F.col(value) <= F.col("_high")).groupBy(*by, F.when(F.col(value) >= F.col("_low"), F.col(value)).alias(value), "_total").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by, "_total").orderBy(F.asc_nulls_first(value)).rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("_upto", upto).filter("_upto > _total div 2").groupBy(*by).agg(F.min(value).alias("median"))


def substituted(df: DataFrame, words: str, slot: Column, shift: Column, lists: list[Vocabulary], out: str) -> DataFrame:
    """out: the words with that of one slot replaced by another of its list, so many places on."""
    for k, v in enumerate(lists):
        df = v.hear(df, F.get(F.col(words), F.lit(k)), f"_s{k}")
    changed = [
        F.when(slot == k, v.spell(F.pmod(F.col(f"_s{k}") + 1 + F.pmod(shift, F.lit(len(v) - 1)), F.lit(len(v))))).otherwise(F.get(F.col(words), F.lit(k)))
        for k, v in enumerate(lists)]
    return df.withColumn(out, F.when(F.col(words).isNotNull(), F.array(*changed))).drop(*(f"_s{k}" for k in range(len(lists))))


def shared_words(a: Column, b: Column) -> Column:
    """How many words two addresses have in the same place."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def collisions(df: DataFrame, cell: str, words: str) -> DataFrame:
    """One row (cells, addresses): equal where no two cells have one address and no cell two."""
    pairs = df.filter(F.col(cell).isNotNull()).select(cell, F.array_join(words, ".").alias("_text")).distinct()
    return pairs.agg(F.countDistinct(cell).alias("cells"), F.countDistinct("_text").alias("addresses"))


def uniform(key: Column, salt: int) -> Column:
    """A number in [0, 1) that a hash of the key gives."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(salt)), 11).cast("double") / float(1 << 53)


def sphere_point(key: Column) -> tuple[Column, Column]:
    """A point that hashes of the key spread evenly over the sphere."""
    return F.degrees(F.asin(2 * uniform(key, 1) - 1)), 360 * uniform(key, 2) - 180


def farthest(df: DataFrame, by: list[str], distance: str) -> DataFrame:
    """Rows (by..., radius): the greatest distance of each group, as from a centre to an outline's corners."""
    return df.groupBy(*by).agg(F.max(distance).alias("radius"))


def mask_point(df: DataFrame, grid: Grid, rank: str, east: Column, north: Column, lat: str, lng: str) -> DataFrame:
    """lat, lng: a point of the mask's square with this rank, east and north of its corner by these parts of its side. One broadcast join."""
    squares = grid.table(df.sparkSession).select(F.col("rank").alias("_rank"), F.col("square").alias("_square"))
    df = df.join(F.broadcast(squares), F.col(rank) == F.col("_rank"), "left")
    x, y = WEST + (F.col("_square") % WIDTH + east) * SIDE, SOUTH + (F.expr(f"_square div {WIDTH}") + north) * SIDE
    df = df.withColumns({"_x": settled(x), "_y": settled(y)})
    to_lat, to_lng = grid.projection.to_sphere(F.col("_x"), F.col("_y"))
    return df.withColumns({lat: settled(to_lat), lng: settled(to_lng)}).drop("_rank", "_square", "_x", "_y")


def squareness(df: DataFrame, x: str, y: str, side: float, out: str, projection: Projection = Projection()) -> DataFrame:
    """out: how far from 1 the ratio of the ground lengths of a cell's middle lines is, for a cell of this side about a point of the plane."""
    half = side / 2
    ends = {"w": (-half, 0), "e": (half, 0), "s": (0, -half), "n": (0, half)}
    columns = {}
    for name, (dx, dy) in ends.items():
        columns[f"_{name}_lat"], columns[f"_{name}_lng"] = map(settled, projection.to_sphere(F.col(x) + dx, F.col(y) + dy))
    df = df.withColumns(columns)
    across, up = (great_circle(*(F.col(f"_{e}_{c}") for e in pair for c in ("lat", "lng"))) for pair in ("we", "sn"))
    return df.withColumn(out, F.abs(across / up - 1)).drop(*columns)


def grid_corners() -> list[tuple[float, float]]:
    """The corners of the grid on the plane, and its middle."""
    east, north = WEST + WIDTH * SIDE, SOUTH + HEIGHT * SIDE
    return [(WEST, SOUTH), (east, SOUTH), (WEST, north), (east, north), ((WEST + east) / 2, (SOUTH + north) / 2)]
