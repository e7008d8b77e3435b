"""A grid of squares on the plane and the part of it that addresses cover."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sayplace.functions.numbers import settled
from sayplace.functions.plane import Projection

#: Squares across and up, a square's side and the south-west corner in metres.
WIDTH, HEIGHT, SIDE, WEST, SOUTH = 486, 656, 2000.0, -616000.0, -642000.0

#: The built-in mask by rule: squares within any of these ellipses (centre column and row, half axes), whole numbers.
ELLIPSES = [(360, 205, 95, 150), (300, 320, 70, 120), (270, 460, 75, 110), (160, 330, 45, 45), (215, 205, 70, 60)]


def built_in_runs() -> list[int]:
    """Run lengths of the built-in mask, outside first, row by row from the south-west."""
    i, j = np.meshgrid(np.arange(WIDTH, dtype=np.int64), np.arange(HEIGHT, dtype=np.int64))
    inside = np.zeros(i.shape, bool)
    for ci, cj, ri, rj in ELLIPSES:
        inside |= (i - ci) ** 2 * rj**2 + (j - cj) ** 2 * ri**2 <= ri**2 * rj**2
    flat = np.concatenate(([False], inside.ravel()))
    edges = np.flatnonzero(flat[1:] != flat[:-1])
    return np.diff(np.concatenate(([0], edges, [flat.size - 1]))).tolist()


def read_runs(spark: SparkSession, path: str) -> list[int]:
    """From a text file of run lengths between commas."""
    return [int(n) for row in spark.read.text(path).collect() for n in row[0].split(",") if n.strip()]


_TABLES: dict = {}


@dataclass(frozen=True)
class Grid:
    """The plane's squares, row-major from the south-west, of which those in the mask are numbered in order."""

    runs: tuple[int, ...]
    projection: Projection = Projection()

    def __post_init__(self) -> None:
        if sum(self.runs) != WIDTH * HEIGHT:
            raise ValueError("the runs must cover the grid")

    @cached_property
    def squares(self) -> np.ndarray:
        """The squares of the mask, a number of at most WIDTH * HEIGHT by which its table can be broadcast."""
        ends = np.cumsum(self.runs)
        return np.concatenate([np.arange(e - n, e) for n, e in list(zip(self.runs, ends))[1::2]] or [np.empty(0, np.int64)])

    def table(self, spark: SparkSession) -> DataFrame:
        """Rows (square, rank), sent to the JVM once a session, so that several broadcasts of one mask are one."""
        key = (spark.sparkContext.applicationId, self.runs)
        if key not in _TABLES:
            _TABLES[key] = spark.createDataFrame(pa.table({"square": pa.array(self.squares, pa.int64()), "rank": pa.array(np.arange(len(self.squares)), pa.int64())}))
        return _TABLES[key]

    def per_side(self, space: int) -> int:
        """The most cells along a square's side with which all cells fit in the space."""
        return math.isqrt(space // len(self.squares))

    def place(self, lat: Column, lng: Column) -> tuple[Column, Column]:
        """Squares east and north of the corner, with fractions."""
        x, y = self.projection.to_plane(lat, lng)
        return (x - WEST) / SIDE, (y - SOUTH) / SIDE

    def cell(self, df: DataFrame, lat: str, lng: str, k: int, out: str) -> DataFrame:
        """out: the cell that holds a point, (rank * k + row) * k + column; null outside the mask. One broadcast hash join."""
        fx, fy = self.place(F.col(lat), F.col(lng))
        # Settled: everything below uses them several times, and written out each time the method would be too large to be compiled.
        df = df.withColumns({"_fx": settled(fx), "_fy": settled(fy)})
        i, j = F.floor("_fx"), F.floor("_fy")
        on_grid = (i >= 0) & (i < WIDTH) & (j >= 0) & (j < HEIGHT)
        df = df.withColumn("_square", F.when(on_grid, j * WIDTH + i))
        mask = self.table(df.sparkSession).select(F.col("square").alias("_in"), F.col("rank").alias("_rank"))
        df = df.join(F.broadcast(mask), F.col("_square") == F.col("_in"), "left")
        col = F.least(((F.col("_fx") - i) * k).cast("long"), F.lit(k - 1))
        row = F.least(((F.col("_fy") - j) * k).cast("long"), F.lit(k - 1))
        return df.withColumn(out, ((F.col("_rank") * k + row) * k + col).cast("long")).drop("_fx", "_fy", "_square", "_in", "_rank")

    def centre(self, df: DataFrame, cell: str, k: int, lat: str, lng: str, part: str | None = None, parts: int = 2) -> DataFrame:
        """lat, lng: the centre of a cell, or of one of its parts x parts parts, numbered row by row."""
        mask = self.table(df.sparkSession).select(F.col("rank").alias("_rank"), F.col("square").alias("_square"))
        c = F.col(cell)
        df = df.withColumn("_of", F.expr(f"{cell} div {k * k}")).join(F.broadcast(mask), F.col("_of") == F.col("_rank"), "left")
        row, col = F.expr(f"{cell} % {k * k} div {k}"), c % k
        i, j = F.col("_square") % WIDTH, F.expr(f"_square div {WIDTH}")
        size = SIDE / k
        if part is None:
            x = WEST + i * SIDE + (col + 0.5) * size
            y = SOUTH + j * SIDE + (row + 0.5) * size
        else:
            x = WEST + i * SIDE + col * size + (F.col(part) % parts + 0.5) * (size / parts)
            y = SOUTH + j * SIDE + row * size + (F.expr(f"{part} div {parts}") + 0.5) * (size / parts)
        df = df.withColumns({"_x": settled(x), "_y": settled(y)})
        to_lat, to_lng = self.projection.to_sphere(F.col("_x"), F.col("_y"))
        return df.withColumns({lat: settled(to_lat), lng: settled(to_lng)}).drop("_of", "_rank", "_square", "_x", "_y")

    def part(self, lat: Column, lng: Column, k: int, parts: int = 2) -> Column:
        """Which of a cell's parts x parts parts a point lies in, row by row."""
        x, y = self.projection.to_plane(lat, lng)
        fx, fy = (x - WEST) / SIDE * k, (y - SOUTH) / SIDE * k
        col = F.least(((fx - F.floor(fx)) * parts).cast("long"), F.lit(parts - 1))
        row = F.least(((fy - F.floor(fy)) * parts).cast("long"), F.lit(parts - 1))
        return (row * parts + col).cast("long")


def decode_runs(runs: DataFrame, at: str, length: str) -> DataFrame:
    """Rows (square) of every second run, from a table of run lengths and their order. Its size is a grid's."""
    end = F.sum(length).over(Window.orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    rows = runs.select(F.row_number().over(Window.orderBy(at)).alias("n"), end.alias("end"), F.col(length).alias("run"))
    return rows.filter("n % 2 = 0 and run > 0").select(F.explode(F.expr("sequence(end - run, end - 1)")).alias("square"))


def encode_runs(squares: DataFrame, total: int) -> DataFrame:
    """Rows (at, run): run lengths of a set of squares, outside first, the inverse of decode_runs. Its size is a grid's."""
    rows = squares.select("square").distinct().withColumn("island", F.col("square") - F.row_number().over(Window.orderBy("square")))
    islands = rows.groupBy("island").agg(F.min("square").alias("first"), F.max("square").alias("last"))
    before = F.lag("last", 1, -1).over(Window.orderBy("first"))
    pairs = islands.select("first", F.col("last"), (F.col("first") - before - 1).alias("gap")).select(
        "first", F.posexplode(F.array("gap", F.col("last") - F.col("first") + 1)).alias("p", "run"))
    rest = islands.agg((F.lit(total) - F.coalesce(F.max("last"), F.lit(-1)) - 1).alias("run"), F.lit(total).alias("first"), F.lit(0).alias("p")).filter("run > 0")
    both = pairs.select("first", "p", "run").unionByName(rest.select("first", "p", "run"))
    return both.select((F.row_number().over(Window.orderBy("first", "p")) - 1).alias("at"), F.col("run").cast("long").alias("run"))


def dilate(squares: DataFrame, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """The squares and their eight neighbours, but for the grid's outer ring."""
    near = squares.select(
        F.explode(F.expr("flatten(transform(sequence(-1, 1), dj -> transform(sequence(-1, 1), di -> named_struct('i', square % {w} + di, 'j', square div {w} + dj))))".format(w=width))).alias("s"))
    inner = near.select("s.i", "s.j").filter((F.col("i") > 0) & (F.col("i") < width - 1) & (F.col("j") > 0) & (F.col("j") < height - 1))
    return inner.select((F.col("j") * width + F.col("i")).alias("square")).distinct()


def ring_edges(rings: DataFrame, ring: str, points: str) -> DataFrame:
    """Rows (ring, x0, y0, x1, y1): the sides of closed rings given as arrays of (x, y)."""
    shifted = F.transform(F.sequence(F.lit(0), F.size(points) - 1), lambda k: F.struct(
        F.get(F.col(points), k).alias("a"), F.get(F.col(points), F.pmod(k + 1, F.size(points))).alias("b")))
    return rings.select(ring, F.explode(shifted).alias("e")).select(
        ring, F.col("e.a.x").alias("x0"), F.col("e.a.y").alias("y0"), F.col("e.b.x").alias("x1"), F.col("e.b.y").alias("y1"))


def fill(edges: DataFrame, step: float, west: float, south: float, across: int, up: int) -> DataFrame:
    """Rows (j, i) of sample points inside the rings, by the even-odd rule, at step/2 + i * step east and so on.

    Each side is exploded to the rows it crosses, so the join of sides and rows is an equality and not a
    range; crossings of a row are sorted and paired, and only columns between a pair are listed.
    """
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    first = F.greatest(F.ceil((low - south) / step - 0.5), F.lit(0))
    last = F.least(F.ceil((high - south) / step - 0.5) - 1, F.lit(up - 1))
    crossed = edges.filter("y0 != y1").withColumns({"_a": first, "_b": last}).filter("_a <= _b").withColumn("j", F.explode(F.sequence("_a", "_b")))
    y = F.lit(south) + (F.col("j") + 0.5) * step
    cuts = crossed.select("j", (F.col("x0") + (y - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))).alias("x"))
    w = Window.partitionBy("j").orderBy("x")
    pairs = cuts.select("j", F.col("x"), F.lead("x").over(w).alias("next"), F.row_number().over(w).alias("n")).filter("n % 2 = 1 and next is not null")
    begin = F.greatest(F.floor((F.col("x") - west) / step - 0.5) + 1, F.lit(0))
    end = F.least(F.floor((F.col("next") - west) / step - 0.5), F.lit(across - 1))
    return pairs.withColumns({"_a": begin, "_b": end}).filter("_a <= _b").select("j", F.explode(F.sequence("_a", "_b")).alias("i")).distinct()


def mask_from_rings(rings: DataFrame, ring: str, points: str, samples: int = 8) -> DataFrame:
    """Rows (square): squares with any sample inside the rings or a vertex of theirs, and their neighbours, less the outer ring."""
    inside = fill(ring_edges(rings, ring, points), SIDE / samples, WEST, SOUTH, WIDTH * samples, HEIGHT * samples)
    land = inside.select((F.expr(f"j div {samples}") * WIDTH + F.expr(f"i div {samples}")).cast("long").alias("square"))
    vertex = rings.select(F.explode(points).alias("p")).select(F.floor((F.col("p.x") - WEST) / SIDE).alias("i"), F.floor((F.col("p.y") - SOUTH) / SIDE).alias("j"))
    stamped = vertex.filter((F.col("i") >= 0) & (F.col("i") < WIDTH) & (F.col("j") >= 0) & (F.col("j") < HEIGHT)).select((F.col("j") * WIDTH + F.col("i")).alias("square"))
    return dilate(land.unionByName(stamped).distinct())


def rings_from_geojson(spark: SparkSession, path: str, projection: Projection, codes: tuple[str, ...] = ("GBR", "IMN", "JEY", "GGY"), field: str = "ADM0_A3") -> DataFrame:
    """Rows (ring, points) of the projected polygons of features whose code is wanted; Polygon and MultiPolygon."""
    schema = f"features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
    features = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    wanted = features.filter(F.col("f.properties")[field].isin(*codes)).select(F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("c"))
    many = F.when(F.col("type") == "Polygon", F.concat(F.lit("["), F.col("c"), F.lit("]"))).otherwise(F.col("c"))
    polygons = wanted.filter("type in ('Polygon', 'MultiPolygon')").select(F.from_json(many, "array<array<array<array<double>>>>").alias("m"))
    rings = polygons.select(F.explode(F.flatten("m")).alias("r")).withColumn("ring", F.monotonically_increasing_id())
    point = lambda p: F.struct(*(c.alias(n) for c, n in zip(projection.to_plane(F.get(p, 1), F.get(p, 0)), "xy")))
    return rings.select("ring", F.transform("r", point).alias("points"))
