import numpy as np
import pytest
from pyspark.sql import functions as F

from sayplace.functions import hexagons as H
from sayplace.operators import cells, points


def spread(n, seed=1):
    rng = np.random.default_rng(seed)
    return np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n)


def angle(a, b, c, d):
    """Degrees between points in degrees."""
    x, y = (H._unit(np.radians(p), np.radians(q)) for p, q in ((a, b), (c, d)))
    return np.degrees(2 * np.arcsin(np.clip(np.sqrt(((x - y) ** 2).sum(-1)) / 2, 0, 1)))


def all_cells(resolution):
    """Every valid cell: of a pentagon, the first digit that isn't 0 is never 1."""
    out = []
    for base in range(122):
        for n in range(7**resolution):
            digits = [n // 7**k % 7 for k in reversed(range(resolution))]
            first = next((d for d in digits if d), 0)
            if not (base in cells.PENTAGONS and first == 1):
                fields = sum(d << 3 * (15 - r) for r, d in enumerate([*digits, *[7] * (15 - resolution)], 1))
                out.append(1 << 59 | resolution << 52 | base << 45 | fields)
    return np.array(out, np.int64)


def test_faces_are_an_icosahedron():
    d = np.sort(H.POLES @ H.POLES.T, 1)
    assert np.allclose(d, d[0]) and np.allclose(d[0, 0], -1) and np.allclose(d[0, -4:-1], np.sqrt(5) / 3)
    assert (H.places().cell >= 0).sum() == 500 and [int(k) for k in np.flatnonzero(H.pentagons())] == cells.PENTAGONS


@pytest.mark.parametrize("resolution", [0, 1, 2, 3])
def test_every_centre_is_in_its_cell(resolution):
    every = all_cells(resolution)
    assert len(every) == 2 + 120 * 7**resolution
    assert (H.cell_at(*H.centre_of(every, resolution), resolution) == every).all()


def test_base_cells_go_from_north_to_south():
    lat, _ = H.centre_of(all_cells(0), 0)
    assert (np.diff(lat) < 1e-9).all()


def test_points_are_near_their_centres():
    lat, lng = spread(50_000)
    for resolution, most in ((1, 5), (4, 0.26), (5, 0.1), (14, 1.6e-5)):
        cell = H.cell_at(lat, lng, resolution)
        assert angle(lat, lng, *H.centre_of(cell, resolution)).max() < most
        assert (H.cell_at(*H.centre_of(cell, resolution), resolution) == cell).all()


def test_around_pentagons():
    """Points close around each pentagon's corner, where faces meet and a sixth is missing."""
    rng = np.random.default_rng(3)
    five = np.array([c for c in all_cells(0) if c >> 45 & 127 in cells.PENTAGONS])
    lat, lng = (np.repeat(x, 400) for x in H.centre_of(five, 0))
    for size in (10, 1, 1e-3, 1e-5):
        a, b = np.clip(lat + rng.normal(0, size, len(lat)), -90, 90), lng + rng.normal(0, size, len(lat))
        for resolution in (3, 4, 14):
            cell = H.cell_at(a, b, resolution)
            assert (H.cell_at(*H.centre_of(cell, resolution), resolution) == cell).all()
            near = H.centre_of(cell, resolution)
            assert angle(a, b, *near).max() < {3: 0.7, 4: 0.27, 14: 1.6e-5}[resolution]


def test_columns(spark):
    rows = [(1, 51.50072, -0.12456), (2, None, 1.0), (3, float("nan"), 1.0), (4, 90.0, 0.0), (5, -90.0, 180.0), (6, 91.0, 0.0), (7, 0.0, float("inf")), (8, 12.5, 540.0), (9, 12.5, 180.0)]
    df = spark.createDataFrame(rows, "k int, lat double, lng double").withColumn("cell", points.cell_at(F.col("lat"), F.col("lng")))
    got = {r.k: r for r in df.withColumn("at", points.centre(F.col("cell"))).withColumn("ok", cells.valid(F.col("cell"))).collect()}
    assert [k for k in sorted(got) if got[k].cell is None] == [2, 3, 6, 7] == [k for k in sorted(got) if got[k].at is None]
    # Fixed value of the public index.
    assert f"{got[1].cell:x}" == "8e194ad14c254f7" and abs(got[1].at.lat - 51.50072) < 2e-5
    assert got[8].cell == got[9].cell and all(got[k].ok for k in (1, 4, 5, 8))
