"""Points to cells of the hexagonal index and back, as columns. Arrow batches through numpy: the geometry has no form in built-in functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from sayplace.functions import hexagons


def cell_at(lat: Column, lng: Column) -> Column:
    """The cell, of the codec's resolution, that holds a point in degrees; null for null, not finite, and latitudes beyond the poles."""
    return F.arrow_udf(_cell_at, LongType())(lat.cast("double"), lng.cast("double"))


def _cell_at(lat: pa.Array, lng: pa.Array) -> pa.Array:
    a, b = (c.to_numpy(zero_copy_only=False).astype(float) for c in (lat, lng))
    good = np.isfinite(a) & np.isfinite(b) & (np.abs(np.where(np.isfinite(a), a, 0)) <= 90)
    out = np.zeros(len(a), np.int64)
    out[good] = hexagons.cell_at(a[good], b[good])
    return pa.array(out, mask=~good)


def centre(cell: Column) -> Column:
    """Struct (lat, lng) of the centre of a valid cell of the codec's resolution, in degrees; null for null."""
    return F.arrow_udf(_centre, StructType().add("lat", DoubleType()).add("lng", DoubleType()))(cell)


def _centre(cell: pa.Array) -> pa.Array:
    known = cell.is_valid().to_numpy(zero_copy_only=False)
    lat, lng = np.zeros(len(cell)), np.zeros(len(cell))
    if known.any():
        lat[known], lng[known] = hexagons.centre_of(cell.drop_null().to_numpy())
    return pa.StructArray.from_arrays([pa.array(lat), pa.array(lng)], ["lat", "lng"], mask=pa.array(~known))
