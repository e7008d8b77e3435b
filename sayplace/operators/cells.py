"""Hexagonal cell ids as bits: ordinals, validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sayplace.functions.numbers import digits

#: Fixed values of the public cell index: base cells, children of a cell, this codec's resolution, and the twelve
#: base cells that are pentagons and so lack the children along one axis.
BASE_CELLS, APERTURE, RESOLUTION = 122, 7, 14
PENTAGONS = [4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117]
SLOTS = BASE_CELLS * APERTURE**RESOLUTION


def _digit(cell: Column, r: int) -> Column:
    return F.shiftrightunsigned(cell, 3 * (15 - r)).bitwiseAND(F.lit(7))


def ordinal(cell: Column) -> Column:
    """A cell of the resolution as a number below SLOTS: its base cell, then its digits in base 7."""
    out = F.shiftrightunsigned(cell, 45).bitwiseAND(F.lit(127)).cast("long")
    for r in range(1, RESOLUTION + 1):
        out = out * APERTURE + _digit(cell, r)
    return out


def cell(ordinal: Column) -> Column:
    """The id of an ordinal, which need not be valid: mode 1, the resolution, the digits, and 7 where there is none."""
    parts = digits(ordinal, [BASE_CELLS, *[APERTURE] * RESOLUTION])
    head = (1 << 59) | (RESOLUTION << 52) | sum(7 << 3 * (15 - r) for r in range(RESOLUTION + 1, 16))
    out = F.lit(head).cast("long").bitwiseOR(F.shiftleft(parts[0].cast("long"), 45))
    for r, d in enumerate(parts[1:], 1):
        out = out.bitwiseOR(F.shiftleft(d.cast("long"), 3 * (15 - r)))
    return out


def valid(cell: Column) -> Column:
    """Whether an id made by cell() names a cell: in a pentagon the first digit that isn't 0 can't be 1."""
    base = F.shiftrightunsigned(cell, 45).bitwiseAND(F.lit(127))
    first = F.coalesce(*[F.nullif(_digit(cell, r), F.lit(0).cast("long")) for r in range(1, RESOLUTION + 1)], F.lit(0))
    return ~(base.isin(*PENTAGONS) & (first == 1))
