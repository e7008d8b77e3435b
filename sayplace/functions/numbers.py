"""Whole-number columns: truncated SHA-256, mixed radix digits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_of(value: Column, width: int) -> Column:
    """A non-negative long as big-endian hex digits, so many bytes wide."""
    return F.lpad(F.hex(value), 2 * width, "0")


def sha_mod(message_hex: Column, modulus: int, width: int = 8) -> Column:
    """The first 4 or 8 bytes of SHA-256 of a message given in hex, as an unsigned big-endian number, mod modulus.

    Eight bytes don't fit a signed long, so the two halves are reduced apart; modulus is below 2**31.
    """
    if not 0 < modulus < 1 << 31 or width not in (4, 8):
        raise ValueError("modulus below 2**31 and a width of 4 or 8")
    digest = F.sha2(F.unhex(message_hex), 256)
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    if width == 4:
        return high % modulus
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")
    return (high % modulus * ((1 << 32) % modulus) + low) % modulus


def div(value: Column, by: int | Column) -> Column:
    """Whole division of non-negative longs."""
    by = F.lit(by) if isinstance(by, int) else by
    return F.call_function("div", value, by)


def digits(value: Column, radices: Sequence[int]) -> list[Column]:
    """The mixed radix digits of a non-negative long, the most significant first."""
    out: list[Column] = []
    below = 1
    for radix in reversed(radices):
        out.append((div(value, below) if below > 1 else value) % radix)
        below *= radix
    return out[::-1]


def horner(parts: Sequence[Column], radices: Sequence[int]) -> Column:
    """The number whose mixed radix digits these are."""
    out = parts[0].cast("long")
    for part, radix in zip(parts[1:], radices[1:]):
        out = out * radix + part
    return out


def settled(value: Column) -> Column:
    """The value, marked so that no filter on it is pushed below its projection, where it would stand as one long nested expression."""
    return F.when(F.spark_partition_id() >= 0, value)


def apart(value: Column) -> Column:
    """settled(), and so that its projection is compiled by itself, not in one method with all that is before and after it.

    The compiler of whole stages makes one method of a chain of projections and joins, and the JVM only
    interprets methods of more than 8000 bytes. A projection with a higher-order function isn't part of a
    whole stage, so the chain is cut there.
    """
    return settled(F.get(F.transform(F.array(value), lambda x: x), F.lit(0)))
