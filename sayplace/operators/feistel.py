"""A keyed permutation of whole numbers as DataFrame transforms: a Feistel network over two moduli."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sayplace.functions.numbers import apart, div, hex_of, sha_mod


@dataclass(frozen=True)
class Feistel:
    """Numbers below left * right. A round's function hashes the key, the round's number and a half.

    key: bytes before the round's number; half_bytes: width of the half; hash_bytes: how much of the hash counts.
    """

    left: int
    right: int
    key: bytes = b""
    half_bytes: int = 4
    hash_bytes: int = 8
    rounds: int = 6

    def __post_init__(self) -> None:
        if self.rounds % 2:
            raise ValueError("an even number of rounds, so that the halves end with the sizes they began with")

    @property
    def space(self) -> int:
        return self.left * self.right

    def _mix(self, i: int, half: Column, modulus: int) -> Column:
        head = (self.key + bytes([i])).hex()
        return sha_mod(F.concat(F.lit(head), hex_of(half, self.half_bytes)), modulus, self.hash_bytes)

    def _moduli(self, i: int) -> int:
        """What round i counts its sum by: the size of the half that it replaces."""
        return self.left if i % 2 == 0 else self.right

    def forward(self, df: DataFrame, value: str, out: str) -> DataFrame:
        """out: the image of a column of longs in [0, space); null stays null.

        Each round is a projection of its own: as one nested expression the halves, each used twice,
        would multiply, while Catalyst keeps chained projections of costly expressions apart.
        """
        a, b = (f"_{uuid.uuid4().hex[:8]}" for _ in range(2))
        df = df.withColumns({a: apart(div(F.col(value), self.right)), b: apart(F.col(value) % self.right)})
        for i in range(self.rounds):
            m = self._moduli(i)
            df = df.withColumns({a: F.col(b), b: (F.col(a) + self._mix(i, F.col(b), m)) % m})
        return df.withColumn(out, apart(F.col(a) * self.right + F.col(b))).drop(a, b)

    def back(self, df: DataFrame, value: str, out: str) -> DataFrame:
        """The inverse of forward."""
        a, b = (f"_{uuid.uuid4().hex[:8]}" for _ in range(2))
        df = df.withColumns({a: apart(div(F.col(value), self.right)), b: apart(F.col(value) % self.right)})
        for i in reversed(range(self.rounds)):
            m = self._moduli(i)
            df = df.withColumns({a: F.pmod(F.col(b) - self._mix(i, F.col(a), m), F.lit(m)), b: F.col(a)})
        return df.withColumn(out, apart(F.col(a) * self.right + F.col(b))).drop(a, b)
