"""Weighting engines: how a term count is stored, read back and weighted, as column expressions.

An engine is anything with these three methods. ``EXACT`` is the default; the others reproduce narrower cells,
with their loss.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F


class Engine(Protocol):
    def idf(self, docs: Column, df: Column) -> Column: ...

    def encode(self, tf: Column) -> Column: ...

    def decode(self, cell: Column) -> Column: ...


def plain_idf(docs: Column, df: Column) -> Column:
    """Documents over document frequency plus one, as a 32-bit float. There is no logarithm."""
    return (docs.cast("double") / (df.cast("double") + 1.0)).cast("float")


@dataclass(frozen=True)
class ExactEngine:
    """Counts as they are."""

    def idf(self, docs: Column, df: Column) -> Column:
        return plain_idf(docs, df)

    def encode(self, tf: Column) -> Column:
        return tf.cast("double")

    def decode(self, cell: Column) -> Column:
        return cell.cast("long")


@dataclass(frozen=True)
class HalfEngine(ExactEngine):
    """Square root of the count as a 16-bit float; reading back squares and truncates, so counts may lose one."""

    def encode(self, tf: Column) -> Column:
        root = F.sqrt(tf.cast("float")).cast("float").cast("double")
        unit = F.pow(F.lit(2.0), F.floor(F.log2(root)) - 10)  # distance of neighbouring 16-bit floats
        half = F.rint(root / unit) * unit
        # From 65520 on, a 16-bit float is infinite.
        return F.when(tf <= 0, F.lit(0.0)).when(root >= 65520.0, F.lit(float("inf"))).otherwise(half)

    def decode(self, cell: Column) -> Column:
        return F.when(cell >= 65520.0, F.lit(4294967295)).otherwise(F.floor(cell * cell)).cast("long")


@dataclass(frozen=True)
class WrappingEngine(ExactEngine):
    """Counts modulo a power of two, as unsigned cells of ``bits`` bits hold them."""

    bits: int = 16

    def encode(self, tf: Column) -> Column:
        return F.pmod(tf.cast("long"), F.lit(1 << self.bits).cast("long"))


@dataclass(frozen=True)
class LogEngine(ExactEngine):
    """An example of a custom engine: dampened counts, 1 + ln(tf) in fixed point with three digits."""

    def encode(self, tf: Column) -> Column:
        return F.when(tf <= 0, F.lit(0.0)).otherwise(F.round((1.0 + F.ln(tf.cast("double"))) * 1000.0))

    def decode(self, cell: Column) -> Column:
        return cell.cast("long")


EXACT = ExactEngine()
F16 = HalfEngine()
U16 = WrappingEngine(16)
U32 = WrappingEngine(32)
