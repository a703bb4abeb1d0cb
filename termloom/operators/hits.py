"""Operators on hits (key, score, doc_len)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts(hits: DataFrame) -> DataFrame:
    """How many scores are neither 0 nor NaN, how many 0, and how many NaN."""
    nan = F.isnan("score")
    return hits.agg(
        F.count_if(~nan & (F.col("score") != 0)).alias("non_zero"),
        F.count_if(~nan & (F.col("score") == 0)).alias("zero"),
        F.count_if(nan).alias("nan"),
    )


def sort_by_score(hits: DataFrame, ascending: bool = False, ties: str = "key") -> DataFrame:
    """Sorted by score, ties by ``ties``; NaN scores go."""
    score = F.asc("score") if ascending else F.desc("score")
    return hits.where(~F.isnan("score")).orderBy(score, ties)


def sort_by(hits: DataFrame, *order: Column | str) -> DataFrame:
    """Sorted by any columns; NaN scores stay."""
    return hits.orderBy(*order)


def top_k(hits: DataFrame, k: int) -> DataFrame:
    """The first ``k`` in the order that the hits are in."""
    return hits.limit(k)


def sort_by_title(hits: DataFrame, part: str) -> DataFrame:
    """Hits whose key contains ``part`` first, then by score descending, then key; NaN scores go."""
    return hits.where(~F.isnan("score")).orderBy(F.desc(F.contains(F.col("key").cast("string"), F.lit(part))), F.desc("score"), "key")


def rounded(value: Column, digits: int) -> Column:
    """The double that ``digits`` after the point give for the exact binary value, ties to even, as C's printf rounds.
    Java's formatter rounds the shortest decimal that names the double, and ties up: 0.125 to 0.13, 1.005 to 1.01.

    The product with 10^digits is taken with its error (Dekker), which decides where the product itself is a tie."""
    scale = 10.0**digits
    if digits > 22:  # 10^digits is no double
        return value

    def halves(x: Column) -> tuple[Column, Column]:
        wide = x * F.lit(134217729.0)
        high = wide - (wide - x)
        return high, x - high

    product = value * F.lit(scale)
    (a, b), (c, d) = halves(value), halves(F.lit(scale))
    error = ((a * c - product) + a * d + b * c) + b * d
    low = F.floor(product).cast("double")
    tie = (product - low == 0.5) & (error != 0)
    whole = F.when(tie, F.when(error > 0, low + 1.0).otherwise(low)).otherwise(F.rint(product))
    near = F.abs(product) < F.lit(2.0**51)  # others, and those that are not finite, have no digits to round off here
    return F.when(near, F.when(whole == 0, F.rint(product) * 0.0).otherwise(whole / F.lit(scale))).otherwise(value)


def display(hits: DataFrame, digits: int = 6) -> DataFrame:
    """One line of text per hit, scores with so many digits after the point."""
    key = F.regexp_replace(F.col("key").cast("string"), r'(["\\])', r"\\$1")
    score = rounded(F.col("score").cast("double"), int(digits))
    line = F.format_string(f'score: %.{int(digits)}f\tdoc_len: %d\tkey: "%s"', score, F.col("doc_len"), key)
    return hits.select(line.alias("line"))
