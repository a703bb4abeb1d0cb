"""Tokenising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = r"[^\p{L}\p{N}]+"


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits, in order; null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")
