"""Helpers that the training-data operators share."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.sources.workspace import new_path, remove

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts the lineage: when executors are lost, later stages read the files and do not compute them anew. The
    table stays until the ``scratch`` in which it was written ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables written since the outermost ``scratch`` began.
_WRITTEN: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end the tables that were written in it, but for those whose paths are added to what it gives.
    Whatever reads them must have been written elsewhere by then."""
    first, kept = len(_WRITTEN), []
    yield kept
    own = _WRITTEN[first:]
    del _WRITTEN[first:]
    for path in own:
        if path in kept:
            _WRITTEN.append(path)
        else:
            remove(spark, path)


def last_written() -> str:
    """Path of the table that ``write_shared`` wrote last."""
    return _WRITTEN[-1]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from one literal, without Python on the executors."""
    fields = ", ".join(": ".join(field.split()) for field in schema.split(","))
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the faster built-in, which does the same there."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_LOWER))


def crc32_mod(name: str, mod: int) -> Column:
    """crc32 of the column as text, modulo ``mod``; null stays null."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % F.lit(mod)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
