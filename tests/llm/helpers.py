"""Small tables for the operators' edge cases."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema=SCHEMA):
    """Rows of (doc_id, text[, lang, source, n_chars])."""
    full = [tuple(r) + (None,) * (5 - len(r)) for r in rows]
    return spark.createDataFrame(full, schema)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def clashing(df, *names):
    """With extra columns that operators might use inside."""
    from pyspark.sql import functions as F

    for name in names:
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df


NAMES = ("key", "node", "doc", "size", "hash", "band", "bucket", "keep_id", "score", "n", "place", "gone", "lines", "text_key", "held_out", "norm", "draw", "block", "shard", "items", "page", "host", "path", "rule", "stays", "row", "row_id", "row_key", "owner", "slot", "part", "bits", "tokens", "words", "copies", "links", "keeps", "target", "source_no", "item", "fit", "held", "turn", "label", "pick", "length", "task", "start")
