"""A corpus pipeline of five stages over ``documents``: quality, line dedup, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return rows
with the columns of ``docs``. ``run`` writes what a stage returns as Parquet to the shared folder, and the next
stage reads that.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import last_written, scratch, table, write_shared
from termloom.llm.line_dedup import line_dedup
from termloom.llm.mixing import mix, mixed_documents
from termloom.llm.ngram_join import one_of_each_class
from termloom.llm.packing import pack
from termloom.llm.quality import score_quality
from termloom.sources.workspace import remove

#: SQL can express neither the classifier nor the packing; tests compare the stages with brute force instead.
ORACLE_SQL = None


def _columns(columns: list[str], **changed: object) -> list:
    return [changed.get(c, F.col("doc").getField(c)).alias(c) for c in columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learning from the labels in ``sf_dir``, does not reject."""
    scored = score_quality(docs, table(spark, sf_dir, "labels"), keep_columns=True)
    return scored.where("predicted = 1").select(*_columns(docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose template another document has first. A document that had lines, and of
    which only blank ones are left, goes: all of its lines stay elsewhere."""
    deduped = line_dedup(docs)
    left = (F.col("dropped") == 0) | F.col("text").rlike(r"\S")
    text = F.col("text")
    changed = {"text": text}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("dropped") > 0, F.length(text).cast(kind)).otherwise(F.col("doc").getField("n_chars"))
    return deduped.where(left).select(*_columns(docs.columns, **changed))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the least id. Rows that share an id, or have none,
    are told apart by their texts; rows that repeat the id and the text that stay are all kept, as are those of a class
    that has no id at all."""
    return one_of_each_class(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, shuffled in shards."""
    return mixed_documents(mix(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another. When a stage's documents are written, the tables that it wrote on its way, and the
    documents that it was given, are deleted."""
    docs, held = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            docs = write_shared(stage(spark, docs, sf_dir), f"pipeline-{name}")
            kept.append(last_written())
        for path in held:
            remove(spark, path)
        held = kept
    return STAGES[-1][1](spark, docs, sf_dir)
