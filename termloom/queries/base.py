"""What the registered queries share: the index of ``documents`` and the SQL that derives the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import tokens
from termloom.operators import bags
from termloom.sources.index import Index
from termloom.sources.workspace import new_path, stamp

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: By application, folder and name, the state of the folder's documents, and what was stored of them. One application's.
_STORED: dict[tuple[str, str, str], tuple[tuple, object]] = {}


def once[T](spark: SparkSession, sf_dir: str, name: str, make: Callable[[], T]) -> T:
    """What ``make`` stores, made once per session and state of the table of documents."""
    key, state = (spark.sparkContext.applicationId, sf_dir, name), stamp(spark, f"{sf_dir}/documents.parquet")
    if key not in _STORED or _STORED[key][0] != state:
        for old in [k for k in _STORED if k[0] != key[0]]:
            del _STORED[old]
        _STORED[key] = (state, make())
    return _STORED[key][1]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents. Of a table that Spark reads in fewer parts than there are cores, rows are dealt out."""
    rows, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    parts = rows._jdf.queryExecution().toRdd().getNumPartitions()  # of a scan alone: nothing runs
    return rows if parts >= cores else rows.repartition(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))), "doc_id")


def build_index(spark: SparkSession, sf_dir: str) -> Index:
    return Index.build(documents(spark, sf_dir), "doc_id", "text", unique=True)


def folded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bags of ``documents`` in the folded form, counted as the texts are read: nothing is stored or shuffled."""
    return build_index(spark, sf_dir).forward


def index_of(spark: SparkSession, sf_dir: str) -> Index:
    """The index of ``documents``, read from a snapshot."""
    return once(spark, sf_dir, "index", lambda: build_index(spark, sf_dir).save(new_path(spark, "index")))


def keys_of(index: Index) -> DataFrame:
    return index.docs.select("key")


def benchmark_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bags.from_text(table(spark, sf_dir, "benchmark"), "item_id", "text")


def folded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``turn_bags`` in the folded form."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), tokens("text").alias("terms"))
    return bags.folded(turns.groupBy("key").agg(F.flatten(F.collect_list("terms")).alias("terms"))).where(F.size("terms") > 0)


def turn_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bags of conversations, all turns of one together."""
    return bags.from_text(table(spark, sf_dir, "conversations"), "conv_id", "text")


def named(df: DataFrame, *columns: str) -> DataFrame:
    """``key`` as doc_id, scores rounded to six digits, and these columns only."""
    df = df.withColumnRenamed("key", "doc_id")
    for name in ("score", "probability", "unique_ratio"):
        if name in df.columns:
            df = df.withColumn(name, F.round(name, 6))
    return df.select(*columns) if columns else df


def tokens_sql(source: str, key: str, name: str) -> str:
    """CTEs of postings of a table: ``<name>`` (key, term, tf)."""
    return f"""{name}_tok AS (
  SELECT {key} AS key, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS term
  FROM {source}
), {name} AS (
  SELECT key, term, CAST(count(*) AS BIGINT) AS tf FROM {name}_tok GROUP BY key, term
)"""


#: post, docs (also empty ones), corpus, idf and norms of ``documents``.
INDEX_SQL = (
    "WITH "
    + tokens_sql("documents", "doc_id", "post")
    + """, docs AS (
  SELECT doc_id AS key, CAST(coalesce(sum(tf), 0) AS BIGINT) AS doc_len, CAST(count(term) AS BIGINT) AS n_terms
  FROM documents LEFT JOIN post ON doc_id = key GROUP BY doc_id
), facts AS (
  SELECT CAST(count(*) FILTER (WHERE n_terms > 0) AS BIGINT) AS n, avg(doc_len) AS mean_len FROM docs
), corpus AS (
  SELECT term, CAST(count(*) AS BIGINT) AS df FROM post GROUP BY term
), idf AS (
  SELECT term, df, CAST(n / (df + 1.0::DOUBLE) AS FLOAT) AS idf FROM corpus, facts
), norms AS (
  SELECT key, sqrt(sum(pow(tf * CAST(idf AS DOUBLE), 2))) AS norm FROM post JOIN idf USING (term) GROUP BY key
)"""
)

#: Counts of ``post`` as 16-bit floats hold their square roots: half (key, term, h).
HALF_SQL = """, halves AS (
  SELECT key, term, CAST(CAST(sqrt(CAST(tf AS FLOAT)) AS FLOAT) AS DOUBLE) AS x FROM post
), half AS (
  SELECT key, term, round_even(x / pow(2.0, floor(log2(x)) - 10), 0) * pow(2.0, floor(log2(x)) - 10) AS h FROM halves
)"""
