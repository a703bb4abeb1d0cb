"""Queries of the algebra of bags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.weights import F16, U16, U32
from termloom.operators import bags
from termloom.queries.base import HALF_SQL, INDEX_SQL, Query, benchmark_bags, folded_documents, folded_turns, index_of, keys_of, named, table, tokens_sql
from termloom.sources.workspace import new_path

STOP = ["the", "of", "and", "der", "die", "de", "la"]
STOP_SQL = "(" + ", ".join(f"'{t}'" for t in STOP) + ")"


def _own(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bags.unfolded(folded_documents(spark, sf_dir))


def _text_pairs(df: DataFrame) -> DataFrame:
    """Vectors as text, which compares alike everywhere."""
    return df.select(F.col("key").alias("doc_id"), F.array_join("terms", " ").alias("terms"), F.array_join(F.col("tfs").cast("array<string>"), " ").alias("tfs"), "doc_len")


def tf_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.transform(F.map_entries("counts"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return bags.as_map(_own(spark, sf_dir)).select(F.col("key").alias("doc_id"), F.array_join(entries, " ").alias("counts"))


def tf_set_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'the' set to 3 and 'of' to 0 in every document."""
    new = keys_of(index_of(spark, sf_dir)).select("key", F.explode(F.create_map(F.lit("the"), F.lit(3), F.lit("of"), F.lit(0))).alias("term", "tf"))
    return named(bags.set_counts(_own(spark, sf_dir), new.withColumn("tf", F.col("tf").cast("long"))))


def tf_coded(engine, decode: bool) -> Query:  # noqa: ANN001
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        coded = engine.encode(F.col("tf"))
        value = engine.decode(coded) if decode else coded
        return _own(spark, sf_dir).select(F.col("key").alias("doc_id"), "term", value.alias("value"))

    return query


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bags written as Parquet, that as JSON, and read again. A bag is a row of its terms and their counts."""
    path = new_path(spark, "bags")
    folded_documents(spark, sf_dir).select("key", "terms", "tfs").write.parquet(f"{path}/parquet")
    own = spark.read.parquet(f"{path}/parquet")
    own.write.json(f"{path}/json")
    return named(bags.unfolded(bags.checked_folded(spark.read.schema(own.schema).json(f"{path}/json"))))


def event_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are terms already: event types of each user."""
    return bags.from_rows(table(spark, sf_dir, "events"), "user_id", "event_type")


QUERIES: dict[str, Query] = {
    "tf_postings": lambda s, d: named(_own(s, d)),
    "tf_events": lambda s, d: event_bags(s, d).withColumnRenamed("key", "user_id"),
    "doc_stats": lambda s, d: named(index_of(s, d).docs),
    "tf_sub_terms": lambda s, d: named(bags.subtract(_own(s, d), benchmark_bags(s, d))),
    "tf_set_count": tf_set_count,
    "tf_merge": lambda s, d: named(bags.unfolded(bags.add_folded(folded_documents(s, d), folded_turns(s, d)))),
    "tf_scale": lambda s, d: named(bags.scale(_own(s, d), 0.3)),
    "tf_from_corpus": lambda s, d: bags.from_corpus(index_of(s, d).corpus.terms).select("term", "tf"),
    "tf_map": tf_map,
    "tf_vector": lambda s, d: _text_pairs(bags.as_vector(_own(s, d))),
    "tf_lookup": lambda s, d: named(bags.term_count(_own(s, d), keys_of(index_of(s, d)), "the")),
    "tf_most_frequent": lambda s, d: named(bags.most_frequent_folded(folded_documents(s, d))),
    "tf_max_count": lambda s, d: named(bags.statistics_folded(folded_documents(s, d)), "doc_id", "max_tf"),
    "tf_contains": lambda s, d: named(bags.contains_term(_own(s, d), keys_of(index_of(s, d)), "the")),
    "tf_term_set": lambda s, d: bags.term_set(_own(s, d)).select(F.col("key").alias("doc_id"), F.array_join("terms", " ").alias("terms")),
    "tf_stopwords": lambda s, d: named(bags.remove_terms(_own(s, d), STOP)),
    "tf_stopwords_removed": lambda s, d: named(bags.removed_total(_own(s, d), STOP)),
    "tf_remove_by": lambda s, d: named(bags.remove_by(_own(s, d), (F.col("tf") < 2) | (F.length("term") > 12))),
    "tf_sorted_freq": lambda s, d: named(bags.sorted_by_count_folded(folded_documents(s, d))),
    "tf_sorted_dict": lambda s, d: named(bags.sorted_by_term_folded(folded_documents(s, d))),
    "tf_unique_ratio": lambda s, d: named(bags.statistics_folded(folded_documents(s, d)), "doc_id", "unique_ratio"),
    "tf_probability": lambda s, d: named(bags.probabilities(_own(s, d))),
    "tf_probability_term": lambda s, d: named(bags.probability(_own(s, d), keys_of(index_of(s, d)), "the")),
    "tf_encode_f16": tf_coded(F16, False),
    "tf_decode_f16": lambda s, d: named(index_of(s, d).with_engine(F16).decoded_all()),
    "tf_encode_u16": tf_coded(U16, False),
    "tf_encode_u32": tf_coded(U32, False),
    "tf_remove_by_total": lambda s, d: named(bags.removed_total(_own(s, d), (F.col("tf") < 2) | (F.length("term") > 12))),
    "tf_roundtrip": round_trip,
    "tf_empty": lambda s, d: named(bags.unfolded(bags.add_folded(folded_documents(s, d), bags.fold(bags.empty(s))))),
}

_P = INDEX_SQL
_BENCH = _P + ", " + tokens_sql("benchmark", "item_id", "bench")
_TURNS = _P + ", " + tokens_sql("conversations", "conv_id", "turns")
#: Terms of a text for which a test holds, counted without a join.
_COUNT = "len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: {test}))"

ORACLES: dict[str, str] = {
    "tf_postings": _P + " SELECT key AS doc_id, term, tf FROM post",
    "tf_events": "SELECT user_id, event_type AS term, CAST(count(*) AS BIGINT) AS tf FROM events GROUP BY user_id, event_type",
    "doc_stats": _P + " SELECT key AS doc_id, doc_len, n_terms FROM docs",
    "tf_sub_terms": _BENCH
    + """ SELECT key AS doc_id, term, CAST(post.tf - coalesce(bench.tf, 0) AS BIGINT) AS tf
FROM post LEFT JOIN bench USING (key, term) WHERE post.tf > coalesce(bench.tf, 0)""",
    "tf_set_count": _P
    + """ SELECT key AS doc_id, term, tf FROM post WHERE term NOT IN ('the', 'of')
UNION ALL SELECT key, 'the', CAST(3 AS BIGINT) FROM docs""",
    "tf_merge": _TURNS
    + """ SELECT key AS doc_id, term, CAST(sum(tf) AS BIGINT) AS tf
FROM (SELECT * FROM post UNION ALL SELECT * FROM turns) GROUP BY key, term""",
    "tf_scale": _P + " SELECT key AS doc_id, term, CAST(round(tf * 0.3::DOUBLE) AS BIGINT) AS tf FROM post",
    "tf_from_corpus": _P + " SELECT term, df AS tf FROM corpus",
    "tf_map": _P + " SELECT key AS doc_id, string_agg(term || ':' || tf, ' ' ORDER BY term) AS counts FROM post GROUP BY key",
    "tf_vector": _P
    + """ SELECT key AS doc_id, string_agg(term, ' ' ORDER BY term) AS terms,
  string_agg(CAST(tf AS VARCHAR), ' ' ORDER BY term) AS tfs, CAST(sum(tf) AS BIGINT) AS doc_len FROM post GROUP BY key""",
    "tf_lookup": f"SELECT doc_id, CAST({_COUNT.format(test="t = 'the'")} AS BIGINT) AS tf FROM documents",
    "tf_most_frequent": _P
    + """ SELECT key AS doc_id, term, tf FROM (SELECT *, max(tf) OVER (PARTITION BY key) AS top FROM post) WHERE tf = top""",
    "tf_max_count": _P + " SELECT key AS doc_id, max(tf) AS max_tf FROM post GROUP BY key",
    "tf_contains": _P + " SELECT key AS doc_id, key IN (SELECT key FROM post WHERE term = 'the') AS has FROM docs",
    "tf_term_set": _P + " SELECT key AS doc_id, string_agg(term, ' ' ORDER BY term) AS terms FROM post GROUP BY key",
    "tf_stopwords": _P + f" SELECT key AS doc_id, term, tf FROM post WHERE term NOT IN {STOP_SQL}",
    "tf_stopwords_removed": _P + f" SELECT key AS doc_id, CAST(sum(tf) AS BIGINT) AS removed FROM post WHERE term IN {STOP_SQL} GROUP BY key",
    "tf_remove_by": _P + " SELECT key AS doc_id, term, tf FROM post WHERE tf >= 2 AND length(term) <= 12",
    "tf_sorted_freq": _P
    + """ SELECT key AS doc_id, term, tf, CAST(row_number() OVER (PARTITION BY key ORDER BY tf DESC, term) AS INTEGER) AS place FROM post""",
    "tf_sorted_dict": _P
    + """ SELECT key AS doc_id, term, tf, CAST(row_number() OVER (PARTITION BY key ORDER BY term) AS INTEGER) AS place FROM post""",
    "tf_unique_ratio": _P + " SELECT key AS doc_id, round(n_terms / doc_len, 6) AS unique_ratio FROM docs WHERE doc_len > 0",
    "tf_probability": _P + " SELECT key AS doc_id, term, round(tf / sum(tf) OVER (PARTITION BY key), 6) AS probability FROM post",
    "tf_probability_term": f"""SELECT doc_id, round(coalesce({_COUNT.format(test="t = 'the'")} / nullif({_COUNT.format(test="t <> ''")}, 0), 0), 6) AS probability
FROM documents""",
    "tf_encode_f16": _P + HALF_SQL + " SELECT key AS doc_id, term, h AS value FROM half",
    "tf_decode_f16": _P + HALF_SQL + " SELECT key AS doc_id, term, CAST(floor(h * h) AS BIGINT) AS tf FROM half WHERE floor(h * h) > 0",
    "tf_encode_u32": _P + " SELECT key AS doc_id, term, CAST(tf % 4294967296 AS BIGINT) AS value FROM post",
    "tf_remove_by_total": _P + " SELECT key AS doc_id, CAST(sum(tf) AS BIGINT) AS removed FROM post WHERE tf < 2 OR length(term) > 12 GROUP BY key",
    "tf_roundtrip": _P + " SELECT key AS doc_id, term, tf FROM post",
    "tf_empty": _P + " SELECT key AS doc_id, term, tf FROM post",
    "tf_encode_u16": _P + " SELECT key AS doc_id, term, CAST(tf % 65536 AS BIGINT) AS value FROM post",
}
