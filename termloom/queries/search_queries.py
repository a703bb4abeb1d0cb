"""Queries of boolean and ranked search, and of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.weights import F16, LogEngine
from termloom.operators import hits
from termloom.operators.batch import batch_search
from termloom.operators.search import BM25, Algorithm, Contains, Cosine, Dot, search, similarity
from termloom.plans.query import Everything, Nothing, Term, all_of, any_of, parse
from termloom.plans.query import Query as Tree
from termloom.queries.base import INDEX_SQL, Query, benchmark_bags, index_of, named, tokens_sql

THE, EDEN, IS, AND = Term("the"), Term("eden"), Term("is"), Term("and")
BAG = {"the": 2, "eden": 1, "zzzz": 1}
MIXED = (THE & EDEN) | ~IS


def matching(tree: Tree) -> Query:
    """Keys of the documents that match."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return named(search(index_of(spark, sf_dir), Dot(), tree), "doc_id")

    return query


def ranked(algorithm: Algorithm, tree: Tree, digits: int = 6) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = search(index_of(spark, sf_dir), algorithm, tree)
        return found.select(F.col("key").alias("doc_id"), F.round("score", digits).alias("score"), "doc_len")

    return query


def like_bag(algorithm: Algorithm, tree: Tree | None = None, digits: int = 6) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = similarity(index_of(spark, sf_dir), algorithm, BAG, tree)
        return found.select(F.col("key").alias("doc_id"), F.round("score", digits).alias("score"), "doc_len")

    return query


def rounded_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(index_of(spark, sf_dir), BM25(), THE | EDEN)
    return found.withColumn("score", F.round("score", 6))


def placed(df: DataFrame, column: str = "key") -> DataFrame:
    """Sorted hits as they are, keys as doc_id."""
    return df.withColumnRenamed(column, "doc_id")


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits whose key is a source and an id, those of one source first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    found = rounded_bm25(spark, sf_dir).join(docs, F.col("key") == F.col("doc_id"))
    found = found.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("key"), "score", "doc_len")
    return hits.sort_by_title(found, "src1").withColumnRenamed("key", "title")


def batch(algorithm: Dot | Cosine | BM25, digits: int) -> Query:
    """For every benchmark passage, the ten best documents."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        queries = benchmark_bags(spark, sf_dir).select(F.col("key").alias("query"), "term", F.col("tf").alias("q"))
        found = batch_search(index_of(spark, sf_dir), algorithm, queries, 10, digits)
        return found.select("query", F.col("key").alias("doc_id"), "score", "place")

    return query


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of a tree, those under a negation too, as often as they stand there."""
    return spark.createDataFrame([(t,) for t in (MIXED & (THE | ~EDEN)).leaves()], "term string").groupBy("term").agg(F.count(F.lit(1)).alias("times"))


def custom_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_of(spark, sf_dir).with_engine(LogEngine())
    return search(index, Dot(), THE | EDEN).select(F.col("key").alias("doc_id"), F.round("score", 2).alias("score"), "doc_len")


def half_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(search(index_of(spark, sf_dir).with_engine(F16), Cosine(), THE & EDEN))


QUERIES: dict[str, Query] = {
    "bool_none": matching(Nothing()),
    "bool_all": matching(Everything()),
    "bool_term": matching(EDEN),
    "bool_not": matching(~THE),
    "bool_and": matching(THE & EDEN),
    "bool_or": matching(THE | EDEN),
    "bool_mixed": matching(MIXED),
    "bool_freq_or": matching(any_of(["eden", "ates", "zzzz"])),
    "bool_freq_and": matching(all_of(["the", "of", "and"])),
    "bool_parsed": matching(parse("[the & eden] | !is")),
    "search_contains": ranked(Contains(), THE & EDEN),
    "search_dot": ranked(Dot(), THE | EDEN, 4),
    "search_cosine": ranked(Cosine(), THE | EDEN),
    "search_cosine_not": ranked(Cosine(), THE & ~EDEN),
    "search_cosine_f16": half_cosine,
    "search_bm25": ranked(BM25(), THE | EDEN),
    "search_bm25_mixed": ranked(BM25(), MIXED),
    "custom_engine": custom_engine,
    "similarity_dot": like_bag(Dot(), None, 4),
    "similarity_cosine": like_bag(Cosine()),
    "similarity_bm25": like_bag(BM25()),
    "similarity_filtered": like_bag(Cosine(), ~IS),
    "similarity_batch": batch(Dot(), 2),
    "similarity_batch_cosine": batch(Cosine(), 6),
    "similarity_batch_bm25": batch(BM25(), 6),
    "query_leaves": leaves,
    "hits_counts": lambda s, d: hits.counts(search(index_of(s, d), Cosine(), ~THE | EDEN)),
    "hits_sort_asc": lambda s, d: placed(hits.sort_by_score(rounded_bm25(s, d), ascending=True)),
    "hits_sort_desc": lambda s, d: placed(hits.sort_by_score(rounded_bm25(s, d))),
    "hits_sort_by": lambda s, d: placed(hits.sort_by(rounded_bm25(s, d), F.desc("doc_len"), "key")),
    "hits_title_sort": titled,
    "hits_display": lambda s, d: hits.display(hits.sort_by_score(rounded_bm25(s, d))),
    "hits_display_short": lambda s, d: hits.display(hits.sort_by_score(rounded_bm25(s, d)), digits=2),
    "topk_bm25": lambda s, d: placed(hits.top_k(hits.sort_by_score(rounded_bm25(s, d)), 10)),
}

_P = INDEX_SQL


def _flags(condition: str, terms: list[str]) -> str:
    """Keys of the documents for which a condition over has_<term> holds."""
    flags = ", ".join(f"coalesce(bool_or(term = '{t}'), false) AS has_{t}" for t in terms)
    return f"""flags AS (
  SELECT docs.key, any_value(doc_len) AS doc_len, {flags} FROM docs LEFT JOIN post ON docs.key = post.key GROUP BY docs.key
), candidates AS (SELECT key, doc_len FROM flags WHERE {condition})"""


def _matching(condition: str, terms: list[str]) -> str:
    return f"{_P}, {_flags(condition, terms)} SELECT key AS doc_id FROM candidates"


def _ranked(algorithm: str, condition: str, bag: dict[str, int], digits: int = 6, leaves: list[str] | None = None) -> str:
    rows = ", ".join(f"('{t}', {n})" for t, n in bag.items())
    parts = {
        "dot": ("tf * q * CAST(idf AS DOUBLE) * CAST(idf AS DOUBLE)", "s"),
        "cosine": ("tf * q * CAST(idf AS DOUBLE) * CAST(idf AS DOUBLE)", "s / (qn * coalesce(norm, 0) + 2.220446049250313e-16)"),
        "bm25": (
            "CAST(CAST(ln(CAST(idf AS DOUBLE)) AS FLOAT) AS DOUBLE) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (doc_len / mean_len)))",
            "s",
        ),
    }
    part, score = parts[algorithm]
    return f"""{_P}, bag(term, q) AS (VALUES {rows}), {_flags(condition, leaves or list(bag))},
sums AS (SELECT post.key, sum({part}) AS s FROM post JOIN idf USING (term) JOIN bag USING (term) JOIN docs ON docs.key = post.key, facts GROUP BY post.key),
qs AS (SELECT sqrt(sum(pow(q * CAST(idf AS DOUBLE), 2))) AS qn FROM bag JOIN idf USING (term)),
scored AS (
  SELECT candidates.key, doc_len, coalesce(s, 0) AS s, qn, norm
  FROM candidates LEFT JOIN sums ON sums.key = candidates.key LEFT JOIN norms ON norms.key = candidates.key, qs
)
SELECT key AS doc_id, round({score}, {digits}) AS score, doc_len FROM scored"""


def _batch(score: str, digits: int) -> str:
    return f"""{_P}, {tokens_sql("benchmark", "item_id", "bench")}, lengths AS (
  SELECT key, sqrt(sum(pow(tf * CAST(idf AS DOUBLE), 2))) AS qn FROM bench JOIN idf USING (term) GROUP BY key
), scores AS (
  SELECT bench.key AS query, post.key AS doc_id, round({score}, {digits}) AS score
  FROM bench JOIN post USING (term) JOIN idf USING (term) JOIN norms ON norms.key = post.key JOIN docs ON docs.key = post.key
    JOIN lengths ON lengths.key = bench.key, facts
  GROUP BY bench.key, post.key
)
SELECT query, doc_id, score, CAST(place AS INTEGER) AS place
FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS place FROM scores) WHERE place <= 10"""


_PAIR = {"the": 1, "eden": 1}
_EITHER = "has_the OR has_eden"
_BM25 = _ranked("bm25", _EITHER, _PAIR)
_IN_BAG = {"the": 2, "eden": 1, "zzzz": 1}

ORACLES: dict[str, str] = {
    "bool_none": "SELECT doc_id FROM documents WHERE false",
    "bool_all": "SELECT doc_id FROM documents",
    "bool_term": _matching("has_eden", ["eden"]),
    "bool_not": _matching("NOT has_the", ["the"]),
    "bool_and": _matching("has_the AND has_eden", ["the", "eden"]),
    "bool_or": _matching(_EITHER, ["the", "eden"]),
    "bool_mixed": _matching("(has_the AND has_eden) OR NOT has_is", ["the", "eden", "is"]),
    "bool_freq_or": _matching("has_eden OR has_ates OR has_zzzz", ["eden", "ates", "zzzz"]),
    "bool_freq_and": _matching("has_the AND has_of AND has_and", ["the", "of", "and"]),
    "bool_parsed": _matching("(has_the AND has_eden) OR NOT has_is", ["the", "eden", "is"]),
    "search_contains": f"{_P}, {_flags(_EITHER, ['the', 'eden'])} SELECT key AS doc_id, 1.0::DOUBLE AS score, doc_len FROM candidates",
    "search_dot": _ranked("dot", _EITHER, _PAIR, 4),
    "search_cosine": _ranked("cosine", _EITHER, _PAIR),
    "search_cosine_not": _ranked("cosine", "has_the AND NOT has_eden", _PAIR),
    "search_bm25": _BM25,
    "search_bm25_mixed": _ranked("bm25", "(has_the AND has_eden) OR NOT has_is", _PAIR | {"is": 1}),
    "custom_engine": f"""{_P}, bag(term) AS (VALUES ('the'), ('eden'))
SELECT key AS doc_id, round(sum(floor(round((1.0::DOUBLE + ln(tf)) * 1000)) * 1000 * CAST(idf AS DOUBLE) * CAST(idf AS DOUBLE)), 2) AS score,
       any_value(doc_len) AS doc_len
FROM post JOIN idf USING (term) JOIN bag USING (term) JOIN docs USING (key) GROUP BY key""",
    "similarity_dot": _ranked("dot", f"{_EITHER} OR has_zzzz", _IN_BAG, 4),
    "similarity_cosine": _ranked("cosine", f"{_EITHER} OR has_zzzz", _IN_BAG),
    "similarity_bm25": _ranked("bm25", f"{_EITHER} OR has_zzzz", _IN_BAG),
    "similarity_filtered": _ranked("cosine", "NOT has_is", _IN_BAG, 6, ["is"]),
    "similarity_batch": _batch("sum(bench.tf * post.tf * CAST(idf AS DOUBLE) * CAST(idf AS DOUBLE))", 2),
    "similarity_batch_cosine": _batch(
        "sum(bench.tf * post.tf * CAST(idf AS DOUBLE) * CAST(idf AS DOUBLE)) / (any_value(qn) * any_value(norm) + 2.220446049250313e-16)", 6
    ),
    "similarity_batch_bm25": _batch(
        "sum(CAST(CAST(ln(CAST(idf AS DOUBLE)) AS FLOAT) AS DOUBLE) * (post.tf * 2.2::DOUBLE) / (post.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (doc_len / mean_len))))", 6
    ),
    "query_leaves": "SELECT term, CAST(times AS BIGINT) AS times FROM (VALUES ('the', 2), ('eden', 2), ('is', 1)) leaves(term, times)",
    "hits_counts": f"""SELECT CAST(count(*) FILTER (WHERE score <> 0) AS BIGINT) AS non_zero, CAST(count(*) FILTER (WHERE score = 0) AS BIGINT) AS zero,
  CAST(0 AS BIGINT) AS nan FROM ({_ranked("cosine", "NOT has_the OR has_eden", _PAIR, 12)})""",
    "hits_sort_asc": _BM25,
    "hits_sort_desc": _BM25,
    "hits_sort_by": _BM25,
    "hits_title_sort": f"""SELECT source || '/' || h.doc_id AS title, score, doc_len FROM ({_BM25}) h JOIN documents USING (doc_id)""",
    "hits_display": f"""SELECT printf('score: %.6f', score) || chr(9) || 'doc_len: ' || doc_len || chr(9) || 'key: "' || doc_id || '"' AS line FROM ({_BM25})""",
    "hits_display_short": f"""SELECT printf('score: %.2f', score) || chr(9) || 'doc_len: ' || doc_len || chr(9) || 'key: "' || doc_id || '"' AS line FROM ({_BM25})""",
    "topk_bm25": f"SELECT * FROM ({_BM25}) ORDER BY score DESC, doc_id LIMIT 10",
    "snapshot_roundtrip": _ranked("bm25", "has_the OR has_and", {"the": 1, "and": 1}),
}
_HALF_TF = "floor(pow(round_even(CAST(CAST(sqrt(CAST(tf AS FLOAT)) AS FLOAT) AS DOUBLE) / u, 0) * u, 2))"
ORACLES["search_cosine_f16"] = f"""{_P}, coded AS (
  SELECT key, term, {_HALF_TF} AS d FROM (
    SELECT key, term, tf, pow(2.0, floor(log2(CAST(CAST(sqrt(CAST(tf AS FLOAT)) AS FLOAT) AS DOUBLE))) - 10) AS u FROM post)
), lengths AS (SELECT key, sqrt(sum(pow(d * CAST(idf AS DOUBLE), 2))) AS norm FROM coded JOIN idf USING (term) GROUP BY key),
bag(term) AS (VALUES ('the'), ('eden')),
qs AS (SELECT sqrt(sum(pow(CAST(idf AS DOUBLE), 2))) AS qn FROM bag JOIN idf USING (term))
SELECT key AS doc_id, round(sum(d * CAST(idf AS DOUBLE) * CAST(idf AS DOUBLE)) / (any_value(qn) * any_value(norm) + 2.220446049250313e-16), 6) AS score,
  any_value(doc_len) AS doc_len
FROM coded JOIN idf USING (term) JOIN bag USING (term) JOIN lengths USING (key) JOIN docs USING (key), qs
GROUP BY key HAVING count(*) = 2"""
