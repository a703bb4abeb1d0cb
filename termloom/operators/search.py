"""Ranked search: which documents match, and how near they are to the query's bag of terms."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.plans.query import Query, any_of
from termloom.sources.index import Index, Weights

#: Fixed value that keeps a cosine's divisor above zero.
EPSILON = 2.220446049250313e-16


@dataclass(frozen=True)
class Contains:
    """Every document with any of the bag's terms, at score 1. Boolean structure and filters are passed over."""


@dataclass(frozen=True)
class Dot:
    """Sum over common terms of query count, document count and squared idf."""


@dataclass(frozen=True)
class Cosine:
    """Dot over the product of the weighted vectors' lengths."""


@dataclass(frozen=True)
class BM25:
    """Okapi BM25 on the logarithm of idf, which is negative for terms that nearly all documents have. The query's
    counts do not matter."""

    k1: float = 1.2
    b: float = 0.75


Algorithm = Contains | Dot | Cosine | BM25


def search(index: Index, algorithm: Algorithm, query: Query, check: bool = True) -> DataFrame:
    """Hits (key, score, doc_len) of the documents that match the query, scored by the bag of all its leaf terms,
    also negated ones."""
    return similarity(index, algorithm, query.bag(), query, check)


def similarity(index: Index, algorithm: Algorithm, bag: dict[str, int], query: Query | None = None, check: bool = True) -> DataFrame:
    """Hits of a weighted bag. Without a query, documents with any of its terms are candidates; a query takes the
    place of that, so that documents without common terms may be hits at score 0.

    Weights follow the corpus. With ``check=False`` they are those that the index was frozen with, if it was; a term
    that has come since weighs nothing then. What matches, and the documents' mean length, is as it is now."""
    if isinstance(algorithm, Contains) or query is None:
        query = any_of(sorted(bag))
    return _scored(index, algorithm, bag, query, None if check else index.frozen)


def _bm25(index: Index, algorithm: BM25, tf: Column, idf: Column, doc_len: Column) -> Column:
    share = doc_len / F.lit(index.mean_len) if index.mean_len else F.lit(0.0)
    divisor = tf + F.lit(algorithm.k1) * (F.lit(1.0 - algorithm.b) + F.lit(algorithm.b) * share)
    weight = F.ln(idf).cast("float").cast("double")
    part = weight * (tf * F.lit(algorithm.k1 + 1.0)) / F.nullif(divisor, F.lit(0.0))
    return F.when(divisor == 0, F.lit(float("nan"))).otherwise(part)


def _local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of literals, which Spark evaluates and broadcasts without a job."""
    names, types = zip(*(field.split() for field in schema.split(", ")), strict=True)
    if not rows:
        return spark.createDataFrame([], schema)
    width = len(types)
    args = {f"p{i}": v for i, v in enumerate(v for row in rows for v in row)}
    cells = [f"CAST(:p{i} AS {types[i % width]})" for i in range(len(args))]
    values = ", ".join(f"({', '.join(cells[i : i + width])})" for i in range(0, len(cells), width))
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})", args=args)


def _scored(index: Index, algorithm: Algorithm, bag: dict[str, int], query: Query, frozen: Weights | None = None) -> DataFrame:
    spark = index.docs.sparkSession
    leaves = sorted(set(query.leaves()))
    terms = sorted(set(leaves) | set(bag))
    rows = [(t, bag.get(t, 0), df) for t, df in index.known(terms).items()]
    coded = _local(spark, rows, "term string, q long, df long")
    idf = index.engine.idf(F.lit(index.corpus.doc_num), F.col("df")).cast("double")
    weights = [tuple(r) for r in coded.select("term", index.read_tf(F.col("q")).cast("double"), idf).collect()]
    if frozen:
        held = frozen.of(terms)
        weights = [(t, q, held.get(t, 0.0)) for t, q, _ in weights]
    # As many rows as the query has terms.
    asked = F.broadcast(_local(spark, weights, "term string, q double, w double"))
    found = index.of_terms([w[0] for w in weights]).join(asked, "term")
    tf, doc_len = index.read_tf(F.col("tf")).cast("double"), F.col("doc_len")
    if isinstance(algorithm, BM25):
        part = F.when(F.col("term").isin(sorted(bag)) & (F.col("w") > 0), _bm25(index, algorithm, tf, F.col("w"), doc_len)).otherwise(0.0)
    else:
        part = F.col("q") * tf * F.col("w") * F.col("w")
    flags = {t: f"has_{i}" for i, t in enumerate(leaves)}
    wanted = [F.bool_or(F.col("term") == t).alias(flags[t]) for t in leaves]
    sums = [F.sum(part).alias("sum"), F.max("doc_len").alias("doc_len")]
    normed = index.normed and not frozen
    if isinstance(algorithm, Cosine) and normed:
        sums.append(F.max("norm").alias("norm"))
    matched = found.groupBy("key").agg(*sums, *wanted)
    if query.matches_nothing_known():
        matched = index.docs.select("key", "doc_len").join(matched.drop("doc_len"), "key", "left")
    hits = matched.where(query.column(lambda t: F.coalesce(F.col(flags[t]), F.lit(False))))
    score = F.coalesce("sum", F.lit(0.0))
    if isinstance(algorithm, Contains):
        score = F.lit(1.0)
    if isinstance(algorithm, Cosine):
        if not normed:
            hits = hits.join(index.norms(frozen), "key", "left")
        length = math.sqrt(sum((q * w) ** 2 for _, q, w in weights))
        score = score / (F.lit(length) * F.coalesce("norm", F.lit(0.0)) + F.lit(EPSILON))
    return hits.select("key", score.alias("score"), "doc_len")
