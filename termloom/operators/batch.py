"""Ranked search of many weighted bags at once.

Each task goes through its documents, adds up the scores of all queries over a few thousand documents at a time as one
dense array, and keeps the best ``k`` of each query; only these leave the task. Postings are not shuffled, and no row
is made for a pair of a query and a document. Built-in operators have no such top k within a join and aggregation,
hence Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.operators.search import BM25, EPSILON, Cosine, Dot
from termloom.sources.index import Index
from termloom.sources.workspace import new_path

#: Terms of queries, over all queries of a block, that are sent to the executors at once.
BLOCK_TERMS = 1 << 20
#: Scores, and parts of scores, that a task holds at a time: some ten arrays of so many numbers.
CELLS, PARTS = 1 << 19, 1 << 19
#: Terms of documents that are looked up at a time.
LOOKED_UP = 1 << 18


@dataclass
class Batch:
    """Queries by term: those of term t are ``query[ends[t]:ends[t + 1]]``, with the factor that the count in a
    document is multiplied with."""

    names: pa.Array
    lengths: np.ndarray
    terms: pa.Array
    ends: np.ndarray
    query: np.ndarray
    factor: np.ndarray

    @staticmethod
    def of(rows: pa.Table, bm25: bool) -> Batch:
        names = rows.column("query").combine_chunks().dictionary_encode()
        terms = rows.column("term").combine_chunks().dictionary_encode()
        of_query, of_term = (c.indices.to_numpy(zero_copy_only=False) for c in (names, terms))
        q, w, log = (rows.column(c).to_numpy() for c in ("q", "w", "log"))
        order = np.argsort(of_term, kind="stable")
        lengths = np.sqrt(np.bincount(of_query, (q * w) ** 2, minlength=len(names.dictionary)))
        ends = np.concatenate([[0], np.cumsum(np.bincount(of_term, minlength=len(terms.dictionary)))])
        return Batch(names.dictionary, lengths, terms.dictionary, ends, of_query[order], (log if bm25 else q * w * w)[order])


class Best:
    """The best ``k`` documents of each query so far: score descending, then key."""

    def __init__(self, queries: int, k: int) -> None:
        self.rows: list[list[tuple]] = [[] for _ in range(queries)]
        self.k = k

    def take(self, scores: np.ndarray, keys: list, lengths: np.ndarray) -> None:
        """``scores``: array (queries, documents), minus infinity where they have no common term."""
        k = self.k
        count = scores.shape[1]
        least = np.partition(scores, count - k, axis=1)[:, count - k] if k < count else np.full(len(scores), -np.inf)
        for query, floor in enumerate(least.tolist()):
            own = self.rows[query]
            if len(own) == k:
                floor = max(floor, own[-1][3])
            found = np.flatnonzero((scores[query] >= floor) & (scores[query] > -np.inf))
            if len(found):
                own += [(-scores[query, i], keys[i], int(lengths[i]), float(scores[query, i])) for i in found.tolist()]
                own.sort(key=lambda r: r[:2])
                del own[k:]


def _pieces(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows that have ``LOOKED_UP`` terms together at most, or one row of more."""
    ends = part.column("terms").offsets.to_numpy().astype(np.int64)
    start = 0
    while start < part.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + LOOKED_UP, side="right")) - 1)
        yield part.slice(start, end - start)
        start = end


def _scores(batch: Batch, algorithm: Dot | Cosine | BM25, mean_len: float, part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int, int]]:
    """Scores of a run of documents at a time, and where the run starts and ends."""
    queries = len(batch.names)
    lists = part.column("terms")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    at = pc.index_in(lists.flatten(), value_set=batch.terms)
    known = np.flatnonzero(pc.is_valid(at).to_numpy(zero_copy_only=False))
    term = at.take(pa.array(known)).to_numpy(zero_copy_only=False)
    tf = part.column("tfs").flatten().to_numpy(zero_copy_only=False)[known]
    doc = np.searchsorted(offsets, known, side="right") - 1
    lengths = part.column("doc_len").to_numpy()
    if isinstance(algorithm, BM25):
        share = lengths[doc] / mean_len if mean_len else 0.0
        tf = tf * (algorithm.k1 + 1.0) / (tf + algorithm.k1 * (1.0 - algorithm.b + algorithm.b * share))
    number = np.diff(batch.ends)[term]
    before = np.concatenate([[0], np.cumsum(number)])
    first = np.searchsorted(doc, np.arange(part.num_rows + 1))  # each document's postings
    start = 0
    while start < part.num_rows:
        end = min(part.num_rows, start + max(1, CELLS // max(1, queries)))
        fits = np.searchsorted(before[first], before[first[start]] + PARTS, side="right") - 1
        end = max(start + 1, min(end, int(fits)))
        lo, hi = first[start], first[end]
        times = number[lo:hi]
        which = np.repeat(batch.ends[term[lo:hi]] - (before[lo:hi] - before[lo]), times) + np.arange(before[hi] - before[lo])
        cell = batch.query[which] * (end - start) + np.repeat(doc[lo:hi] - start, times)
        size = queries * (end - start)
        score = np.bincount(cell, np.repeat(tf[lo:hi], times) * batch.factor[which], minlength=size).reshape(queries, -1)
        if isinstance(algorithm, Cosine):
            norms = part.column("norm").to_numpy()[start:end]
            score /= batch.lengths[:, None] * norms[None, :] + EPSILON
        apart = np.ones(size, dtype=bool)
        apart[cell] = False
        score[apart.reshape(queries, -1)] = -np.inf
        yield score, start, end
        start = end


def batch_search(index: Index, algorithm: Dot | Cosine | BM25, queries: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """For each query the best ``k`` documents: (query, key, score, doc_len, place), place from 1.

    ``queries`` has rows (query, term, q), a term once in a query. Scores are those of ``similarity``, with ``digits``
    rounded before they are ranked; ties go to the smaller key. Documents without a common term are no candidates. The
    queries' terms are sent to all executors in blocks of ``BLOCK_TERMS``; more of them take more passes."""
    spark = queries.sparkSession
    idf = F.col("idf").cast("double")
    log = F.when(idf > 0, F.ln(idf).cast("float").cast("double")).otherwise(0.0)
    weighed = queries.join(index.idf(), "term").select("query", "term", index.read_tf(F.col("q")).cast("double").alias("q"), idf.alias("w"), log.alias("log"))
    path = new_path(spark, "batch")
    weighed.write.parquet(path)
    weighed = spark.read.parquet(path)
    blocks = max(1, -(-weighed.count() // BLOCK_TERMS))
    block = F.pmod(F.xxhash64("query"), F.lit(blocks))
    documents = index.forward
    if isinstance(algorithm, Cosine) and not index.normed:
        documents = documents.drop("norm").join(index.norms(), "key", "left")
    norm = [F.coalesce("norm", F.lit(0.0)).alias("norm")] if isinstance(algorithm, Cosine) else []
    documents = documents.select("key", "terms", F.transform("tfs", lambda t: index.read_tf(t).cast("double")).alias("tfs"), "doc_len", *norm)
    kinds = {c: queries.schema["query"].dataType.simpleString() if c == "query" else documents.schema["key"].dataType.simpleString() for c in ("query", "key")}
    schema = f"query {kinds['query']}, key {kinds['key']}, score double, doc_len long"
    mean_len = index.mean_len
    found = None
    for number in range(blocks):  # of a bounded number of rows each
        batch = spark.sparkContext.broadcast(Batch.of(weighed.where(block == number).toArrow(), isinstance(algorithm, BM25)))

        def best(batches: Iterator[pa.RecordBatch], batch=batch) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            own = batch.value
            if not len(own.names):
                return
            kept = Best(len(own.names), k)
            for part in (piece for whole in batches for piece in _pieces(whole)):
                keys = part.column("key").to_pylist()
                for scores, a, b in _scores(own, algorithm, mean_len, part):
                    if digits is not None:
                        scores = np.round(scores, digits, out=scores)
                    kept.take(scores, keys[a:b], part.column("doc_len").to_numpy()[a:b])
            rows = [(query, r[1], r[3], r[2]) for query, held in enumerate(kept.rows) for r in held]
            if rows:
                query, key, score, doc_len = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([own.names.take(pa.array(query)), pa.array(key), pa.array(score), pa.array(doc_len)], names=["query", "key", "score", "doc_len"])

        part = documents.mapInArrow(best, schema)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
