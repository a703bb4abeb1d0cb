"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Words are runs of letters (lower-cased), of digits or of symbols, and each also gives a word for its case. Each of ``BUCKETS`` hashed words has a sparse random index vector. A word's vector is its index vector
plus the sum, over a bounded sample of labelled documents, of the index vectors near it, scaled to length one. A
document is the mean of its words' vectors with a few numbers on its length, spread and repeats. A two-layer numpy network
learns the label from the sample; a temperature, fitted on documents it has not learned from, calibrates its
probabilities.

Vectors are integers, so that a document's sum is exact however batches are cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from termloom.llm.common import crc32_mod, write_shared
from termloom.llm.words import Words, slices, split_words

BUCKETS, DIMENSIONS, NONZERO, NEAR = 1 << 13, 64, 8, 2
#: Vectors are integers: SCALE stands for one. No component is above SCALE * (1 + sqrt(NONZERO)), so a 32-bit float
#: holds the sum of PIECE of them exactly.
SCALE, PIECE = 64, 1 << 15
ROWS, CHUNK = 256, 1 << 14
#: What is set apart from letters: runs of digits and of symbols.
APART = r"(\p{N}+|[^\s\p{L}\p{N}]+)"


def index_vectors(seed: int = 6) -> np.ndarray:
    """Sparse random vectors of -1, 0 and 1, one per bucket."""
    rng = np.random.default_rng(seed)
    places = rng.random((BUCKETS, DIMENSIONS)).argsort(axis=1)[:, :NONZERO]
    vectors = np.zeros((BUCKETS, DIMENSIONS), np.int32)
    np.put_along_axis(vectors, places, rng.choice(np.array([-1, 1], np.int32), places.shape), axis=1)
    return vectors


def _case(run: str) -> str:
    if run.islower():
        return "lower"
    if run.isupper():
        return "upper" if len(run) > 1 else "capital"
    return "title" if run[0].isupper() and run[1:].islower() else "mixed"


def _bucket(kind: str, word: str) -> int:
    return zlib.crc32(f"{kind} {word}".encode("utf-8", "surrogatepass")) % BUCKETS


CASES = {case: _bucket("case", case) for case in ("lower", "upper", "capital", "title", "mixed", "none")}


def word_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word, and that of its case."""
    own, case = np.empty(len(words), np.int64), np.full(len(words), CASES["none"], np.int64)
    for i, word in enumerate(words):
        if word[0].isalpha():
            own[i] = _bucket("letters", word.lower())
            case[i] = CASES[_case(word)]
        else:
            own[i] = _bucket("digits", str(len(word))) if word[0].isnumeric() else _bucket("symbols", word)
    return own, case


def runs(texts: pa.Array) -> Words:
    """Words of texts: runs of letters, of digits and of symbols."""
    return split_words(pc.replace_substring_regex(pc.fill_null(texts, ""), APART, r" \1 "))


def pooled(words: Words, table: np.ndarray) -> np.ndarray:
    """A row per text: the mean vector, its length, the logarithm of the number of words, and the shares of
    different words and of words that repeat the one before. ``table`` has an integer vector per bucket."""
    own, case = word_buckets(words.unique)
    count = words.counts
    texts, sums, distinct = len(count), np.zeros((len(count), DIMENSIONS)), np.zeros(len(count))
    owner = np.repeat(np.arange(texts), count)
    place = np.arange(len(owner)) - np.repeat(words.offsets[:-1], count)
    piece = np.cumsum((place % PIECE == 0)) - 1  # a text's words in pieces of PIECE
    whose = owner[place % PIECE == 0]
    vectors = table.astype(np.float32)
    for a in range(0, len(whose), ROWS):
        lo, hi = np.searchsorted(piece, [a, a + ROWS])
        n = min(ROWS, len(whose) - a)
        row, index = (piece[lo:hi] - a) * BUCKETS, words.index[lo:hi]
        seen = np.bincount(row + own[index], minlength=n * BUCKETS).reshape(n, BUCKETS)
        np.add.at(distinct, whose[a : a + n], (seen > 0).sum(axis=1))
        seen += np.bincount(row + case[index], minlength=n * BUCKETS).reshape(n, BUCKETS)
        np.add.at(sums, whose[a : a + n], (seen.astype(np.float32) @ vectors).astype(np.float64))
    some = np.maximum(count, 1)
    mean = sums / (2.0 * SCALE * some)[:, None]
    norm = np.sqrt((mean * mean).sum(axis=1, keepdims=True))
    again = (np.diff(words.index) == 0) & (np.diff(owner) == 0)
    repeats = np.bincount(owner[1:][again], minlength=texts)
    return np.concatenate([mean, norm, np.stack([np.log1p(count) / 8, distinct / some, repeats / some], axis=1)], axis=1)


def context_sums(words: Words, index: np.ndarray) -> np.ndarray:
    """For each bucket, the sum of the index vectors of what stands near it in the texts."""
    own, _ = word_buckets(words.unique)
    stream = own[words.index]
    owner = np.repeat(np.arange(len(words.counts)), words.counts)
    out = np.zeros((BUCKETS, DIMENSIONS), np.int64)
    for gap in range(1, NEAR + 1):
        same = owner[gap:] == owner[:-gap]
        pair = np.concatenate([stream[gap:][same] * BUCKETS + stream[:-gap][same], stream[:-gap][same] * BUCKETS + stream[gap:][same]])
        pair, times = np.unique(pair, return_counts=True)
        for a in range(0, len(pair), CHUNK):
            word, near = np.divmod(pair[a : a + CHUNK], BUCKETS)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[first]] += np.add.reduceat(index[near] * times[a : a + CHUNK, None], first, axis=0)
    return out


@dataclass
class QualityModel:
    table: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float] | None
    shift: np.ndarray
    spread: np.ndarray
    temperature: float

    def logits(self, features: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.zeros(len(features))
        w1, b1, w2, b2 = self.layers
        hidden = np.maximum(0.0, ((features - self.shift) / self.spread) @ w1 + b1)
        return hidden @ w2 + b2

    def score(self, words: Words) -> np.ndarray:
        return sigmoid(self.logits(pooled(words, self.table)) / self.temperature)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def log_loss(logits: np.ndarray, labels: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0.0, logits) - labels * logits))


def train_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 6) -> tuple:
    """Two layers, by Adam on the logistic loss with a little weight decay."""
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, hidden), np.zeros(1)]
    first, second, step = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w], 0
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs) + 1e-5
        order = rng.permutation(len(x))
        for a in range(0, len(x), 128):
            at = order[a : a + 128]
            pre = x[at] @ w[0] + w[1]
            act = np.maximum(0.0, pre)
            error = (sigmoid(act @ w[2] + w[3]) - y[at]) / len(at)
            back = np.outer(error, w[2]) * (pre > 0)
            grads = [x[at].T @ back + 1e-4 * w[0], back.sum(axis=0), act.T @ error + 1e-4 * w[2], error.sum(keepdims=True)]
            step += 1
            for v, g, m, s in zip(w, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return w[0], w[1], w[2], float(w[3][0])


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """Temperature with the least log loss, on a grid of factors from 1/4 to 8."""
    grid = 2.0 ** np.linspace(-2, 3, 101)
    return float(min(grid, key=lambda t: log_loss(logits / t, labels)))


def fit_model(features: np.ndarray, labels: np.ndarray, calibrates: np.ndarray, table: np.ndarray) -> QualityModel:
    shift, spread = features.mean(axis=0), features.std(axis=0) + 1e-6
    learns = ~calibrates
    layers = train_network((features[learns] - shift) / spread, labels[learns])
    model = QualityModel(table, layers, shift, spread, 1.0)
    if calibrates.any():
        model.temperature = fit_temperature(model.logits(features[calibrates]), labels[calibrates])
    return model


def learn(docs: DataFrame, labels: DataFrame, folds: int, held_out_fold: int, sample_docs: int) -> QualityModel:
    """Learn from the ``sample_docs`` labelled documents, not held out, with the lowest hashes of their ids."""
    spark = docs.sparkSession
    index = index_vectors()
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
    marked = marked.agg(F.min("quality").cast("double").alias("label")).where(crc32_mod("doc_id", folds) != held_out_fold)
    hashed = marked.withColumn("pick", F.xxhash64("doc_id"))
    chosen = F.broadcast(hashed.sort("pick", "doc_id").limit(sample_docs))  # sample_docs rows of three numbers
    sample = docs.join(chosen, "doc_id").groupBy("doc_id", "pick", "label").agg(F.max("text").alias("text"))
    sample = write_shared(sample.coalesce(8), "quality-sample")  # 8 tasks: so many partial tables are summed in one

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((BUCKETS, DIMENSIONS), np.int64)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sums += context_sums(runs(part.column("text")), index)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS * DIMENSIONS, np.int64)
        for batch in batches:
            for part in batch.column("sums"):
                sums += np.frombuffer(part.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    # One table of 4 MB comes to the driver, and of each document one row of bytes.
    partial = sample.select("text").coalesce(8).mapInArrow(contexts, "sums binary")
    sums = np.zeros((BUCKETS, DIMENSIONS), np.int64)
    for row in partial.repartition(1).mapInArrow(added, "sums binary").collect():
        sums += np.frombuffer(row[0], np.int64).reshape(BUCKETS, DIMENSIONS)
    norms = np.sqrt((sums.astype(float) ** 2).sum(axis=1, keepdims=True))
    near = np.rint(sums * (SCALE * NONZERO**0.5) / np.maximum(norms, 1e-9))
    table = (index * SCALE + near).astype(np.int32)
    shared = spark.sparkContext.broadcast(table)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = pooled(runs(part.column("text")), shared.value)
                packed = pa.array([row.tobytes() for row in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("pick"), part.column("label"), packed], names=["pick", "label", "x"])

    rows = sorted(sample.select("pick", "label", "text").mapInArrow(features, "pick long, label double, x binary").collect())
    shared.destroy()
    if not rows:
        return QualityModel(table, None, np.zeros(1), np.ones(1), 1.0)
    pick = np.array([r[0] for r in rows], np.int64)
    return fit_model(np.array([np.frombuffer(r[2]) for r in rows]), np.array([r[1] for r in rows]), pick % 5 == 0, table)


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 4,
    held_out_fold: int = 2,
    threshold: float = 0.7,
    sample_docs: int = 10_000,
    keep_columns: bool = False,
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; with ``keep_columns``, the columns of ``docs``
    instead of doc_id, in a struct ``doc``.

    Labels of documents whose crc32 of the id, modulo ``folds``, is ``held_out_fold`` are not learned. A label
    given twice counts as the lower one; null labels and ids are passed over. ``sample_docs`` bounds the labelled
    documents that are learned from. Null text is an empty text; both get a score. Without any label every score
    is 0.5. Rows with a null id are scored and not held out; repeated rows are scored alike; an empty table gives
    an empty result. The score depends on the text alone, on all of it: very long texts are pooled whole, in pieces
    of ``PIECE`` words. Scoring is map-only.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    own = [F.struct("*").alias("doc")] if keep_columns else [F.col(id_col).alias("doc_id")]
    text = F.col(text_col).cast("string").alias("text")
    model = learn(docs.select(F.col(id_col).alias("doc_id"), text), labels.select("doc_id", "quality"), folds, held_out_fold, sample_docs)
    shared = spark.sparkContext.broadcast(model)
    held_out = F.coalesce(crc32_mod(id_col, folds) == held_out_fold, F.lit(False)).alias("held_out")
    # A text that is in the row already is not sent to Python twice.
    inside = keep_columns and docs.schema[text_col].dataType == StringType()
    place = docs.columns.index(text_col)
    rows = docs.select(*own, held_out) if inside else docs.select(*own, held_out, text)
    out = rows.drop("text").withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    arrow = to_arrow_schema(out)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if inside:
                batch = batch.append_column("text", batch.column(0).field(place))
            for part in slices(batch, "text"):
                score = shared.value.score(runs(part.column("text")))
                predicted = pa.array((score >= threshold).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column("held_out"), pa.array(score), predicted], schema=arrow)

    return rows.mapInArrow(scored, out)
