"""Packing token sequences into windows by best-fit decreasing over the whole corpus.

1. Texts are tokenised once. A document longer than a window is cut into full windows and a rest; each piece
   gets the CRC-32 of its ids and its rank among the task's pieces of the same length. The pieces (no ids) are
   written to shared files.
2. Best-fit decreasing needs only how many pieces there are of each length: at most ``window`` numbers, whatever
   the corpus. It runs on these counts and gives placements by (length, rank).
3. A piece's rank in the corpus is its rank in its task plus the counts of the tasks before; with it, each piece
   reads its window and offset from the placements.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.best_fit import best_fit_decreasing
from termloom.llm.common import write_shared
from termloom.llm.words import gather_runs, segment_sums, slices, split_words

CACHED_WORDS, CACHED_CHARS = 500_000, 1 << 24
#: Larger slices than elsewhere: a slice's different words are looked up once.
SLICE_BYTES = 4 << 20


#: Characters whose lower case, and place among letters, digits and others, are beyond doubt. The apostrophe is
#: left out, as the tokenizer cuts contractions at it, and so is what special tokens start with.
UNSAFE = "[^ \\t\\n\\r\\f!-&(-~À-ÖØ-öø-į]|<\\|"
APART = "([0-9]|[^ \\t\\n\\r\\fa-zß-öø-į0-9]+)"


class WordTokenizer:
    """Ids of whole texts, for a tokenizer that lower-cases, drops white space and encodes runs of letters, single
    digits and runs of other characters apart.

    Texts of plain characters are cut into these parts, which recur far more than words do; other texts are cut
    at white space only. Each different part or word is encoded once and kept, up to ``CACHED_WORDS`` of them or
    ``CACHED_CHARS`` characters; then the store starts anew.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.ids = np.zeros(1 << 20, "<u4")
        self.ends = np.zeros(1 << 18, np.int64)

    def _learn(self, new: list[str]) -> None:
        lists = [coded.ids for coded in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        number = len(self.known)
        self.chars += sum(map(len, new))
        start = int(self.ends[number - 1]) if number else 0
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        total = int(lengths.sum())
        while number + len(new) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while start + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ends[number : number + len(new)] = start + np.cumsum(lengths)
        self.ids[start : start + total] = np.fromiter(chain.from_iterable(lists), "<u4", total)
        self.known.update(zip(new, range(number, number + len(new)), strict=True))

    def words(self, unique: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word start in ``self.ids``, and how many it has."""
        if len(self.known) > CACHED_WORDS or self.chars > CACHED_CHARS:
            self._clear()
        new = [word for word in unique if word not in self.known]
        if new:
            self._learn(new)
        at = np.fromiter(map(self.known.__getitem__, unique), np.int64, len(unique))
        starts = np.where(at > 0, self.ends[at - 1], 0)
        return starts, self.ends[at] - starts

    def texts(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with ``end_id`` after it, in one array; and the texts' offsets there."""
        texts = pc.fill_null(texts, "")
        unsafe = pc.match_substring_regex(texts, UNSAFE)
        plain = pc.utf8_lower(pc.if_else(unsafe, "", texts))
        parts = pc.replace_substring_regex(plain, APART, r" \1 ")
        words = split_words(pc.if_else(unsafe, texts, parts))
        starts, lengths = self.words(words.unique)
        per_word = lengths[words.index]
        counts = segment_sums(per_word, words.offsets) + 1
        offsets = np.concatenate([[0], np.cumsum(counts)])
        out = np.full(offsets[-1], end_id, dtype="<u4")
        inside = np.ones(offsets[-1], dtype=bool)
        inside[offsets[1:] - 1] = False
        out[inside] = self.ids[gather_runs(starts[words.index], per_word)]
        return out, offsets


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, task long, task_rank long"


def _pieces(path: str, window: int, end_id: int, batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    task, tokenizer = TaskContext.get().partitionId(), word_tokenizer(path)
    seen = np.zeros(window + 1, np.int64)
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            ids, offsets = tokenizer.texts(part.column("text"), end_id)
            lengths = np.diff(offsets)
            cuts = -(-lengths // window)
            doc = np.repeat(np.arange(len(lengths)), cuts)
            start = (gather_runs(np.zeros(len(cuts), np.int64), cuts)) * window
            size = np.minimum(lengths[doc] - start, window)
            at = offsets[doc] + start
            view = memoryview(ids).cast("B")
            crc = np.fromiter((zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), size.tolist(), strict=True)), np.int64, len(at))
            order = np.argsort(size, kind="stable")
            ordered = size[order]
            first = np.searchsorted(ordered, ordered)
            rank = np.empty(len(size), np.int64)
            rank[order] = np.arange(len(size)) - first + seen[ordered]
            seen += np.bincount(size, minlength=window + 1)
            columns = [part.column("doc_id").take(pa.array(doc)), start, size, crc, lengths[doc], np.full(len(doc), task), rank]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], schema=schema)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 4096,
    end_id: int = 2,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is one piece with ``end_id`` alone. Rows with null or repeated ids are packed like any
    others, each on its own. An empty table gives an empty result. Ties (pieces of one length) are placed in the
    order of the scan's tasks. Other columns of ``docs`` are not read. A text of any length is tokenised whole and cut
    into full windows and a rest. The tokenizer must be one whose tokens
    never span white space.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = PIECES.format(id=texts.schema["doc_id"].dataType.simpleString())
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    cut = texts.mapInArrow(lambda batches: _pieces(tokenizer_path, window, end_id, batches, arrow), schema)
    pieces = write_shared(cut, "pack-pieces")

    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    by_task = write_shared(by_task, "pack-counts")
    counts = {row[0]: row[1] for row in by_task.groupBy("length").agg(F.sum("n")).collect()}  # window rows at most
    placements, _ = best_fit_decreasing(counts, window)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    # The counts grow with the number of tasks: they are not to be broadcast.
    ranked = pieces.join(bases.hint("shuffle_hash"), ["length", "task"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("task_rank")).alias("rank")
    )

    placed = sorted(placements, key=lambda p: (p.length, p.rank))
    keys = ("length", "rank", "window", "offset", "per_window")
    table = spark.sparkContext.broadcast({k: np.array([getattr(p, k) for p in placed], np.int64) for k in keys})
    span = max(counts.values(), default=0) + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        starts = t["length"] * span + t["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(starts, length * span + rank, side="right") - 1
            behind = rank - t["rank"][at]
            sequence = t["window"][at] + behind // t["per_window"][at]
            offset = t["offset"][at] + behind % t["per_window"][at] * length
            kept = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], schema=result)

    out = schema.partition(", task long")[0] + ", sequence_id long, offset long"
    result = to_arrow_schema(spark.createDataFrame([], out).schema)
    return ranked.mapInArrow(place, out)
