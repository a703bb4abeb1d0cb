"""Vectorised word handling for Arrow batches of texts.

A batch of texts has many words and few different ones. The operators that run in Python split a slice of a
batch into words once, do their work per different word, and sum over the words of each document with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20


@dataclass
class Words:
    """``unique``: the different words; ``index``: for each word of all texts, its place in ``unique``;
    ``offsets``: text i has the words ``index[offsets[i]:offsets[i + 1]]``."""

    unique: list[str]
    index: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def sums(self, per_word: np.ndarray) -> np.ndarray:
        """For each text, the exact sum of an integer that each different word has."""
        return segment_sums(per_word.astype(np.int64)[self.index], self.offsets)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def slices(batch: pa.RecordBatch, text: str, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most_bytes`` of text, so that what a part takes in memory is bounded by that
    or by its longest text."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(lengths) - lengths) // most_bytes
    starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()  # a worker lives on with what it once took


def split_words(texts: pa.Array) -> Words:
    """Words of each text between ASCII white space; null is an empty text."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    unique, index = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    offsets = offsets - offsets[0]
    if "" in unique:
        blank = unique.index("")
        del unique[blank]
        real = index != blank
        before = np.concatenate([[0], np.cumsum(real)])
        index, offsets = index[real], before[offsets]
        index = index - (index > blank)
    return Words(unique, index, offsets)


def gather_runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated runs ``[start, start + length)``."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
