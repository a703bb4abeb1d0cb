"""Token counts of a unigram tokenizer: Viterbi that carries only the best score and the piece count.

Aho-Corasick enumerates the vocabulary's matches by their end. Of the ways to reach a place, the better score
wins, and of equal scores the one whose last piece starts earlier: the tokenizer's encoder goes through starts in
order and replaces a path only by a strictly better one. A character that is no piece by itself may also be
passed as unknown, at the vocabulary's lowest score less a penalty; it counts as its UTF-8 bytes.

Where no piece has a space mark after another character, a text falls apart before each run of space marks, and
around characters that no piece has, without any change of the best path. Such parts recur, so each different one
is counted once. A vocabulary with pieces across spaces is handled text by text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.words import segment_sums, slices

SPACE = "▁"
#: Fixed value of the unigram encoder: what an unknown character scores below the lowest piece.
UNKNOWN_PENALTY = 10.0
CACHED_PARTS = 500_000
#: Longer parts hardly recur and are not kept.
CACHED_CHARS = 256
CUT = "\x1f"


class UnigramCounter:
    def __init__(self, pieces: dict[str, float], lowest: float | None = None) -> None:
        """``pieces``: the matchable pieces with scores; ``lowest``: lowest score of the vocabulary."""
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.pieces = pieces
        self.unknown = (min(pieces.values(), default=0.0) if lowest is None else lowest) - UNKNOWN_PENALTY
        self.splits = not any(SPACE in piece.lstrip(SPACE) for piece in pieces)
        self.newline_unknown = not any("\n" in piece for piece in pieces)
        #: The best paths to as many last places as a piece may reach back; what lies before is not needed again.
        self.reach = max(map(len, pieces), default=1) + 1
        self.known: dict[str, int] = {}

    def viterbi(self, text: str) -> int:
        """Number of pieces on the best path over ``text``, space marks already in place."""
        pieces, unknown, reach = self.pieces, self.unknown, self.reach
        score, count = [0.0] * reach, [0] * reach
        ends: Iterator[tuple[int, tuple[int, float]]] = self.automaton.iter(text) if pieces else iter(())
        match = next(ends, None)
        here = 0
        for at, char in enumerate(text):
            best, pieces_to, start = None, 0, len(text)
            while match is not None and match[0] == at:
                length, own = match[1]
                begin = at + 1 - length
                place = begin % reach
                value = score[place] + own
                if best is None or value > best or (value == best and begin < start):
                    best, pieces_to, start = value, count[place] + 1, begin
                match = next(ends, None)
            if char not in pieces:
                value = score[here] + unknown
                if best is None or value > best:
                    best, pieces_to = value, count[here] + len(char.encode("utf-8", "surrogatepass"))
            here = (at + 1) % reach
            score[here], count[here] = best, pieces_to
        return count[here]

    def part(self, part: str) -> int:
        if len(part) > CACHED_CHARS:
            return self.viterbi(part)
        found = self.known.get(part)
        if found is None:
            if len(self.known) > CACHED_PARTS:
                self.known.clear()
            found = self.known[part] = self.viterbi(part)
        return found

    def whole(self, texts: pa.Array) -> np.ndarray:
        """Counts of texts that are not cut into parts."""
        return np.array([self.viterbi(SPACE + t.replace(" ", SPACE)) if t else 0 for t in texts.to_pylist()], np.int64)

    def texts(self, texts: pa.Array) -> np.ndarray:
        """Counts of all texts; null and empty texts have none."""
        texts = pc.fill_null(texts, "")
        if not self.splits:
            return self.whole(texts)
        marks = pc.match_substring(texts, CUT)
        if pc.any(marks).as_py():
            at = np.flatnonzero(marks.to_numpy(zero_copy_only=False))
            counts = self.texts(pc.if_else(marks, "", texts))
            counts[at] = self.whole(texts.take(pa.array(at)))
            return counts
        marked = pc.replace_substring(pc.binary_join_element_wise(SPACE, texts, ""), " ", SPACE)
        marked = pc.if_else(pc.equal(texts, ""), "", marked)
        parts = pc.replace_substring_regex(marked, f"([^{SPACE}]){SPACE}", f"\\1{CUT}{SPACE}")
        if self.newline_unknown:
            parts = pc.replace_substring(parts, "\n", f"{CUT}\n{CUT}")
        lists = pc.split_pattern(parts, CUT)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        per_part = np.array([self.part(p) for p in coded.dictionary.to_pylist()], np.int64)
        return segment_sums(per_part[coded.indices.to_numpy(zero_copy_only=False)], offsets - offsets[0])


@lru_cache(maxsize=2)
def counter_of(model_path: str) -> UnigramCounter:
    """Pieces and scores of a sentencepiece model file, read as a unigram vocabulary. (A file of another kind, as the
    one that the query uses, gives counts that are right for these scores and are no other tokenizer's counts.)"""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    pieces = {model.id_to_piece(i): float(model.get_score(i)) for i in plain}
    return UnigramCounter(pieces)


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, tokens.

    A text is read as one line with a space mark before it and for each space, nothing else normalised. Null and
    empty texts have 0 tokens. Rows with null or repeated ids keep their own row; an empty table gives an empty
    result; other columns of ``docs`` are not read. A text of any length is counted whole; beside the text itself a
    part of it takes memory for as many places as the longest piece has. Map-only: no shuffle.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, tokens long"
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(model_path)
        for batch in batches:
            for part in slices(batch, "text"):
                counts = counter.texts(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts)], schema=arrow)

    return texts.mapInArrow(count, schema)
