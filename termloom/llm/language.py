"""Language identification with bit-sliced Bloom filters over character n-grams.

Each slot of one table holds a bit per language. The slots of an n-gram, and-ed, give the set of all languages
that have it, in one look-up for all languages. A document's n-grams give a count per language; the number of
false positives to expect from the language's fill is taken off; the largest corrected count decides.

The n-grams of a language are all those of a bounded sample of its labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import crc32_mod, mix64, write_shared
from termloom.llm.words import Words, slices, split_words

GRAMS = (2, 3, 4)


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of runs of letters, each run with a space at both ends; the word of each n-gram; and
    how many letters each word has."""
    lowered = [w.lower() for w in words]
    codes = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    kinds, inverse = np.unique(codes, return_inverse=True)
    letter = np.array([chr(int(c)).isalpha() for c in kinds])[inverse]
    widths = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1
    word = np.concatenate([[0], np.repeat(np.arange(len(words)), widths)])
    codes = np.where(letter, codes, np.uint64(32))
    hashes, owners = [], []
    for n in GRAMS:
        if len(codes) < n:
            continue
        last = len(codes) - n + 1
        inner = letter[: last].copy() if n == 2 else letter[1 : last + 1].copy()
        if n == 2:
            inner |= letter[1 : last + 1]
        for k in range(2, n - 1):
            inner &= letter[k : last + k]
        value = np.full(last, n, np.uint64)
        for k in range(n):
            value = value * np.uint64(0x9E3779B97F4A7C15) + codes[k : last + k] + np.uint64(1)
        at = np.flatnonzero(inner)
        hashes.append(mix64(value[at]))
        owners.append(word[np.where(letter[at], at, at + 1)])
    letters = np.bincount(word[letter], minlength=len(words)) if len(words) else np.zeros(0, np.int64)
    return np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate([np.zeros(0, np.int64), *owners]), letters


@dataclass
class LanguageFilters:
    """``masks``: slots x words of 64 bits, bit l of a slot for language l; ``prior``: the language for texts in
    which nothing is known."""

    languages: list[str]
    masks: np.ndarray
    hashes: int
    prior: int

    @property
    def false_rates(self) -> np.ndarray:
        fill = np.array([self._bit(self.masks, i).mean() for i in range(len(self.languages))])
        return fill**self.hashes

    @staticmethod
    def _bit(masks: np.ndarray, language: int) -> np.ndarray:
        return (masks[:, language // 64] >> np.uint64(language % 64)) & np.uint64(1)

    def slots(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        """Places of each n-gram by double hashing."""
        step = mix64(grams + np.uint64(1)) | np.uint64(1)
        size = np.uint64(len(self.masks) - 1)
        for k in range(self.hashes):
            yield ((grams + np.uint64(k) * step) & size).astype(np.int64)

    def languages_of(self, grams: np.ndarray) -> np.ndarray:
        found = None
        for slot in self.slots(grams):
            found = self.masks[slot] if found is None else found & self.masks[slot]
        return found

    def add(self, grams: np.ndarray, languages: np.ndarray) -> None:
        bits = np.zeros((len(grams), self.masks.shape[1]), np.uint64)
        bits[np.arange(len(grams)), languages // 64] = np.uint64(1) << (languages % 64).astype(np.uint64)
        for slot in self.slots(grams):
            np.bitwise_or.at(self.masks, slot, bits)

    def predict(self, words: Words) -> tuple[list[str], np.ndarray]:
        grams, owner, letters = word_grams(words.unique)
        found = self.languages_of(grams)
        total = words.sums(np.bincount(owner, minlength=len(words.unique)))
        corrected = np.zeros((len(total), len(self.languages)))
        rates = self.false_rates
        for i in range(len(self.languages)):
            hits = np.bincount(owner[self._bit(found, i) > 0], minlength=len(words.unique))
            corrected[:, i] = np.maximum(0.0, (words.sums(hits) - total * rates[i]) / max(1e-9, 1 - rates[i]))
        best = corrected.argmax(axis=1)
        top, all_of = corrected.max(axis=1), corrected.sum(axis=1)
        best[top <= 0] = self.prior
        score = np.where(all_of > 0, top / np.where(all_of > 0, all_of, 1), 0.0)
        lettered = words.sums(letters) > 0
        names = [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
        return names, np.where(lettered, score, 0.0)


def build_filters(counts: list[tuple[str, int, int]], hashes: int = 4, slots_per_gram: int = 8) -> LanguageFilters | None:
    """Filters from (language, n-gram hash, count): each language gets all of its n-grams."""
    if not counts:
        return None
    languages = sorted({c[0] for c in counts})
    number = {name: i for i, name in enumerate(languages)}
    lang = np.array([number[c[0]] for c in counts])
    gram = np.array([c[1] for c in counts], np.int64).view(np.uint64)
    totals = np.bincount(lang, [c[2] for c in counts])
    filters = empty_filters(languages, len(set(gram.tolist())), int(totals.argmax()), hashes, slots_per_gram)
    filters.add(gram, lang)
    return filters


def empty_filters(languages: list[str], grams: int, prior: int, hashes: int = 4, slots_per_gram: int = 8) -> LanguageFilters:
    """Filters with room for so many different n-grams."""
    slots = 1 << max(6, int(slots_per_gram * grams - 1).bit_length())
    return LanguageFilters(languages, np.zeros((slots, (len(languages) + 63) // 64), np.uint64), hashes, prior)


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of batches with lang and text, summed over slices."""
    for batch in batches:
        for part in slices(batch, "text"):
            words = split_words(part.column("text"))
            grams, owner, _ = word_grams(words.unique)
            langs = part.column("lang").dictionary_encode()
            of_doc = langs.indices.to_numpy(zero_copy_only=False)
            of_word = np.repeat(of_doc, words.counts)
            distinct, inverse = np.unique(grams, return_inverse=True)
            for i, name in enumerate(langs.dictionary.to_pylist()):
                times = np.bincount(words.index[of_word == i], minlength=len(words.unique))
                n = np.bincount(inverse, times[owner], len(distinct)).astype(np.int64)
                kept = n > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * int(kept.sum()), pa.string()), pa.array(distinct[kept].view(np.int64)), pa.array(n[kept])],
                    names=["lang", "gram", "n"],
                )


SLOTS = "slot long, word int, bits long"


def _slots(filters: LanguageFilters, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the filters that the n-grams of batches (lang, gram) set bits in, or-ed within each batch."""
    number = {name: i for i, name in enumerate(filters.languages)}
    for batch in batches:
        grams = batch.column("gram").to_numpy().view(np.uint64)
        langs = np.array([number[name] for name in batch.column("lang").to_pylist()], np.int64)
        for slot in filters.slots(grams):
            keys, place = np.unique(slot * filters.masks.shape[1] + langs // 64, return_inverse=True)
            bits = np.zeros(len(keys), np.uint64)
            np.bitwise_or.at(bits, place, np.uint64(1) << (langs % 64).astype(np.uint64))
            at, word = np.divmod(keys, filters.masks.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(word.astype(np.int32)), pa.array(bits.view(np.int64))], names=["slot", "word", "bits"])


def learn_filters(labelled: DataFrame, docs_per_language: int = 2000) -> LanguageFilters | None:
    """Learn from a sample of ``labelled`` (doc_id, text, lang): of each language, the ``docs_per_language``
    documents with the lowest hashes of their ids. All n-grams of the sample go into the filters, whose size follows
    from how many there are. The executors or them into the filters' words; the words that have bits come to the
    driver, as many as the filters that every executor then holds."""
    by_hash = Window.partitionBy("lang").orderBy("pick", "doc_id")
    ids = labelled.select("lang", "doc_id", F.xxhash64("doc_id").alias("pick")).distinct()
    chosen = ids.withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= docs_per_language)
    # docs_per_language rows per language.
    sample = labelled.join(F.broadcast(chosen.select("lang", "doc_id")), ["lang", "doc_id"])
    sample = sample.groupBy("lang", "doc_id").agg(F.max("text").alias("text")).select("lang", "text")
    counted = sample.mapInArrow(gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = write_shared(counted, "language-grams")
    totals = sorted(tuple(r) for r in counted.groupBy("lang").agg(F.sum("n")).collect())  # a row per language
    if not totals:
        return None
    grams = counted.agg(F.count_distinct("gram")).first()[0]
    most = max(range(len(totals)), key=lambda i: totals[i][1])
    names = [lang for lang, _ in totals]
    words = counted.select("lang", "gram").mapInArrow(lambda batches: _slots(empty_filters(names, grams, most), batches), SLOTS)
    filters = empty_filters(names, grams, most)
    found = words.groupBy("slot", "word").agg(F.bit_or("bits").alias("bits")).toArrow()
    slot, word, bits = (found.column(c).to_numpy() for c in ("slot", "word", "bits"))
    filters.masks[slot, word] = bits.view(np.uint64)
    return filters


def identify_language(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 3,
    held_out_fold: int = 1,
    docs_per_language: int = 2000,
) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Documents whose crc32 of the id, modulo ``folds``, is ``held_out_fold`` are held out of learning; rows with a
    null id are neither held out nor learned from. A null text, or one without letters, is ``und`` with score 0;
    so is every text if nothing could be learned, which leaves no other name to give. A text with letters of which no n-gram is known gets the
    language with most n-grams and score 0. Of tied languages the first by name is taken. Repeated rows are
    predicted alike; an empty table gives an empty result; other columns of ``docs`` are not read. Texts of any length
    are read whole, in slices of batches.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    fold = crc32_mod("doc_id", folds)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    labelled = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold != held_out_fold))
    filters = spark.sparkContext.broadcast(learn_filters(labelled, docs_per_language))
    texts = rows.select("doc_id", F.coalesce(fold == held_out_fold, F.lit(False)).alias("held_out"), "text")
    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: LanguageFilters | None = filters.value
        for batch in batches:
            for part in slices(batch, "text"):
                if known is None:
                    names, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                else:
                    names, score = known.predict(split_words(part.column("text")))
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return texts.mapInArrow(predict, schema)
