from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from helpers import NAMES, SF, by_id, clashing, docs
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import duck

from termloom.llm import language, quality, queries
from termloom.llm.language import LanguageFilters, build_filters, identify_language, word_grams
from termloom.llm.quality import fit_temperature, log_loss, pooled, score_quality
from termloom.llm.token_counts import SPACE, UnigramCounter, counter_of, token_counts
from termloom.llm.words import slices, split_words

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# Words


@settings(deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té", max_size=12)), max_size=8))
def test_split_words(texts):
    words = split_words(pa.array(texts, pa.string()))
    own = [[words.unique[i] for i in words.index[a:b]] for a, b in zip(words.offsets, words.offsets[1:], strict=False)]
    assert own == [(t or "").split() for t in texts]
    assert "" not in words.unique
    assert words.sums(np.ones(len(words.unique))).tolist() == [len(o) for o in own]


def test_slices_cover_a_batch():
    texts = ["a" * n for n in (0, 5, 3, 100, 1, 1, 0)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = [p.column("text").to_pylist() for p in slices(batch, "text", 6)]
    assert sum(parts, []) == texts and len(parts) > 2
    assert list(slices(batch.slice(0, 0), "text")) == []


# Token counts


def unigram(pieces, unknown=None):
    from tokenizers import Tokenizer, models

    vocabulary = [("<unk>", min(pieces.values()))] + list(pieces.items())
    vocabulary += [(f"<0x{b:02X}>", min(pieces.values())) for b in range(256)]
    return Tokenizer(models.Unigram(vocabulary, 0, byte_fallback=True))


def marked(text):
    return SPACE + text.replace(" ", SPACE) if text else ""


@settings(deadline=None, max_examples=300)
@given(st.lists(st.text(alphabet="abc é\n", max_size=14), max_size=6), st.dictionaries(st.text(alphabet=f"abc{SPACE}", min_size=1, max_size=4), st.integers(-6, 0), min_size=1, max_size=14))
def test_counts_like_the_tokenizer_with_ties(texts, pieces):
    pieces = {p: float(s) for p, s in pieces.items()}
    counter, other = UnigramCounter(pieces), unigram(pieces)
    assert counter.texts(pa.array(texts, pa.string())).tolist() == [len(other.encode(marked(t)).ids) for t in texts]


def test_counts_of_the_test_table(spark):
    rows = duck(SF).sql("SELECT doc_id, text FROM documents").fetchall()
    other = unigram(counter_of(MODEL).pieces)
    found = by_id(queries.QUERIES["op9_token_counts"](spark, SF))
    assert {d: r.tokens for d, r in found.items()} == {d: len(other.encode(marked(t)).ids) for d, t in rows}


def test_counts_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "\x1f a"), (5, "語 \n\n  x"), (6, "ab" * 100_000), (None, "one"), (7, "one"), (7, "one")]
    found = token_counts(clashing(docs(spark, rows), *NAMES), MODEL).collect()
    other = unigram(counter_of(MODEL).pieces)
    want = [(d, len(other.encode(marked(t or "")).ids)) for d, t in rows]
    assert sorted(((r.doc_id, r.tokens) for r in found), key=str) == sorted(want, key=str)
    assert token_counts(docs(spark, []), MODEL).collect() == []


def test_counting_a_long_text_without_spaces_takes_little_memory():
    import tracemalloc

    pieces = {"ab": -1.0, "a": -3.0, "b": -3.0, "abab": -1.5}
    counter, text = UnigramCounter(pieces), "ab" * 200_000
    want = len(unigram(pieces).encode(marked(text)).ids)  # 100,000 pieces, and the bytes of the unknown space mark
    assert want == 100_003
    tracemalloc.start()
    assert counter.texts(pa.array([text])).tolist() == [want]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(text)
    assert not any(len(part) > 1000 for part in counter.known)


def test_texts_with_the_cut_mark_do_not_slow_others(monkeypatch):
    counter = counter_of(MODEL)
    seen = []
    whole = counter.whole
    monkeypatch.setattr(counter, "whole", lambda texts: seen.append(len(texts)) or whole(texts))
    texts = ["plain words", "with \x1f mark", None, "more words", "\x1f"]
    other = unigram(counter.pieces)
    assert counter.texts(pa.array(texts)).tolist() == [len(other.encode(marked(t or "")).ids) for t in texts]
    assert seen == [2]


# Language


def brute_grams(text):
    """N-grams of a text, one by one."""
    out = []
    for word in re.split(r"[ \t\n\x0b\f\r]+", text or ""):
        run = ""
        for char in word.lower() + " ":
            if char.isalpha():
                run += char
            elif run:
                padded = f" {run} "
                out += [padded[i : i + n] for n in language.GRAMS for i in range(len(padded) - n + 1)]
                run = ""
    return out


def test_languages_like_sets_of_strings(spark):
    """The filters against a set of n-grams per language, and whole outputs against exact counts."""
    rows = duck(SF).sql("SELECT doc_id, text, lang FROM documents").fetchall()
    known = {}
    for doc_id, text, lang in rows:
        if lang is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 != 1:
            known.setdefault(lang, set()).update(brute_grams(text))
    found = by_id(queries.QUERIES["op10_language"](spark, SF))
    clear = 0
    for doc_id, text, _ in rows:
        grams = brute_grams(text)
        r = found[doc_id]
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        counts = {lang: sum(g in own for g in grams) for lang, own in known.items()}
        first, second = sorted(counts.values(), reverse=True)[:2]
        assert abs(r.score - counts[r.lang_pred] / sum(counts.values())) < 0.02
        assert counts[r.lang_pred] >= first - 0.03 * len(grams)
        if first - second > 0.03 * len(grams):
            clear += 1
            assert counts[r.lang_pred] == first
    assert clear > 0.8 * len(rows)


def test_word_grams():
    hashes, owner, letters = word_grams(["Ab", "x1yz", "!"])
    assert letters.tolist() == [2, 3, 0]
    again, same, _ = word_grams(["ab"])
    assert np.array_equal(np.sort(hashes[owner == 0]), np.sort(again)) and set(same) == {0}
    assert len(again) == 3 + 2 + 1  # " a", "ab", "b "; " ab", "ab "; " ab "
    assert (owner == 2).sum() == 0
    assert len(word_grams([])[0]) == 0


def test_filters_hold_more_than_64_languages():
    rng = np.random.default_rng(1)
    counts = [(f"l{i:03d}", int(g), 5) for i in range(70) for g in rng.integers(-(2**62), 2**62, 50)]
    filters = build_filters(counts)
    for i in (0, 3, 64, 69):
        grams = np.array([g for name, g, _ in counts if name == f"l{i:03d}"], np.int64).view(np.uint64)
        assert (LanguageFilters._bit(filters.languages_of(grams), i) == 1).all()
    other = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    hits = LanguageFilters._bit(filters.languages_of(other), 5).mean()
    assert abs(hits - filters.false_rates[5]) < 0.01
    assert build_filters([]) is None


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    langs = dict(duck(sf).sql("SELECT doc_id, lang FROM documents").fetchall())
    found = queries.QUERIES["op10_language"](spark, sf).collect()
    assert len(found) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in found)
    right = [r.lang_pred == langs[r.doc_id] for r in found if r.held_out]
    assert sum(right) >= 0.98 * len(right)


def test_language_of_odd_texts(spark):
    rows = [(i, "the cat and the dog were here", "en") for i in range(30)] + [(30 + i, "der hund und die katze waren da", "de") for i in range(20)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "123 !?", "de"), (103, "語語", None), (None, "the cat", None), (104, "und die katze " * 20_000, None), (104, "the dog", "xx")]
    found = identify_language(clashing(docs(spark, rows), *NAMES)).collect()
    assert len(found) == len(rows)
    got = {(r.doc_id, i): r for i, r in enumerate(found)}
    named = {}
    for (doc_id, _), r in got.items():
        named.setdefault(doc_id, []).append((r.lang_pred, r.score))
    assert named[100] == named[101] == named[102] == [("und", 0.0)]
    assert named[103] == [("en", 0.0)]  # letters, but nothing known: the language with most n-grams
    assert named[None][0][0] == "en" and ("de" in [n for n, _ in named[104]])
    unlabelled = identify_language(docs(spark, [(1, "abc"), (2, None)])).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)] * 2
    assert identify_language(docs(spark, [])).collect() == []


def test_held_out_languages_are_not_learned(spark):
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1][:20]
    rest = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1][:20]
    rows = [(i, "abc abc", "aa") for i in rest] + [(i, "xyz xyz", "bb") for i in held]
    assert {r.lang_pred for r in identify_language(docs(spark, rows)).collect()} == {"aa"}


# Quality


def brute_score(text, model):
    """A text's score, word by word."""
    apart = regex.sub(r"(\p{N}+|[^\t\n\f\r \p{L}\p{N}]+)", r" \1 ", text or "")
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", apart) if w]
    total, kinds, repeats = np.zeros(quality.DIMENSIONS), set(), 0
    for i, word in enumerate(words):
        if word[0].isalpha():
            own = zlib.crc32(f"letters {word.lower()}".encode())
            if word.islower():
                case = "lower"
            elif word.isupper():
                case = "upper" if len(word) > 1 else "capital"
            else:
                case = "title" if word[0].isupper() and word[1:].islower() else "mixed"
        else:
            own, case = zlib.crc32((f"digits {len(word)}" if word[0].isnumeric() else f"symbols {word}").encode()), "none"
        kinds.add(own % quality.BUCKETS)
        total += model.table[own % quality.BUCKETS] + model.table[zlib.crc32(f"case {case}".encode()) % quality.BUCKETS]
        repeats += i > 0 and words[i - 1] == word
    n = max(1, len(words))
    mean = total / (2 * quality.SCALE * n)
    x = [*mean, np.sqrt((mean**2).sum()), np.log1p(len(words)) / 8, len(kinds) / n, repeats / n]
    w1, b1, w2, b2 = model.layers
    hidden = [max(0.0, b1[j] + sum((v - a) / s * w1[i, j] for i, (v, a, s) in enumerate(zip(x, model.shift, model.spread, strict=True)))) for j in range(len(b1))]
    return 1 / (1 + np.exp(-(b2 + sum(h * w for h, w in zip(hidden, w2, strict=True))) / model.temperature))


def test_scores_like_word_by_word(spark):
    frame, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    model = quality.learn(frame.select("doc_id", "text"), labels.select("doc_id", "quality"), 4, 2, 10_000)
    found = by_id(score_quality(frame, labels))
    for r in frame.select("doc_id", "text").collect():
        want = brute_score(r.text, model)
        assert found[r.doc_id].score == pytest.approx(want, abs=1e-7)
        assert found[r.doc_id].predicted == (want >= 0.7)


def test_contexts_like_pair_by_pair():
    texts = ["a b c a b", "", "B ! 12 a", "x"]
    index = quality.index_vectors()
    words = quality.runs(pa.array(texts))
    own, _ = quality.word_buckets(words.unique)
    want = np.zeros((quality.BUCKETS, quality.DIMENSIONS), np.int64)
    for a, b in zip(words.offsets, words.offsets[1:], strict=False):
        stream = [own[i] for i in words.index[a:b]]
        for i, word in enumerate(stream):
            for j in range(max(0, i - quality.NEAR), min(len(stream), i + quality.NEAR + 1)):
                if j != i:
                    want[word] += index[stream[j]]
    assert np.array_equal(quality.context_sums(words, index), want)


def test_quality_sends_one_table_to_the_driver(spark, monkeypatch):
    """However many tasks count contexts, one table of sums comes to the driver, and features come as bytes."""
    frame, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    got, kind = [], type(frame)
    monkeypatch.setattr(kind, "collect", lambda self, collect=kind.collect: got.append(collect(self)) or got[-1])
    merged = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that the sample has several files
    try:
        quality.learn(frame.select("doc_id", "text"), labels.select("doc_id", "quality"), 4, 2, 10_000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)
    sums, features = got
    assert [len(r.sums) for r in sums] == [8 * quality.BUCKETS * quality.DIMENSIONS]
    assert features and {len(r.x) for r in features} == {8 * (quality.DIMENSIONS + 4)}
    assert all(isinstance(r.x, (bytes, bytearray)) for r in features)


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = dict(duck(sf).sql("SELECT doc_id, quality FROM labels").fetchall())
    found = queries.QUERIES["op6_quality"](spark, sf).collect()
    assert len(found) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    right = [r.predicted == labels[r.doc_id] for r in found if r.held_out and r.doc_id in labels]
    assert sum(right) >= 0.93 * len(right)


def test_quality_does_not_read_held_out_labels_or_other_columns(spark):
    rows = [(i, f"word{'abc'[i % 3]} " * (5 + i % 7) + ("!!! $$$" if i % 4 == 0 else "fine text here"), "en", "s") for i in range(240)]
    labels = [(i, int(i % 4 != 0)) for i in range(240)]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, q in labels]
    one = score_quality(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    other_rows = [(d, t, "de", f"q{d % 4}") for d, t, _, _ in rows]
    two = score_quality(clashing(docs(spark, other_rows), *NAMES), spark.createDataFrame(flipped, "doc_id long, quality int")).collect()
    assert [(r.doc_id, r.score) for r in one] == [(r.doc_id, r.score) for r in two]
    wrong = [r.doc_id for r in one if r.predicted != (r.doc_id % 4 != 0)]
    assert len(wrong) < 5


def test_quality_of_odd_texts(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    rows = [(1, "good text"), (2, "bad ### text"), (3, None), (4, ""), (5, "x " * 200_000), (None, "good text"), (1, "good text"), (6, "\u00a0")]
    found = score_quality(docs(spark, rows), labels, keep_columns=True).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in found if r.doc.doc_id in (3, 4)} == {next(r.score for r in found if r.doc.doc_id == 4)}
    assert not next(r for r in found if r.doc.doc_id is None).held_out
    none = score_quality(docs(spark, rows), labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 0)}
    assert score_quality(docs(spark, []), labels).collect() == []


def test_pooling_is_exact_and_independent_of_batches():
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["a", "Bc", "d!", "12", "ééé"], n)) for n in (3, 0, 40_000, 7, 100)]
    table = quality.index_vectors() * quality.SCALE
    whole = pooled(quality.runs(pa.array(texts)), table)
    parts = np.concatenate([pooled(quality.runs(pa.array([t])), table) for t in texts])
    assert np.array_equal(whole, parts)


def test_temperature_calibrates():
    rng = np.random.default_rng(5)
    logits = rng.normal(0, 2, 20_000)
    labels = (rng.random(20_000) < quality.sigmoid(logits)).astype(float)
    assert abs(fit_temperature(3 * logits, labels) - 3) < 0.3
    assert log_loss(logits, labels) < log_loss(3 * logits, labels)


def test_mixer_is_well_spread():
    assert len(np.unique(language.mix64(np.arange(100_000, dtype=np.uint64)) & np.uint64(0xFFFFF))) > 90_000
