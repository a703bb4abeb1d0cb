from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import NAMES, SF, clashing, docs
from oracle import duck
from tokenizers import Tokenizer

from termloom.llm import queries
from termloom.llm.best_fit import CapacityTree, best_fit_decreasing
from termloom.llm.mixing import draw_blocks, mix, mixed_documents, split_quotas, targets
from termloom.llm.packing import WordTokenizer, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


# Packing


def test_capacity_tree():
    tree, held = CapacityTree(100), set()
    rng = random.Random(1)
    for _ in range(2000):
        value, present = rng.randrange(101), rng.random() < 0.3
        tree.set(value, present)
        (held.add if present else held.discard)(value)
        asked = rng.randrange(101)
        assert tree.tightest(asked) == min((v for v in held if v >= asked), default=None)


def plain_best_fit(lengths, capacity):
    """Best-fit decreasing piece by piece: how full each window gets."""
    left = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(left) if r >= length]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= length
        else:
            left.append(capacity - length)
    return sorted(left)


@pytest.mark.parametrize("seed", range(20))
def test_best_fit_decreasing_on_counts_is_that_on_pieces(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 32, 100])
    lengths = [min(capacity, 1 + int(rng.expovariate(0.08))) for _ in range(rng.randrange(1, 400))]
    counts = defaultdict(int)
    for n in lengths:
        counts[n] += 1
    placements, windows = best_fit_decreasing(dict(counts), capacity)
    filled, ranks = defaultdict(set), defaultdict(set)
    for p in placements:
        for i in range(p.count):
            assert p.rank + i not in ranks[p.length]
            ranks[p.length].add(p.rank + i)
            start = p.offset + i % p.per_window * p.length
            own = set(range(start, start + p.length))
            assert not own & filled[p.window + i // p.per_window] and max(own) < capacity
            filled[p.window + i // p.per_window] |= own
    assert {n: len(r) for n, r in ranks.items()} == dict(counts)
    assert sorted(filled) == list(range(windows))
    assert all(f == set(range(len(f))) for f in filled.values())
    assert sorted(capacity - len(f) for f in filled.values()) == plain_best_fit(lengths, capacity)


def test_best_fit_refuses_what_cannot_fit():
    assert best_fit_decreasing({}, 8) == ([], 0)
    with pytest.raises(ValueError):
        best_fit_decreasing({9: 1}, 8)


def test_word_tokenizer_is_the_tokenizer():
    rng = random.Random(7)
    alphabet = list("abcZÀÉßœŸİ'’.,!?019 ²½×÷ \t\n\r\x0b\x0c\x1f\x85\u00a0\u3000Σσ中é\u0301fi") + ["<|endoftext|>", "<|startoftext|>", "'s", "l'été"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(3000)] + ["", None]
    mine, plain = WordTokenizer(PATH), Tokenizer.from_file(PATH)
    ids, offsets = mine.texts(pa.array(texts, pa.string()), 2)
    for text, a, b in zip(texts, offsets, offsets[1:], strict=False):
        assert ids[a:b].tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 2]


def check_packing(found, rows, window=4096):
    """Every id of every row in exactly one piece, windows gapless. Returns the share of padding."""
    plain = Tokenizer.from_file(PATH)
    want = [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for _, t in rows]
    by_doc, windows = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    known = defaultdict(list)
    for (doc_id, _), ids in zip(rows, want, strict=True):
        known[doc_id].append(np.array(ids, "<u4"))
    for doc_id, all_ids in known.items():
        expected = sorted((len(ids), a, min(window, len(ids) - a), zlib.crc32(ids[a : a + window].tobytes())) for ids in all_ids for a in range(0, len(ids), window))
        assert sorted((r.doc_tokens, r.start, r.length, r.ids_crc32) for r in by_doc[doc_id]) == expected
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    used = sum(len(ids) for ids in want)
    return 1 - used / (len(windows) * window) if windows else 0


def test_packing_of_the_test_table(spark):
    rows = duck(SF).sql("SELECT doc_id, text FROM documents").fetchall()
    assert check_packing(queries.QUERIES["op4_packing"](spark, SF).collect(), rows) < 0.03


def test_packing_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "a " * 9000), (4, "x" * 50_000), (5, "same"), (5, "same"), (None, "no id"), (6, "a " * 4095)]
    assert check_packing(pack(clashing(docs(spark, rows), *NAMES), PATH).collect(), rows) < 0.8
    small = pack(docs(spark, rows), PATH, window=16).collect()
    check_packing(small, rows, 16)
    assert pack(docs(spark, []), PATH).collect() == []


# Mixing


def test_targets():
    assert targets([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    assert sum(targets([600, 5, 10], [1, 2, 3])) == pytest.approx(615)
    assert targets([600, 5, 10], [1, 2, 3]) == pytest.approx([570, 15, 30])
    assert targets([], []) == [] and targets([0, 0], [1, 2]) == [0, 0]
    assert targets([10, 0], [1, 2]) == pytest.approx([10, 0])


def test_splitting_tree_keeps_quotas_and_balance():
    quotas = [1000, 17, 0, 333]
    out = split_quotas(quotas, 13, 5)
    assert out.sum(axis=0).tolist() == quotas and (out >= 0).all()
    assert out.sum(axis=1).max() - out.sum(axis=1).min() <= 1
    assert np.array_equal(out, split_quotas(quotas, 13, 5)) and not np.array_equal(out, split_quotas(quotas, 13, 6))
    assert split_quotas([0, 0], 3, 1).sum() == 0


def test_draw_blocks():
    words = {b: 10 + b for b in range(8)}
    draw = draw_blocks(words, 8, 2.5 * sum(words.values()), 3)
    taken = draw.passes * sum(words.values()) + sum(words[b] for b in draw.order[: draw.whole])
    assert draw.passes == 2 and taken + draw.rest == pytest.approx(2.5 * sum(words.values()))
    assert draw.rest < words[draw.order[draw.whole]]
    assert draw_blocks({}, 1, 0.0, 3).rest == 0


def test_mix_of_the_test_table(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        rows = duck(sf).sql("SELECT doc_id, source, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) FROM documents").fetchall()
        found = {r.doc_id: r for r in queries.QUERIES["op8_mixing"](spark, sf).collect()}
        sizes, taken = defaultdict(int), defaultdict(int)
        for doc_id, source, size in rows:
            assert found[doc_id].size == size and 0 <= found[doc_id].taken <= 3 * size
            sizes[source] += size
            taken[source] += found[doc_id].taken
        names = sorted(sizes)
        goal = dict(zip(names, targets([sizes[s] for s in names], [1 + i % 3 for i in range(len(names))]), strict=True))
        for doc_id, source, _ in rows:
            assert (found[doc_id].source_size, found[doc_id].target) == (sizes[source], pytest.approx(goal[source]))
        assert all(abs(taken[s] - goal[s]) < 0.12 * goal[s] for s in names)
        # Within a fraction of one document.
        mean = {s: sizes[s] / sum(source == s for _, source, _ in rows) for s in names}
        assert all(abs(taken[s] - goal[s]) < 0.5 * mean[s] for s in names)
        again = {r.doc_id: r.taken for r in queries.QUERIES["op8_mixing"](spark, sf).collect()}
        assert again == {d: r.taken for d, r in found.items()}


def test_mix_copies_are_what_it_says(spark):
    rows = [(i, f"word {i} " * (1 + i % 5), None, "big" if i < 200 else "small" if i < 220 else None) for i in range(230)]
    rows += [(300, None, None, "big"), (301, "", None, "small"), (None, "no id", None, "big"), (5, "word 5 ", None, "big"), (5, "word 5 ", None, "big")]
    frame = clashing(docs(spark, rows), *NAMES)
    mixer = mix(frame, words_per_shard=200, block_docs=4)
    documents = mixer.documents.collect()
    assert len(documents) == len(rows)
    copies = mixed_documents(mixer, frame.columns)
    assert copies.columns == frame.columns
    counted = defaultdict(int)
    for r in copies.collect():
        counted[r.doc_id] += 1
    expected = defaultdict(int)
    for r in documents:
        expected[r.doc_id] += len(r.shards)
    assert {d: n for d, n in expected.items() if n} == dict(counted)
    assert len({s for r in documents for s in r.shards}) > 2
    assert all(r.target <= 3 * r.source_size + 1e-9 for r in documents)


def test_mix_of_nothing(spark):
    mixer = mix(docs(spark, []))
    assert mixer.documents.collect() == [] and mixer.copies.collect() == []
    empty = mix(docs(spark, [(1, None, None, "a"), (2, "", None, None)])).documents.collect()
    assert [(r.size, r.taken, r.target) for r in empty] == [(0, 0, 0.0)] * 2
