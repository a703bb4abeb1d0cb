from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from helpers import NAMES, SF, by_id, clashing, docs
from oracle import assert_same, duck

from termloom.llm import queries
from termloom.llm.components import components
from termloom.llm.exact_dedup import build_directory, deepen, exact_dedup, fill_buckets, look_up, route
from termloom.llm.line_dedup import line_dedup
from termloom.llm.ngram_join import choose_bands, ngram_join, verify


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    assert assert_same(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF)


# Exact dedup


def test_directory_doubles_until_buckets_fit():
    counts = {0: 5, 1: 1, 2: 1, 3: 1, 12: 4}
    depth, slots, local = build_directory(counts, 4, 4)
    assert len(slots) == 1 << depth
    held = defaultdict(int)
    for prefix, n in counts.items():
        held[slots[prefix >> (4 - depth)]] += n
    assert all(n <= 4 or local[b] == 4 for b, n in held.items())
    assert slots == sorted(slots)
    assert build_directory({}, 4, 4) == (0, [0], [0])
    assert build_directory({0: 100}, 1, 0) == (0, [0], [0])


@pytest.mark.parametrize("key_bits", [64, 3])
def test_exact_dedup(spark, key_bits):
    rows = [(1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, "Äbc"), (6, "äbc"), (7, "x" * 300_000), (8, "X" * 300_000), (9, "abc "), (None, "abc"), (None, "lone"), (9, "abc ")]
    rows += [(100 + i, f"text {i}") for i in range(40)]
    found = exact_dedup(clashing(docs(spark, rows), *NAMES), bucket_capacity=2, max_depth=6, key_bits=key_bits).collect()
    assert len(found) == len(rows)
    one = {(r.doc_id, r.text_sha256): r for r in found}

    def at(doc_id, text):
        return one[doc_id, hashlib.sha256(text.encode()).hexdigest()]

    assert [at(1, "abc").keep_id, at(1, "abc").group_size, at(1, "abc").kept, at(2, "abc").kept] == [2, 3, False, True]
    assert [at(3, "").keep_id, at(4, "").kept, at(3, "").kept] == [4, True, False]
    assert at(5, "Äbc").group_size == 1 and at(6, "äbc").group_size == 1
    assert at(7, "x" * 300_000).keep_id == 8
    assert at(9, "abc ").group_size == 2 and at(9, "abc ").kept
    assert not at(None, "abc").kept and at(None, "lone").kept and at(None, "lone").keep_id is None
    if key_bits == 3:
        assert max(r.chain for r in found) > 0


def test_buckets_decide_which_texts_are_equal(spark):
    """Copies meet in a bucket's chain and nowhere else, and a document reads its own bucket only."""
    rows = [(1, 0, 5, "a"), (2, 0, 5, "a"), (3, 0, 5, "b"), (4, 1, 5, "a"), (5, 1, 6, "c")]
    routed = spark.createDataFrame(rows, "doc_id long, bucket int, key long, norm string").repartition(3)
    index = fill_buckets(routed)
    entries = {(r.bucket, r.key, bytes(r.sha)): r for r in index.collect()}

    def at(bucket, key, text):
        return entries[bucket, key, hashlib.sha256(text.encode()).digest()]

    assert len(entries) == 4 and {at(0, 5, "a").chain, at(0, 5, "b").chain} == {0, 1} and at(1, 5, "a").chain == 0
    assert [(at(0, 5, "a").keep_id, at(0, 5, "a").group_size), (at(1, 5, "a").keep_id, at(1, 5, "a").group_size)] == [(2, 2), (4, 1)]
    assert {r.doc_id: (r.keep_id, r.group_size) for r in look_up(routed, index).collect()} == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (4, 1), 5: (5, 1)}
    found = {r.doc_id: r.keep_id for r in look_up(routed, index.where("bucket = 0")).collect()}
    assert found == {1: 2, 2: 2, 3: 3, 4: None, 5: None}
    keyed = spark.createDataFrame([(0,), (1 << 62,), (-1,), (-(1 << 62),)], "key long")
    assert {r.key: r.bucket for r in route(keyed, 2, [0, 1, 2, 2]).collect()} == {0: 0, 1 << 62: 1, -1: 2, -(1 << 62): 2}


@pytest.mark.parametrize(("max_depth", "key_bits"), [(2, 64), (0, 64), (6, 64), (2, 4)])
def test_buckets_hold_no_more_than_their_capacity(spark, max_depth, key_bits):
    """Beyond the directory's depth, too, unless hashes agree in all bits that can tell them apart."""
    rows = [(i, f"Text {i % 500}") for i in range(1500)]
    found = exact_dedup(docs(spark, rows), bucket_capacity=4, max_depth=max_depth, key_bits=key_bits).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in found} == {i: (1000 + i % 500, 3) for i, _ in rows}
    held = defaultdict(set)
    for r in found:
        held[r.bucket].add(r.text_sha256)
    assert sum(map(len, held.values())) == 500  # no text is in two buckets
    if key_bits == 64:
        assert max(map(len, held.values())) <= 4
    else:
        assert len(held) == 4 and max(r.chain for r in found) > 4  # 16 hashes, 4 of them in each bucket


def test_deepen(spark):
    keys = spark.createDataFrame([(0,), (1 << 60,), (1 << 57,), (-1,), (-2,)], "key long")
    assert deepen(keys, 2, [0, 3], 1) == {0: 5, 3: 16}
    assert deepen(keys, 2, [0], 2) == {0: 2}
    deep = {r.key: r.bucket for r in route(keys, 2, [0, 1, 2, 3], {0: 5}).collect()}
    assert deep == {0: 0, 1 << 57: 4, 1 << 60: 32, -1: 3, -2: 3}


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(docs(spark, [])).collect() == []


# Line dedup

LONG = " ".join(f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz")


def cleaned(spark, rows, **kwargs):
    return {r.doc.doc_id: r for r in line_dedup(clashing(docs(spark, rows), *NAMES), **kwargs).collect()}


def test_line_dedup_keeps_the_first_of_recurring_lines(spark):
    own = [f"line that only document {'abcdefghij'[i]} has" for i in range(4)]
    variable = [LONG.replace("wz", f"at{i}") for i in range(4)]
    changed = LONG.replace("wd we", "other words")
    rows = [
        (2, f"{LONG}\n{own[0]}"),
        (1, f"{own[1]}\n{LONG}\n\n{LONG}"),
        (3, f"{changed}\n{own[2]}\n{variable[2]}"),
        (4, f"{variable[3]}\n{own[3]}"),
        (5, None),
        (6, ""),
        (None, "nothing of note"),
    ]
    found = cleaned(spark, rows)
    assert len(found) == len(rows)
    assert found[1].text == f"{own[1]}\n{LONG}\n" and found[1].dropped == 1  # first by document and place
    assert found[2].text == own[0]
    assert found[3].text == own[2]
    assert found[4].text == own[3]
    assert found[5].text is None and (found[5].lines, found[5].dropped) == (0, 0)
    assert found[6].text == "" and (found[6].lines, found[6].dropped) == (1, 0)
    assert found[None].text == "nothing of note"


def test_short_lines_need_more_documents(spark):
    rows = [(i, f"thanks\nown {'abcdefghijkl'[i]}") for i in range(12)]
    assert all(r.dropped == 0 for r in cleaned(spark, rows, min_docs=13).values())
    found = cleaned(spark, rows, min_docs=12)
    assert [found[i].dropped for i in range(12)] == [0] + [1] * 11


def test_lines_of_one_document_stay(spark):
    found = cleaned(spark, [(1, "\n".join([LONG] * 600)), (2, "other")])
    assert found[1].dropped == 0
    found = cleaned(spark, [(1, LONG), (2, "\n".join(["keep me"] + [LONG] * 600))])
    assert (found[2].text, found[2].dropped, found[2].lines) == ("keep me", 600, 601)


def test_repeated_rows_and_long_tokens(spark):
    rows = [(1, LONG), (1, LONG), (2, "y" * 200_000), (3, "1" * 200_000)]
    found = line_dedup(docs(spark, rows)).collect()
    assert len(found) == 4 and all(r.dropped == 0 for r in found)
    assert line_dedup(docs(spark, [])).collect() == []


def brute_passages(rows, exact_tokens=9, passage_words=50):
    """The text that stays of each document, by exact lines alone. Rows have different ids."""
    lines = {d: [tuple(line.split()) for line in text.split("\n")] for d, text in sorted(rows)}
    holders = defaultdict(set)
    for d, own in lines.items():
        for w in own:
            holders[w].add(d)
    seen, left = set(), {}
    for d, own in lines.items():
        copy = []
        for w in own:
            copy.append(bool(w) and w in seen and len(holders[w]) > 1)
            seen.add(w)
        gone = {i for i, w in enumerate(own) if copy[i] and len(w) >= exact_tokens}
        run = []
        for i, w in [*enumerate(own), (-1, ("end",))]:
            if not w:
                continue
            if i >= 0 and copy[i]:
                run.append(i)
                continue
            if sum(len(own[j]) for j in run) > passage_words:
                gone.update(run)
            run = []
        left[d] = "\n".join(line for i, line in enumerate(dict(rows)[d].split("\n")) if i not in gone)
    return left


def test_shared_passages_go_like_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)] + ["7", "3.5"]

    def broken(*lengths):
        return [" ".join(rng.choices(vocabulary, k=k)) for k in lengths]

    def own():
        return broken(*rng.choices(range(1, 16), k=3))

    passage, brief, menu = broken(8, 15, 8, 12, 8, 9), broken(*[6] * 9), broken(*[5] * 10)
    texts = [own() + passage + own(), passage, own() + passage[:2] + ["", " "] + passage[2:] + own(), own() + brief, brief[:8] + own()]
    texts += [own() + brief[:4] + ["", ""] + brief[4:], own() + menu, own() + menu[:5] + own() + menu[5:], menu + menu, [passage[0]] + own(), [""], own() * 3]
    rows = [(i, "\n".join(t)) for i, t in enumerate(texts)]
    want = brute_passages(rows)
    found = cleaned(spark, rows, exact_tokens=9)
    assert {d: r.text for d, r in found.items()} == want
    assert want[1] == "" and found[1].dropped == 6  # all 60 words that document 0 has
    assert found[2].dropped == 6 and found[4].dropped == 0 and found[5].dropped == 9  # 60, 48 and 54 words
    assert found[7].dropped == 0 and found[9].dropped == 0
    assert all(r.dropped == 0 for r in cleaned(spark, rows).values())


def test_passages_with_templates_numbers_and_repeats(spark):
    short = [f"short line {'abcdefghijkl'[i]}" for i in range(12)]
    rows = [(1, "\n".join([*short, LONG, "tail"])), (2, "\n".join([*short[:9], LONG.replace("wd", "other"), "tail"])), (3, "tail")]
    found = cleaned(spark, rows, exact_tokens=9)
    assert (found[1].dropped, found[2].text, found[3].text) == (0, "", "tail")  # the template's line is of the run
    figures = "a b c d e f g h {}"
    found = cleaned(spark, [(1, figures.format(1)), (2, figures.format(2)), (3, figures.format(1))], exact_tokens=9)
    assert [found[i].dropped for i in (1, 2, 3)] == [0, 0, 1]
    rows = [(None, "\n".join(short[:3])), (1, figures), (1, figures), (2, None), (3, "")]
    assert all(r.dropped == 0 for r in line_dedup(docs(spark, rows), exact_tokens=9).collect())
    assert line_dedup(docs(spark, []), exact_tokens=9).collect() == []


def test_short_lines_with_one_variable_token(spark):
    hosts = ["alpha", "beta", "gamma", "delta", "eta", "iota", "kappa", "mu", "nu", "xi", "pi", "rho"]
    log = "Connection from host {} closed by peer"
    rows = [(i, log.format(h)) for i, h in enumerate(hosts)]
    rows += [(20 + i, f"Connection {h} host alpha closed by peer") for i, h in enumerate(hosts[:11])]  # a leading token varies
    rows += [(40 + i, f"one word {h}") for i, h in enumerate(hosts)]  # too short
    rows += [(60 + i, f"two words {h} and {hosts[-i]}") for i, h in enumerate(hosts)]  # two vary
    found = cleaned(spark, rows, short_tokens=4)
    assert [d for d, r in sorted(found.items()) if r.dropped] == list(range(1, 12))
    assert all(found[i].text == "" for i in range(1, 12)) and found[0].text == log.format("alpha")
    assert all(r.dropped == 0 for r in cleaned(spark, rows[:9], short_tokens=4).values())
    assert all(r.dropped == 0 for r in cleaned(spark, rows).values())


# N-gram join


def test_choose_bands():
    bands, rows = choose_bands(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= 128


def brute(rows, size=5, threshold=0.8):
    """Links by their definition: rows (doc_id, text) to ({row: links}, {row: class})."""
    words = [tuple((t or "").lower().split()) for _, t in rows]
    sets = [{w[i : i + size] for i in range(len(w) - size + 1)} or {w} for w in words]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            long = len(words[i]) >= size and len(words[j]) >= size
            near = long and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold - 1e-12
            if words[i] == words[j] or near:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least.setdefault(find(i), []).append(doc_id)
    return links, [min([d for d in least[find(i)] if d is not None], default=None) for i in range(len(rows))]


def near_copies(seed=1, groups=6, copies=9):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    rows = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(30, 150))
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append(" ".join(text))
    rows += [rows[0].upper(), rows[0] + "  ", None, "", "a b", "a b", "a c", " ".join(rng.choices(vocabulary, k=30_000))]
    return list(enumerate(rows))


@pytest.mark.parametrize("limits", [{}, {"block_texts": 3}, {"block_words": 200}])
def test_ngram_join_same_as_brute_force(spark, limits):
    rows = near_copies() + [(None, "a b"), (None, "no id here at all"), (3, near_copies()[3][1])]
    links, classes = brute(rows)
    found = ngram_join(clashing(docs(spark, rows), *NAMES), **limits).collect()
    assert sorted(((r.doc_id, r.links, r.class_id) for r in found), key=str) == sorted(((d, n, c) for (d, _), n, c in zip(rows, links, classes, strict=True)), key=str)
    assert all(r.keeps == (r.doc_id == r.class_id) for r in found)
    kept = [r.class_id for r in found if r.keeps]
    assert set(kept) == set(classes)


def test_ngram_join_of_the_test_table(spark):
    rows = [(r[0], r[1]) for r in duck(SF).sql("SELECT doc_id, text FROM documents").fetchall()]
    links, classes = brute(rows)
    found = by_id(queries.QUERIES["op2_ngram_join"](spark, SF))
    assert {d: (r.links, r.class_id) for d, r in found.items()} == {d: (n, c) for (d, _), n, c in zip(rows, links, classes, strict=True)}


def test_ngram_join_of_nothing(spark):
    assert ngram_join(docs(spark, [])).collect() == []


def test_verify_counts_a_pair_in_its_first_bucket_only():
    sets = [np.arange(10, dtype=np.uint64), np.arange(9, dtype=np.uint64), np.arange(50, 60, dtype=np.uint64)]
    own = [np.array([1, 2]), np.array([1, 2]), np.array([2])]
    side = np.zeros(3, np.int64)
    assert verify(1, sets[:2], own[:2], side[:2], 0.8).sum() == 2
    assert verify(2, sets, own, side, 0.8).sum() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    root = {i: i for e in edges for i in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: find(i) for i in root if find(i) != i}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
