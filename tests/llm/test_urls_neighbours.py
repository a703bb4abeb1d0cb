from __future__ import annotations

import numpy as np
import pytest
from helpers import NAMES, SF, clashing
from oracle import duck

from termloom.llm import hnsw, queries
from termloom.llm.neighbours import nearest
from termloom.llm.url_filter import bloom_filter, url_filter

RULES = "host string, path string, verdict string"


# URLs


def judged(spark, urls, rules=queries.URL_RULES, **kwargs):
    pages = clashing(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), "block", "key_host", "verdict", "host")
    found = url_filter(pages, spark.createDataFrame(rules, RULES), **kwargs).collect()
    assert len(found) == len(urls)
    return [found_of[i] for found_of in [{r.page_id: r for r in found}] for i in range(len(urls))]


def test_parts_and_rules(spark):
    cases = [
        ("https://Example.COM/en/a?x#y", "example.com", "/en/a", "example.com/en/", "block"),
        ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://a.www.example.com/en/b", "a.www.example.com", "/en/b", "www.example.com/en/", "allow"),
        ("http://myexample.com/en/", "myexample.com", "/en/", "com/", "allow"),
        ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
        ("http://x.net/es", "x.net", "/es", None, "allow"),
        ("http://net/fr/", "net", "/fr/", "net/fr/", "block"),
        ("ftp://com", "com", "", None, "allow"),
        ("http://com?/q", "com", "", None, "allow"),
        ("http://com#/en/", "com", "", None, "allow"),
        ("a://b://c.com/x", "b:", "//c.com/x", None, "allow"),
        ("no scheme.com/en/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("http://user@x.com:80/p\nq?r", "user@x.com:80", "/p\nq", None, "allow"),
        ("http://com/" + "z" * 100_000, "com", "/" + "z" * 100_000, "com/", "allow"),
        ("http://É.COM/È", "É.com", "/È", "com/", "allow"),
        ("http://.com/", ".com", "/", "com/", "allow"),
    ]
    for (_, *want), r in zip(cases, judged(spark, [c[0] for c in cases]), strict=True):
        assert [r.host, r.path, r.rule, r.verdict] == want


def test_longest_rule_wins_and_block_wins_ties(spark):
    rules = [("a.b", "/", "block"), ("b", "/xyz", "allow"), ("b", "", "block"), ("a.b", "/", "allow")]
    found = judged(spark, ["http://a.b/xyz", "http://a.b/", "http://b/", "http://b"], rules)
    assert [(r.rule, r.verdict) for r in found] == [("b/xyz", "allow"), ("a.b/", "block"), ("b", "block"), ("b", "block")]
    assert [r.verdict for r in judged(spark, ["http://a.b/"], [], default_verdict="block")] == ["block"]


def test_full_filter_passes_more_but_not_wrong(spark):
    rules = [(f"h{i}.org", "/", "block") for i in range(300)]
    found = judged(spark, [f"http://h{i}.org/x" for i in range(600)], rules, max_filter_bytes=64)
    assert [r.verdict for r in found] == ["block"] * 300 + ["allow"] * 300


def test_bloom_filter_is_bounded_and_has_no_false_negatives(spark):
    keys = spark.createDataFrame([(f"h{i}", "/") for i in range(500)], "key_host string, key_path string")
    blooms, blocks = bloom_filter(keys, max_bytes=256)
    assert blocks == 4 and blooms.count() <= 4


def test_repeated_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://x.net/es/"), (1, "http://x.net/es/"), (None, "http://x.net/es/")], "page_id long, url string")
    rules = spark.createDataFrame(queries.URL_RULES, RULES)
    assert [r.verdict for r in url_filter(pages, rules).collect()] == ["block"] * 3
    assert url_filter(pages.limit(0), rules).collect() == []


# Nearest neighbours


def brute(rows, mod, k=10):
    out = {}
    usable = {}
    for vec_id, v in rows:
        if vec_id is None or v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        usable[vec_id] = np.asarray(v, np.float32).astype(np.float64)
    for q, v in usable.items():
        if q % mod == 0:
            near = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in usable.items() if i != q and len(w) == len(v))
            out[q] = near[:k]
    return out


def hits(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_recall_on_the_test_table(spark, sf):
    rows = duck(sf).sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    want, found = brute(rows, 100), hits(queries.QUERIES["op7_neighbours"](spark, sf))
    assert found.keys() == want.keys()
    both = sum(len({i for _, i in want[q]} & {i for _, i in found[q]}) for q in want)
    assert both >= 0.97 * sum(len(w) for w in want.values())
    for q, near in found.items():
        exact = dict((i, s) for s, i in brute(rows, 10**9 + 7).get(q, []))
        assert near == sorted(near) and all(abs(exact.get(i, s) - s) < 1e-12 for s, i in near)


def test_shards_are_merged(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(3000)]
    want, found = brute(rows, 100), hits(nearest(frame(spark, rows), shard_bytes=150_000, query_block=7))
    both = sum(len({i for _, i in want[q]} & {i for _, i in found[q]}) for q in want)
    assert both >= 0.97 * 10 * len(want)


def test_odd_vectors_ties_and_copies(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    rows += [(i, [1.0, 0.0]) for i in range(20, 60)] + [(60, [2.0, 0.0]), (61, [0.0, 0.5]), (100, [0.0, 1.0]), (200, [1.0, 1.0, 0.0]), (0, [1.0, 0.0])]
    data = clashing(frame(spark, rows), "query_id", "rank", "vector", "hash")
    found, want = hits(nearest(data)), brute(rows, 100)
    assert {q: [i for _, i in w] for q, w in found.items()} == {q: [i for _, i in w] for q, w in want.items()}
    assert all([s for s, _ in found[q]] == pytest.approx([s for s, _ in want[q]]) for q in want)
    assert found[0] == [(0.0, i) for i in [1, *range(20, 29)]]
    assert nearest(frame(spark, [])).collect() == []
    assert nearest(frame(spark, [(100, [1.0])])).collect() == []
    assert hits(nearest(frame(spark, [(100, [1.0]), (1, [3.0])]))) == {100: [(2.0, 1)]}


def test_double_vectors_keep_their_precision(spark):
    rows = [(0, [1.0, 1e-9]), (1, [1.0, 3e-9]), (2, [1.0, 2e-9])]
    found = hits(nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert [i for _, i in found[0]] == [2, 1]


def test_every_node_can_be_reached():
    rng = np.random.default_rng(3)
    vectors = np.concatenate([rng.normal(size=(500, 8)), rng.normal(size=(500, 8)) * 1e-3 + 5]).astype(np.float32)
    level = np.sort(hnsw.levels(rng.integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2), 16))[::-1]
    graph = hnsw.build(vectors[rng.permutation(1000)], level)
    nearest_found = graph.search(graph.vectors, 64)[:, 0]
    assert (nearest_found >= 0).all() and np.allclose(graph.vectors[nearest_found], graph.vectors, atol=1e-6)
    assert [layer.shape[1] for layer in graph.links] == [32] + [16] * (len(graph.links) - 1)


@pytest.mark.parametrize("kind", ["normal", "clusters", "line"])
def test_search_in_step_finds_what_brute_force_finds(kind):
    rng = np.random.default_rng(5)
    n, dim = 4000, 24
    vectors = rng.normal(size=(n, dim))
    if kind == "clusters":
        vectors = rng.normal(size=(8, dim))[rng.integers(0, 8, n)] * 10 + vectors * 0.01
    if kind == "line":
        vectors = np.outer(rng.permutation(n), np.ones(dim))
    level = np.sort(hnsw.levels(rng.integers(0, 2**62, n).astype(np.uint64) * np.uint64(4), 16))[::-1]
    vectors = vectors.astype(np.float32)
    graph = hnsw.build(vectors, level)
    asked = vectors[:200]
    found = graph.search(asked, 160)
    exact = ((asked[:, None, :].astype(np.float64) - vectors[None]) ** 2).sum(axis=2).argsort(axis=1, kind="stable")[:, :10]
    assert np.mean([len(set(e) & set(f)) for e, f in zip(exact.tolist(), found.tolist(), strict=True)]) >= 9.7
    assert all(len(set(row)) == len(row) for row in found.tolist())  # a node is found once


def test_graph_of_few_nodes():
    for n in (1, 2, 3):
        graph = hnsw.build(np.eye(4, dtype=np.float32)[:n], np.zeros(n, np.int64))
        assert sorted(graph.search(np.eye(4, dtype=np.float32)[:1], 20)[0][:n].tolist()) == list(range(n))


def test_an_id_with_several_vectors_has_one_answer(spark):
    rows = [(100, [1.0, 0.0]), (100, [5.0, 0.0]), (1, [1.0, 1.0]), (1, [5.0, 0.5]), (2, [3.0, 0.0]), (200, [9.0, 0.0]), (200, [9.0, 0.0])]
    found = hits(nearest(frame(spark, rows)))
    assert found[100] == [(0.5, 1), (2.0, 2), (4.0, 200)]
    assert found[200] == [(4.0, 100), (pytest.approx(np.hypot(4, 0.5)), 1), (6.0, 2)]
    one = hits(nearest(frame(spark, rows), shard_bytes=300, query_block=1))
    assert one == found
