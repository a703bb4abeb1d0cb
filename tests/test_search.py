"""Published and derived values on a small corpus, properties, and edge cases of the search engine."""

from __future__ import annotations

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.functions.text import tokens
from termloom.functions.weights import EXACT, F16, U16, U32, plain_idf
from termloom.operators import hits
from termloom.operators.batch import batch_search
from termloom.operators.corpus import Corpus
from termloom.operators.search import BM25, Contains, Cosine, Dot, search, similarity
from termloom.plans.query import And, Everything, Not, Nothing, Or, Term, all_of, any_of, parse
from termloom.sources.index import Index
from termloom.sources.segments import Segments

DOCS = {
    "doc1": ["rust", "高速", "並列", "rust"],
    "doc2": ["rust", "柔軟", "安全", "rust"],
    "doc3": ["rust", "高速", "並列", "rust"],
    "doc4": ["rust", "高速", "安全", "抽象"],
}


def index_of(spark, *keys, corpus=None, engine=EXACT):
    rows = spark.createDataFrame([(k, DOCS[k]) for k in keys], "key string, terms array<string>")
    return Index.build(rows, "key", terms="terms", corpus=corpus, engine=engine)


def found(df):
    return {r.key: r.score for r in df.collect()}


@pytest.fixture(scope="module")
def small(spark):
    """doc1 and doc2 added, doc1 deleted, doc3 added."""
    index = index_of(spark, "doc1", "doc2").delete(spark.createDataFrame([("doc1",)], "key string"))
    return index.upsert(spark.createDataFrame([("doc3", DOCS["doc3"])], "key string, terms array<string>"), "key", terms="terms")


def test_state_after_changes(small):
    df = {r.term: r.df for r in small.corpus.terms.collect()}
    assert df == {"rust": 2, "高速": 1, "並列": 1, "柔軟": 1, "安全": 1}
    assert small.corpus.doc_num == 2 and (small.corpus.added, small.corpus.removed) == (3, 1) and small.corpus.generation == 4
    idf = {r.term: r.idf for r in small.idf().collect()}
    assert idf["rust"] == pytest.approx(2 / 3) and idf["柔軟"] == 1


@pytest.mark.parametrize(("engine", "query", "score"), [(F16, ("rust", "安全"), 0.768706), (EXACT, ("rust", "安全"), 0.808608), (F16, ("柔軟", "安全"), 0.904534), (EXACT, ("柔軟", "安全"), 0.727607)])
def test_cosine_values(small, engine, query, score):
    got = found(search(small.with_engine(engine), Cosine(), Term(query[0]) & Term(query[1])))
    assert got == {"doc2": pytest.approx(score, abs=1e-6)}


@pytest.mark.parametrize(("engine", "scores"), [(F16, (0.640184, 0.569803)), (EXACT, (0.724882, 0.569803))])
def test_merged_cosine_values(spark, small, engine, scores):
    merged = small.merge(index_of(spark, "doc4")).with_engine(engine)
    got = found(search(merged, Cosine(), Term("rust") & Term("高速")))
    assert got == {"doc3": pytest.approx(scores[0], abs=1e-6), "doc4": pytest.approx(scores[1], abs=1e-6)}


def test_scalar_values(spark):
    counts = spark.range(1, 21).select(F.col("id").alias("tf"))
    decoded = [r[0] for r in counts.select(F16.decode(F16.encode(F.col("tf")))).collect()]
    assert decoded == [1, 1, 3, 4, 5, 5, 7, 7, 9, 9, 10, 12, 12, 14, 15, 16, 17, 17, 19, 20]
    odd = spark.createDataFrame([(0,), (70000,), (2**33 + 5,), (5 * 10**9,)], "tf long")
    assert [r[0] for r in odd.select(U16.encode(F.col("tf"))).collect()] == [0, 4464, 5, 5 * 10**9 % 65536]
    assert [r[0] for r in odd.select(U32.decode(U32.encode(F.col("tf")))).collect()] == [0, 70000, 5, 5 * 10**9 % 2**32]
    assert [r[0] for r in odd.select(F16.decode(F16.encode(F.col("tf")))).collect()][::3] == [0, 4294967295]
    idf = spark.range(1).select((plain_idf(F.lit(2339298), F.lit(119)).cast("double") ** 2).alias("m")).first().m
    assert idf == pytest.approx(380021899.452305)


def test_bm25_values(spark):
    """Published scores of one term at 2,339,298 documents, df 119 and a mean length of 2961.292."""
    rows = [("a", 20, 2448), ("b", 3, 131)]
    postings = spark.createDataFrame([(k, "llm", tf, n) for k, tf, n in rows], "key string, term string, tf long, doc_len long")
    docs = spark.createDataFrame([(k, n, 1) for k, _, n in rows], "key string, doc_len long, n_terms long")
    vocab = spark.createDataFrame([("llm",)], "term string")
    corpus = Corpus(spark.createDataFrame([("llm", 119)], "term string, df long"), 2339298)
    index = Index(postings, docs, vocab, corpus, facts=(2, 2961.292))
    assert found(search(index, BM25(), Term("llm"))) == {"a": pytest.approx(20.653216, abs=1e-5), "b": pytest.approx(19.520232, abs=1e-5)}
    assert found(search(index, Dot(), Term("llm")))["a"] == pytest.approx(20 * 380021899.452305)


def test_empty_and_unknown(spark):
    rows = spark.createDataFrame([("e", []), ("f", ["x"]), ("g", ["x", "y"])], "key string, terms array<string>")
    index = Index.build(rows, "key", terms="terms")
    assert index.corpus.doc_num == 2 and index.doc_num == 3
    assert found(search(index, Cosine(), Everything())) == {"e": 0, "f": 0, "g": 0}
    assert found(search(index, Cosine(), ~Term("y"))) == {"e": 0, "f": 0}
    assert found(search(index, Dot(), ~Term("zzz"))).keys() == {"e", "f", "g"}
    for query in (Nothing(), any_of([]), all_of([]), Term("zzz"), all_of(["x", "zzz"])):
        assert found(search(index, BM25(), query)) == {}
    assert found(similarity(index, Dot(), {})) == {}
    # df + 1 above N: a negative weight.
    assert found(search(index, BM25(), Term("x")))["f"] < 0


def test_contains_passes_over_structure(small):
    assert found(search(small, Contains(), Term("柔軟") & Term("高速"))) == {"doc2": 1.0, "doc3": 1.0}
    assert found(similarity(small, Contains(), {"柔軟": 3}, Term("高速"))) == {"doc2": 1.0}


def test_filter_takes_the_place_of_the_bag(small):
    assert found(similarity(small, Dot(), {"柔軟": 3}, Term("高速"))) == {"doc3": 0.0}


def test_query_counts(small):
    once, twice = found(similarity(small, Dot(), {"rust": 1})), found(similarity(small, Dot(), {"rust": 2}))
    assert twice == {k: pytest.approx(2 * v) for k, v in once.items()}
    assert found(similarity(small, BM25(), {"rust": 1})) == found(similarity(small, BM25(), {"rust": 5}))
    assert found(search(small, Dot(), Term("rust") & Term("rust"))) == twice


def test_zero_divisor_is_nan(spark, small):
    zero = small.with_engine(F16)
    postings = zero.postings.withColumn("tf", F.lit(0).cast("long"))
    got = search(Index(postings, zero.docs, zero.vocab, zero.corpus, facts=(2, 4.0)), BM25(k1=0.0), Term("rust"))
    assert all(math.isnan(r.score) for r in got.collect())
    assert tuple(hits.counts(got).first()) == (0, 0, 2)
    assert hits.sort_by_score(got).collect() == [] and len(hits.sort_by(got, "key").collect()) == 2


def test_deleted_terms_stay_in_the_vocabulary(spark, small):
    gone = small.delete(spark.createDataFrame([("doc2",), ("never",)], "key string"))
    idf = {r.term: (r.df, r.idf) for r in gone.idf().collect()}
    assert idf["柔軟"] == (0, gone.corpus.doc_num)
    terms = spark.createDataFrame([("柔軟",), ("none",)], "term string")
    assert {r.term: r.has for r in gone.contains_terms(terms).collect()} == {"柔軟": True, "none": False}


def test_properties_of_changes(spark, small):
    rows = spark.createDataFrame([("doc2", DOCS["doc2"])], "key string, terms array<string>")
    again = small.upsert(rows, "key", terms="terms")
    assert sorted(again.bags.collect()) == sorted(small.bags.collect())
    assert again.corpus.doc_num == small.corpus.doc_num and again.corpus.generation == small.corpus.generation + 2
    assert sorted(again.corpus.terms.collect()) == sorted(small.corpus.terms.collect())
    four = index_of(spark, "doc4")
    assert sorted(small.merge(four).bags.collect()) == sorted(four.merge(small).bags.collect())
    back = small.merge(four).delete(spark.createDataFrame([("doc4",)], "key string"))
    assert sorted(back.bags.collect()) == sorted(small.bags.collect())
    assert sorted(back.corpus.terms.collect()) == sorted(small.corpus.terms.collect())


def test_repeated_keys_are_one_document(spark):
    rows = spark.createDataFrame([("a", "x y"), ("a", "z"), ("b", None)], "key string, text string")
    index = Index.build(rows, "key", "text")
    assert index.doc_num == 2 and {r.term for r in index.bags.where("key = 'a'").collect()} in ({"x", "y"}, {"z"})


def test_snapshots(spark, small, tmp_path):
    saved = small.save(str(tmp_path / "own"), buckets=3)
    query = Term("rust") | ~Term("柔軟")
    for algorithm in (Cosine(), Dot(), BM25()):
        assert found(search(saved, algorithm, query)) == pytest.approx(found(search(small, algorithm, query)))
    small.save(str(tmp_path / "bare"), with_corpus=False)
    with pytest.raises(ValueError):
        Index.load(spark, str(tmp_path / "bare"))
    other = Corpus(spark.createDataFrame([("rust", 9)], "term string, df long"), 100)
    loaded = Index.load(spark, str(tmp_path / "bare"), other)
    assert found(search(loaded, Dot(), Term("rust")))["doc2"] == pytest.approx(2 * 100.0)
    plan = saved.of_terms(["rust"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(term_bucket" in plan or "PartitionFilters: [(term_bucket" in plan or "term_bucket" in plan.split("PartitionFilters")[1][:200]


@pytest.fixture(scope="module")
def four(spark, small, tmp_path_factory):
    return small.merge(index_of(spark, "doc1", "doc4")).save(str(tmp_path_factory.mktemp("four") / "index"), buckets=2)


BATCH_BAGS = {1: {"rust": 2, "安全": 1}, 2: {"高速": 1, "並列": 3}, 3: {"none": 1}, 4: {"柔軟": 1, "rust": 1}}


@pytest.mark.parametrize("algorithm", [Dot(), Cosine(), BM25(k1=0.5, b=0.2)])
@pytest.mark.parametrize("engine", [EXACT, F16])
def test_batch_search_is_single_searches(spark, four, monkeypatch, algorithm, engine):
    from termloom.operators import batch

    monkeypatch.setattr(batch, "BLOCK_TERMS", 3)
    monkeypatch.setattr(batch, "CELLS", 4)
    index = four.with_engine(engine)
    queries = spark.createDataFrame([(i, t, q) for i, bag in BATCH_BAGS.items() for t, q in bag.items()], "query int, term string, q long")
    for k in (2, 10):
        got = {}
        for r in batch_search(index, algorithm, queries, k, digits=9).collect():
            got.setdefault(r.query, []).append((r.place, r.key, pytest.approx(r.score, abs=1e-8), r.doc_len))
        for number, bag in BATCH_BAGS.items():
            hits_of = [(-round(r.score, 9), r.key, r.doc_len) for r in similarity(index, algorithm, bag).collect()]
            want = [(i + 1, key, -score, n) for i, (score, key, n) in enumerate(sorted(hits_of)[:k])]
            assert sorted(got.get(number, []), key=lambda r: r[0]) == want


def test_batch_search_of_a_stored_index(spark, small, tmp_path):
    stored = small.merge(index_of(spark, "doc4")).save(str(tmp_path / "batch"), buckets=3)
    queries = spark.createDataFrame([("q", "rust", 1), ("q", "高速", 1)], "query string, term string, q long")
    got = {r.key: r.score for r in batch_search(stored, Cosine(), queries, 5).collect()}
    assert got == pytest.approx(found(similarity(stored, Cosine(), {"rust": 1, "高速": 1})))
    assert batch_search(stored, Dot(), queries.limit(0), 5).collect() == []


def test_display(spark):
    frame = spark.createDataFrame([('a"b\\c', 0.1234567, 7)], "key string, score double, doc_len long")
    assert hits.display(frame, digits=2).first().line.startswith("score: 0.12\t")
    assert hits.display(frame).first().line == 'score: 0.123457\tdoc_len: 7\tkey: "a\\"b\\\\c"'


def test_display_rounds_as_printf_does(spark):
    import random

    rng = random.Random(7)
    values = [0.125, 0.375, 1.005, 2.675, 0.015, -0.125, -0.005, -0.001, 0.0, 0.995, 1e-320, 123456.125, 7e12 + 0.125, 1e17]
    values += [round(rng.uniform(-20, 20), 6) for _ in range(300)] + [rng.randrange(-9999, 9999) / 1000 + 0.0005 * rng.randrange(2) for _ in range(300)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in enumerate(values)], "key long, score double, doc_len long")
    for digits in (0, 2, 3, 6):
        shown = [r.line.split("\t")[0] for r in hits.display(frame.repartition(1).orderBy("key"), digits=digits).collect()]
        assert shown == [f"score: {v:.{digits}f}" for v in values]


def test_unchecked_search_keeps_old_weights(spark, small, tmp_path):
    frozen = small.freeze(str(tmp_path / "weights"))
    before = found(search(frozen, Dot(), Term("rust")))
    grown = frozen.merge(index_of(spark, "doc4"))
    old, new = found(search(grown, Dot(), Term("rust"), check=False)), found(search(grown, Dot(), Term("rust")))
    assert {k: old[k] for k in before} == pytest.approx(before) and old["doc4"] == pytest.approx((2 / 3) ** 2)
    assert new != pytest.approx(old)
    assert found(search(grown, Dot(), Term("抽象"), check=False)) == {"doc4": 0.0}  # has come since
    assert found(search(grown, BM25(), Term("抽象"), check=False)) == {"doc4": 0.0}
    want = sum((2 / 3) ** 2 for _ in "x")
    lengths = math.sqrt(want) * math.sqrt(want + 2 * 1.0 + 0.0)
    assert found(search(grown, Cosine(), Term("rust"), check=False))["doc4"] == pytest.approx(want / lengths, abs=1e-6)
    assert found(search(small, Dot(), Term("rust"), check=False)) == found(search(small, Dot(), Term("rust")))  # never frozen


def test_the_last_row_of_a_key_counts(spark):
    rows = spark.createDataFrame([("a", "x", 2), ("a", "z z", 1), ("b", "q", 1), ("b", None, 3)], "key string, text string, at int")
    index = Index.build(rows, "key", "text", order="at")
    assert {(r.key, r.term) for r in index.bags.collect()} == {("a", "x")} and index.doc_num == 2
    again = index.upsert(spark.createDataFrame([("a", "m", 5), ("a", "k", 9)], "key string, text string, at int"), "key", "text", order="at")
    assert {(r.key, r.term) for r in again.bags.collect()} == {("a", "k")}


def test_one_document(spark, small, tmp_path):
    stored = small.save(str(tmp_path / "one"), buckets=4)
    for index in (small, stored):
        assert {r.term: r.tf for r in index.tf("doc2").collect()} == {"rust": 2, "柔軟": 1, "安全": 1}
        assert index.tf("never").collect() == []
    assert {r.term: r.tf for r in stored.with_engine(F16).decoded("doc2").collect()} == {"rust": 1, "柔軟": 1, "安全": 1}
    plan = stored.tf("doc2")._jdf.queryExecution().executedPlan().toString()
    assert "key_bucket" in plan.split("PartitionFilters")[1].split("]")[0]


def test_a_term_that_all_have_is_dealt_to_many_files(spark, tmp_path):
    rows = spark.range(2000).select(F.col("id").alias("key"), F.array(F.lit("all"), F.concat(F.lit("own"), F.col("id").cast("string"))).alias("terms"))
    index = Index.build(rows, "key", terms="terms", unique=True).save(str(tmp_path / "sliced"), buckets=4, slice_rows=100)
    files = index.postings.where("term = 'all'").groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in files) == 2000 and max(r["count"] for r in files) <= 800 and len(files) >= 5
    assert all(r.score == pytest.approx((2000 / 2001) ** 2) for r in search(index, Dot(), Term("all")).collect())
    empty = Index.build(rows.limit(0), "key", terms="terms").save(str(tmp_path / "empty"))
    assert empty.doc_num == 0 and search(empty, BM25(), Term("all")).collect() == [] and empty.buckets == 16


# A stored index in segments


def same_index(one, current, vocab):
    """An index, and one built at once of the same documents."""
    rows = one.docs.sparkSession.createDataFrame(list(current.items()), "key long, text string")
    other = Index.build(rows, "key", "text")
    assert sorted(one.bags.collect()) == sorted(other.bags.collect())
    assert sorted(one.docs.collect()) == sorted(other.docs.collect())
    assert sorted(one.corpus.terms.collect()) == sorted(other.corpus.terms.collect())
    assert one.corpus.doc_num == other.corpus.doc_num and one.mean_len == pytest.approx(other.mean_len)
    assert {r.term for r in one.vocab.collect()} == vocab
    for algorithm in (Cosine(), BM25()):
        query = Term("x") | ~Term("y")
        assert found(search(one, algorithm, query)) == pytest.approx(found(search(other, algorithm, query)))


def test_segments_are_the_index_of_what_is_current(spark, tmp_path):
    root = str(tmp_path / "segments")
    batches = [{1: "x y y", 2: "x", 3: ""}, {2: "z z", 4: "x w", 9: None}, {1: None, 3: "y"}, {1: "new", 2: "x y z"}]
    held, current, vocab = Segments.open(spark, root, buckets=2), {}, set()
    with pytest.raises(ValueError):
        held.index()
    for batch in batches:
        rows = spark.createDataFrame(list(batch.items()), "key long, text string")
        held = held.apply(rows, "key", "text")
        current = {k: t for k, t in (current | batch).items() if t is not None}
        vocab |= {t for text in batch.values() for t in (text or "").split()}
    same_index(Segments.open(spark, root).index(), current, vocab)
    assert (held.added, held.removed, held.doc_num) == (7, 3, 4)  # documents with terms that came and went
    assert held.apply(rows, "key", "text", number=2) is held  # done before
    assert {r.term: r.tf for r in held.index().tf(2).collect()} == {"x": 1, "y": 1, "z": 1}
    packed = held.compact()
    packed.vacuum()
    again = Segments.open(spark, root)
    assert len(again.parts) == 1 and again.index().normed
    same_index(again.index(), current, vocab)
    later = again.delete(spark.createDataFrame([(1,), (77,)], "key long"))
    del current[1]
    same_index(later.index(), current, vocab)
    assert (later.compact().index().corpus.added, later.doc_num) == (7, 3)


def test_a_change_that_failed_leaves_the_state(spark, tmp_path):
    root = str(tmp_path / "failed")
    held = Segments.open(spark, root, buckets=2).upsert(spark.createDataFrame([(1, "x")], "key long, text string"), "key", "text")
    spark.createDataFrame([(1,)], "key long").write.parquet(f"{root}/gone/2")  # of a change that never ended
    assert found(search(Segments.open(spark, root).index(), Dot(), Term("x"))).keys() == {1}
    assert found(search(held.upsert(spark.createDataFrame([(2, "x")], "key long, text string"), "key", "text").index(), Dot(), Term("x"))).keys() == {1, 2}


def test_merging_a_stored_index(spark, tmp_path):
    held = Segments.open(spark, str(tmp_path / "merged"), buckets=2).merge(index_of(spark, "doc1", "doc2"))
    held = held.delete(spark.createDataFrame([("doc1",)], "key string")).merge(index_of(spark, "doc3")).merge(index_of(spark, "doc4"))
    got = found(search(held.index(), Cosine(), Term("rust") & Term("高速")))
    assert got == {"doc3": pytest.approx(0.724882, abs=1e-6), "doc4": pytest.approx(0.569803, abs=1e-6)}
    got = found(search(Segments.open(spark, held.root, engine=F16).compact().index(), Cosine(), Term("rust") & Term("高速")))
    assert got == {"doc3": pytest.approx(0.640184, abs=1e-6), "doc4": pytest.approx(0.569803, abs=1e-6)}


# Queries as trees

TREES = st.recursive(
    st.one_of(st.sampled_from("abc").map(Term), st.just(Nothing()), st.just(Everything())),
    lambda inner: st.one_of(st.tuples(inner, inner).map(lambda p: And(*p)), st.tuples(inner, inner).map(lambda p: Or(*p)), inner.map(Not)),
    max_leaves=6,
)


def holds(query, terms):
    match query:
        case Term(t):
            return t in terms
        case Everything():
            return True
        case Nothing():
            return False
        case Not(inner):
            return not holds(inner, terms)
        case Or(left, right):
            return holds(left, terms) or holds(right, terms)
        case And(left, right):
            return holds(left, terms) and holds(right, terms)


@pytest.fixture(scope="module")
def subsets(spark, tmp_path_factory):
    """One document for each subset of three terms, the empty one too."""
    sets = [[t for j, t in enumerate("abc") if i >> j & 1] for i in range(8)]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "key long, terms array<string>")
    index = Index.build(rows, "key", terms="terms").save(str(tmp_path_factory.mktemp("subsets") / "index"), buckets=2)
    return index, sets


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(TREES)
def test_boolean_search_is_set_algebra(subsets, query):
    index, sets = subsets
    got = found(search(index, Cosine(), query))
    assert got.keys() == {i for i, s in enumerate(sets) if holds(query, s)}
    assert all(0 <= v <= 1 + 1e-9 for v in got.values())


@given(st.lists(st.sampled_from("abcdef"), max_size=12))
def test_folds_keep_all_leaves(terms):
    assert sorted(any_of(terms).leaves()) == sorted(terms) == sorted(all_of(terms).leaves())


def test_parse():
    assert parse("a & b | !c") == Or(And(Term("a"), Term("b")), Not(Term("c")))
    assert parse("a & [b | c]") == And(Term("a"), Or(Term("b"), Term("c")))
    assert parse("!!a") == Not(Not(Term("a"))) and parse(" ") == Nothing()
    for wrong in ("a b", "a &", "[a", "& a", "a ]", "[]"):
        with pytest.raises(ValueError):
            parse(wrong)


def test_tokens(spark):
    rows = spark.createDataFrame([("Don't STOP, 42 naïve Ünï 日本",), ("",), (None,), ("--",)], "t string")
    got = [r[0] for r in rows.select(tokens("t")).collect()]
    assert got == [["don", "t", "stop", "42", "naïve", "ünï", "日本"], [], [], []]


def test_a_build_shuffles_documents_and_postings_once(spark, tmp_path):
    """Texts are counted row by row, and neither a join nor a sum moves the postings again."""
    rows = spark.range(400).select(F.col("id").alias("key"), F.concat_ws(" ", F.lit("the of"), F.concat(F.lit("own"), F.col("id").cast("string"))).alias("text"))
    index = Index.build(rows, "key", "text", unique=True)
    assert "Exchange" not in index.forward._jdf.queryExecution().executedPlan().toString()
    saved = index.save(str(tmp_path / "index"), buckets=4)
    norms = saved.with_engine(F16).norms()
    assert "BroadcastHashJoin" in norms._jdf.queryExecution().executedPlan().toString()
    plain = {r.key: r.norm for r in index.norms().collect()}
    assert {r.key: r.norm for r in saved.norms().collect()} == pytest.approx(plain) and len(plain) == 400
    assert {r.key: r.norm for r in norms.collect()} == pytest.approx(plain)


def test_norms_of_terms_that_are_not_sent(spark, tmp_path, monkeypatch):
    from termloom.sources import index as module

    rows = spark.range(50).select(F.col("id").alias("key"), F.concat_ws(" ", F.lit("the of of"), F.concat(F.lit("own"), F.col("id").cast("string"))).alias("text"))
    plain = {r.key: r.norm for r in Index.build(rows, "key", "text").norms().collect()}
    for number, sent in enumerate((0, 2, 1000)):
        monkeypatch.setattr(module, "SENT_TERMS", sent)
        saved = Index.build(rows, "key", "text").save(str(tmp_path / f"index{number}"), buckets=2)
        assert {r.key: r.norm for r in saved.norms().collect()} == pytest.approx(plain)


def test_a_task_of_batch_search_looks_up_a_bounded_number_of_terms(monkeypatch):
    import pyarrow as pa

    from termloom.operators import batch

    monkeypatch.setattr(batch, "LOOKED_UP", 4)
    rows = pa.record_batch({"key": list(range(7)), "terms": [["a"], ["a", "b", "c"], [], ["d"] * 9, ["e", "f"], ["g", "h"], ["i"]]})
    pieces = list(batch._pieces(rows.slice(0)))
    assert pa.Table.from_batches(pieces).to_pylist() == rows.to_pylist()
    assert all(p.num_rows == 1 or len(p.column("terms").flatten()) <= 4 for p in pieces) and len(pieces) == 4


def test_documents_pass_a_shuffle_with_any_terms(spark, tmp_path):
    held = [(1, ["a\x01b", "c"]), (2, []), (3, ["", "x"]), (4, [""]), (5, ["\x01"]), (6, ["y", "y", "z"]), (7, None)]
    index = Index.build(spark.createDataFrame(held, "key long, terms array<string>"), "key", terms="terms")
    expected = sorted((k, sorted(set(ts or [])), len(ts or [])) for k, ts in held)
    for name, with_corpus in (("full", True), ("bare", False)):
        saved = index.save(str(tmp_path / name), buckets=3, with_corpus=with_corpus)
        assert sorted((r.key, r.terms, r.doc_len) for r in saved.forward.collect()) == expected
        assert sorted(saved.bags.collect()) == sorted(saved.postings.select("key", "term", "tf").collect()) == sorted(index.bags.collect())
    one = spark.createDataFrame([(9, [f"t{i}" for i in range(500)])], "key long, terms array<string>")
    rows = Index.build(one, "key", terms="terms").save(str(tmp_path / "one")).forward
    assert rows.first().n_terms == 500
