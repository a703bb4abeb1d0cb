"""The pipeline, stage by stage, against brute force on what each stage was given."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest
from helpers import NAMES, SF, clashing, docs
from test_dedup import brute
from test_packing_mixing import check_packing

import corpus_pipeline
from termloom.llm import queries
from termloom.llm.mixing import mix
from termloom.llm.quality import score_quality


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """For each stage, its input and its output, both as written tables."""
    out, read = {}, f"{SF}/documents.parquet"
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, spark.read.parquet(read), SF).write.parquet(path)
        out[name] = (read, path)
        read = path
    return {name: tuple(spark.read.parquet(p) for p in paths) + paths for name, paths in out.items()}


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mixing", "packing"]
    for name, (given, made, *_) in stages.items():
        if name != "packing":
            assert made.dtypes == given.dtypes and made.count() > 0.4 * given.count()


def test_quality_drops_what_is_rejected_only(spark, stages):
    given, made, *_ = stages["quality"]
    kept = {r.doc_id for r in score_quality(given, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    assert rows(made) == Counter(t for t in rows(given).elements() if t[0] in kept)
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").join(made, "doc_id").count()
    assert labels <= 0.3 * spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").count()


def test_lines_like_sql(stages):
    given, made, read, _ = stages["lines"]
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{read}/*.parquet')")
    want = {r[0]: (r[1], r[3]) for r in connection.sql(queries.OP1_SQL).fetchall()}
    whole = {r.doc_id: r for r in given.collect()}
    got = {r.doc_id: r for r in made.collect()}
    assert got.keys() == {d for d, (text, gone) in want.items() if not gone or text.split()}
    for doc_id, r in got.items():
        assert r.text == want[doc_id][0]
        assert r.n_chars == (len(r.text) if want[doc_id][1] else whole[doc_id].n_chars)
        assert (r.lang, r.source) == (whole[doc_id].lang, whole[doc_id].source)


def test_one_of_each_class_stays(stages):
    given, made, *_ = stages["near_duplicates"]
    own = [(r.doc_id, r.text) for r in given.collect()]
    _, classes = brute(own)
    assert {r.doc_id for r in made.collect()} == set(classes)
    assert rows(made) == Counter(t for t in rows(given).elements() if t[0] in set(classes))


def test_mix_takes_what_it_says(stages):
    given, made, *_ = stages["mixing"]
    times = {r.doc_id: len(r.shards) for r in mix(given).documents.collect()}
    assert rows(made) == Counter({tuple(r): times[r.doc_id] for r in given.collect() if times[r.doc_id]})


def test_packing_round_trip(stages):
    given, made, *_ = stages["packing"]
    assert check_packing(made.collect(), [(r.doc_id, r.text) for r in given.collect()]) < 0.05


def test_run_is_the_stages(spark, stages):
    """Equal but for the places that the order of the scan gives."""
    facts = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert rows(corpus_pipeline.run(spark, SF).select(*facts)) == rows(stages["packing"][1].select(*facts))


def test_stages_on_odd_documents(spark, tmp_path):
    words = " ".join(f"w{c}{d}" for c in "abcdef" for d in "uvxyz")
    odd = [(1, words), (1, words), (2, words), (3, None), (4, ""), (None, "no id"), (5, "z" * 50_000), (6, "\n\n"), (7, words + "\n" + words)]
    frame = clashing(docs(spark, odd), *NAMES)
    spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for given in (frame, frame.limit(0)):
            made = stage(spark, given, str(tmp_path))
            assert made.collect() is not None and (name == "packing" or made.columns == frame.columns)
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, "").collect()]
    assert set(kept) == {1, 3, None, 5} and kept.count(1) == 2
    left = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, frame, "").collect()}
    assert left.keys() == {1, 3, 4, None, 5, 6} and left[3] is None and left[6] == "\n\n"


def test_near_duplicates_go_by_row(spark):
    """Rows that share an id, or have none, go or stay by their own texts."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    near = one.replace("a29", "other")

    def stays(own):
        frame = clashing(docs(spark, own), *NAMES)
        made = corpus_pipeline.near_duplicates(spark, frame, "")
        assert made.columns == frame.columns
        return sorted(((r.doc_id, r.text) for r in made.collect()), key=str)

    assert stays([(1, one), (2, one), (2, two)]) == [(1, one), (2, two)]
    assert stays([(1, one), (2, near), (2, two), (2, two)]) == [(1, one), (2, two), (2, two)]
    assert stays([(1, one), (None, one), (None, near), (None, three)]) == [(1, one), (None, three)]
    assert stays([(None, one), (None, near), (None, None)]) == sorted([(None, None), (None, one), (None, near)], key=str)


def test_run_leaves_the_last_documents_only(spark):
    from termloom.sources.workspace import children, shared_dir

    root = f"{shared_dir(spark)}/termloom"
    before = set(children(spark, root))
    corpus_pipeline.run(spark, SF)
    left = sorted(name.rpartition("-")[0] for name in set(children(spark, root)) - before)
    assert left == ["pack-counts", "pack-pieces", "pipeline-mixing"]
