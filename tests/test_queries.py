"""Every registered query of the search engine against its SQL."""

from __future__ import annotations

import pytest
from oracle import assert_same

import __spark_entry__ as entry
from termloom import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_as_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SF), registry.ORACLES[name], SF)


def test_every_query_has_sql():
    assert registry.QUERIES.keys() == registry.ORACLES.keys()


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["doc_id", "score", "doc_len"] and found.count() == 10
    assert entry.queries().keys() >= registry.QUERIES.keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_sorted_hits_are_sorted(spark):
    def scores(name):
        return [(r.score, r.doc_id) for r in registry.QUERIES[name](spark, SF).collect()]

    assert scores("hits_sort_desc") == sorted(scores("hits_sort_desc"), key=lambda x: (-x[0], x[1]))
    assert scores("hits_sort_asc") == sorted(scores("hits_sort_asc"))
    assert scores("topk_bm25") == scores("hits_sort_desc")[:10]
    by_length = [(-r.doc_len, r.doc_id) for r in registry.QUERIES["hits_sort_by"](spark, SF).collect()]
    assert by_length == sorted(by_length)
    titles = [("src1" not in r.title, -r.score, r.title) for r in registry.QUERIES["hits_title_sort"](spark, SF).collect()]
    assert titles == sorted(titles)


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    shutil.copytree(root / "termloom", tmp_path / "termloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin"})
    assert said.stdout.split() == [str(len(registry.QUERIES))] * 2


def test_the_rest_stands_without_a_library_of_theirs():
    import subprocess
    import sys
    from pathlib import Path

    code = (
        "import sys; sys.modules['tokenizers'] = sys.modules['xxhash'] = sys.modules['public_tokenizers'] = None\n"
        "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    )
    root = Path(entry.__file__).parent
    said = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin"})
    assert said.stdout.split() == [str(len(registry.QUERIES))] * 2


def test_a_table_that_is_written_anew_is_indexed_anew(spark, tmp_path):
    def write(text):
        spark.createDataFrame([(1, text)], "doc_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        return {r.term for r in registry.QUERIES["tf_postings"](spark, str(tmp_path)).collect()}

    assert write("first words") == {"first", "words"}
    assert write("others") == {"others"}
