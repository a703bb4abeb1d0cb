"""Document-frequency statistics, shared by indexes: rows (term, df) and two counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Corpus:
    """``terms``: (term, df), df above 0. ``added`` and ``removed`` count documents over the corpus's life: their
    difference is the number of documents, their sum a generation that changes with every change. The counters may
    be given as functions, which are called when they are first needed."""

    def __init__(self, terms: DataFrame, added: int | Callable[[], int], removed: int | Callable[[], int] = 0) -> None:
        self.terms, self._added, self._removed = terms, added, removed

    @staticmethod
    def empty(spark: SparkSession) -> Corpus:
        return Corpus(spark.createDataFrame([], "term string, df bigint"), 0)

    @staticmethod
    def of(bags: DataFrame) -> Corpus:
        """Statistics of a table of bags; keys without a counted term are no documents of the corpus."""
        present = bags.where("tf > 0")
        terms = present.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        return Corpus(terms, lambda: present.select("key").distinct().count())

    @staticmethod
    def of_folded(rows: DataFrame) -> Corpus:
        """Statistics of bags in the folded form, with a row for each key. Terms are counted where the rows are, so that
        what is shuffled has a row per term and task."""
        terms = rows.select(F.explode_outer("terms").alias("term")).where(F.col("term").isNotNull()).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        return Corpus(terms, lambda: rows.where(F.size("terms") > 0).count())

    @property
    def added(self) -> int:
        if callable(self._added):
            self._added = self._added()
        return self._added

    @property
    def removed(self) -> int:
        if callable(self._removed):
            self._removed = self._removed()
        return self._removed

    @property
    def doc_num(self) -> int:
        return self.added - self.removed

    @property
    def generation(self) -> int:
        return self.added + self.removed

    def meta(self) -> DataFrame:
        row = (self.added, self.removed, self.doc_num, self.generation)
        return self.terms.sparkSession.createDataFrame([row], "add_num long, sub_num long, doc_num long, gen_num long")

    def vocab_size(self) -> DataFrame:
        return self.terms.agg(F.count(F.lit(1)).alias("vocab_size"))

    def lookup(self, terms: list[str]) -> DataFrame:
        """df of each of a few terms, 0 where absent."""
        asked = self.terms.sparkSession.createDataFrame([(t,) for t in terms], "term string")
        held = self.terms.where(F.col("term").isin(terms))
        return asked.join(held, "term", "left").select("term", F.coalesce("df", F.lit(0)).cast("long").alias("df"))

    def add(self, bags: DataFrame) -> Corpus:
        return self.merge(Corpus.of(bags))

    def remove(self, bags: DataFrame) -> Corpus:
        """Without the documents of ``bags``; terms whose df would not stay positive go."""
        gone = Corpus.of(bags)
        both = self.terms.join(gone.terms.withColumnRenamed("df", "less"), "term", "left")
        left = both.select("term", (F.col("df") - F.coalesce("less", F.lit(0))).alias("df")).where("df > 0")
        return Corpus(left, lambda: self.added, lambda: self.removed + gone.added)

    def merge(self, other: Corpus) -> Corpus:
        both = self.terms.unionByName(other.terms).groupBy("term").agg(F.sum("df").alias("df"))
        return Corpus(both, lambda: self.added + other.added, lambda: self.removed + other.removed)

    def delta(self, other: Corpus) -> Corpus:
        """Terms more frequent here than in ``other``, by how much; the counters stay this corpus's."""
        both = self.terms.join(other.terms.withColumnRenamed("df", "less"), "term", "left")
        more = both.select("term", (F.col("df") - F.coalesce("less", F.lit(0))).alias("df")).where("df > 0")
        return Corpus(more, lambda: self.added, lambda: self.removed)
