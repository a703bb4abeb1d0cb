"""An index on shared storage that is changed by adding segments: a change costs what it changes, not what is there.

A segment is a stored index of the documents that came in one change. A change also writes the keys that it puts in
place or deletes (gone in all earlier segments), and how it alters the document frequencies. Reading joins the
postings that a query needs with the gone keys, and sums the alterations of the query's terms. ``compact`` writes all
that is current as one segment, with norms; ``vacuum`` deletes what is no longer read.

The state is a small manifest, written last and in a new folder, so that a change that fails leaves the state as it
was, and readers see a change as a whole. There must be one writer at a time.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.weights import EXACT, Engine
from termloom.operators.corpus import Corpus
from termloom.sources.index import Index, unfold
from termloom.sources.workspace import children, remove

KINDS = ("segment", "gone", "terms")
#: Most keys that are sent to all executors, so that the documents that they are looked up in are not shuffled.
SENT_KEYS = 1 << 20


def _sent(keys: DataFrame) -> DataFrame:
    """Stored keys: broadcast if there are ``SENT_KEYS`` at most, otherwise to be joined as Spark sees fit."""
    return F.broadcast(keys) if keys.count() <= SENT_KEYS else keys


@dataclass(frozen=True)
class Segments:
    """``parts``: numbers of the changes whose segments are read, oldest first; ``gone`` those with gone keys; ``terms``
    those with alterations of document frequencies. ``number`` is the last change."""

    spark: SparkSession
    root: str
    buckets: int
    number: int = 0
    parts: tuple[int, ...] = ()
    gone: tuple[int, ...] = ()
    terms: tuple[int, ...] = ()
    added: int = 0
    removed: int = 0
    doc_num: int = 0
    total_len: int = 0
    compacted: bool = False
    engine: Engine = EXACT

    STATE = ("buckets", "number", "parts", "gone", "terms", "added", "removed", "doc_num", "total_len", "compacted")

    @staticmethod
    def open(spark: SparkSession, root: str, buckets: int = 16, engine: Engine = EXACT) -> Segments:
        """What is stored at ``root``, or an empty index with so many folders a segment."""
        done = [int(name) for name in children(spark, f"{root}/manifest") if children(spark, f"{root}/manifest/{name}", "_SUCCESS")]
        if not done:
            return Segments(spark, root, buckets, engine=engine)
        state = json.loads(spark.read.text(f"{root}/manifest/{max(done)}").first()[0])
        state |= {k: tuple(state[k]) for k in ("parts", "gone", "terms")}
        return Segments(spark, root, engine=engine, **state)

    def _path(self, kind: str, number: int) -> str:
        return f"{self.root}/{kind}/{number}"

    def _commit(self) -> Segments:
        path = f"{self.root}/manifest/{self.number}"
        state = json.dumps({k: getattr(self, k) for k in self.STATE})
        self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return self

    def _current(self, rows: DataFrame, part: int) -> DataFrame:
        """Rows of a segment without the keys that later changes put in place or deleted."""
        later = [n for n in self.gone if n > part]
        if not later:
            return rows
        return rows.join(_sent(self.spark.read.parquet(*[self._path("gone", n) for n in later])), "key", "left_anti")

    def _read(self, name: str) -> DataFrame | None:
        stored = [Index.load(self.spark, self._path("segment", n), Corpus.empty(self.spark)) for n in self.parts]
        tables = [self._current((i.stored if name == "documents" else i.postings).drop("norm"), n) for n, i in zip(self.parts, stored, strict=True)]
        return reduce(DataFrame.unionByName, tables) if tables else None

    def index(self) -> Index:
        """The index of all current documents, to be searched like any other."""
        if not self.parts:
            raise ValueError("there are no documents yet")
        if self.compacted:
            return Index.load(self.spark, self._path("segment", self.parts[0]), engine=self.engine)
        altered = self.spark.read.parquet(*[self._path("terms", n) for n in self.terms])
        known = altered.groupBy("term").agg(F.sum("df").alias("df"))
        corpus = Corpus(known.where("df > 0"), self.added, self.removed)
        rows = self._read("documents")
        mean = self.total_len / self.doc_num if self.doc_num else 0.0
        docs = rows.select("key", "doc_len", "n_terms")
        return Index(self._read("postings"), docs, known.select("term"), corpus, self.engine, self.buckets, False, (self.doc_num, mean), stored=rows)

    def _change(self, new: Index | None, gone: DataFrame | None, number: int | None) -> Segments:
        number = self.number + 1 if number is None else number
        if number <= self.number:
            return self  # done before
        for kind in KINDS:  # what a change of this number left when it failed
            remove(self.spark, self._path(kind, number))
        stored = None
        if new is not None:
            stored = new.save(self._path("segment", number), self.buckets, with_corpus=False)
        keys = [t.select("key") for t in (stored and stored.docs, gone) if t is not None]
        reduce(DataFrame.union, keys).distinct().write.parquet(self._path("gone", number))
        keys = _sent(self.spark.read.parquet(self._path("gone", number)))

        def facts(docs: DataFrame) -> tuple:
            return docs.agg(F.count(F.lit(1)), F.count_if(F.col("n_terms") > 0), F.coalesce(F.sum("doc_len"), F.lit(0))).first()

        came, went, altered = (0, 0, 0), (0, 0, 0), []
        if stored is not None:
            came = facts(stored.docs)
            altered.append(self.spark.read.parquet(f"{self._path('segment', number)}/corpus"))
        before = self._read("documents")
        if before is not None:
            lost = before.join(keys, "key", "left_semi")
            went = facts(lost)
            altered.append(unfold(lost).groupBy("term").agg((-F.count(F.lit(1))).alias("df")))
        changed = bool(altered)
        if changed:
            reduce(DataFrame.unionByName, altered).groupBy("term").agg(F.sum("df").alias("df")).write.parquet(self._path("terms", number))
        return replace(
            self,
            number=number,
            parts=self.parts + ((number,) if stored is not None else ()),
            gone=(*self.gone, number),
            terms=self.terms + ((number,) if changed else ()),
            added=self.added + came[1],
            removed=self.removed + went[1],
            doc_num=self.doc_num + came[0] - went[0],
            total_len=self.total_len + came[2] - went[2],
            compacted=False,
        )._commit()

    def merge(self, other: Index, number: int | None = None) -> Segments:
        """With all documents of another index, in place of those of the same keys. A change of a ``number`` that is
        done already does nothing, so that a stream's batch may be run again."""
        return self._change(replace(other, bound_corpus=None, bound_vocab=None), None, number)

    def upsert(self, rows: DataFrame, key: str, text: str | None = None, terms: str | None = None, order: str | None = None, number: int | None = None) -> Segments:
        return self.merge(Index.build(rows, key, text, terms, engine=self.engine, order=order), number)

    def delete(self, keys: DataFrame, number: int | None = None) -> Segments:
        return self._change(None, keys, number)

    def apply(self, rows: DataFrame, key: str, text: str, order: str | None = None, number: int | None = None) -> Segments:
        """Rows with a text are put in, keys of rows without one are deleted; of a key's rows the last counts."""
        turn = F.col(order) if order else F.lit(0)
        last = rows.groupBy(F.col(key).alias("key")).agg(F.max(F.struct(turn.alias("turn"), F.col(text).alias("text"))).alias("last"))
        last = last.select("key", "last.text")
        gone = last.where(F.col("text").isNull())
        return self._change(Index.build(last.where(F.col("text").isNotNull()), "key", "text", unique=True), gone, number)

    def compact(self) -> Segments:
        """All current documents as one segment, with norms. Terms whose documents are gone stay in the vocabulary."""
        index, number = self.index(), self.number + 1
        for kind in KINDS:
            remove(self.spark, self._path(kind, number))
        saved = index.save(self._path("segment", number), self.buckets)
        known = saved.vocab.join(saved.corpus.terms, "term", "left").select("term", F.coalesce("df", F.lit(0)).cast("long").alias("df"))
        known.write.parquet(self._path("terms", number))
        return replace(self, number=number, parts=(number,), gone=(), terms=(number,), compacted=True)._commit()

    def vacuum(self) -> None:
        """Deletes the folders of changes that the last state does not read."""
        kept = {"segment": self.parts, "gone": self.gone, "terms": self.terms, "manifest": (self.number,)}
        for kind, numbers in kept.items():
            for name in children(self.spark, f"{self.root}/{kind}"):
                if int(name) not in numbers:
                    remove(self.spark, f"{self.root}/{kind}/{name}")
