"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets verify them.

1. One pass gives each document a fingerprint of its words and the hashes of its MinHash bands. Documents with
   equal words are copies of one text; all that follows is between different texts.
2. Texts are shuffled on their band hashes. Buckets of two or more stay, and of buckets with the same members one.
3. The texts of a bucket meet in a task; a large bucket is cut into blocks, and each pair of blocks meets. There,
   every pair that does not share an earlier bucket is verified on its full sets of n-grams. What leaves a task is
   a row per text (its number of links, and one link of a spanning forest), never a row per pair.
4. Components of the forest links are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import mix64, write_shared
from termloom.llm.components import components
from termloom.llm.words import slices, split_words

CHUNK = 1 << 15


def choose_bands(threshold: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows a band, and fewest bands, with which a pair at the threshold becomes a
    candidate with probability ``recall`` within ``most_hashes``."""
    best = None
    for rows in range(1, most_hashes + 1):
        for bands in range(1, most_hashes // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                best = (bands, rows)
                break
    if best is None:
        raise ValueError("no bands reach this recall with so few hashes")
    return best


def grams(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words and where each text's start; hashes of all n-grams and where each text's start. A text
    of fewer words than ``size`` has one n-gram, all its words."""
    words = split_words(pc.utf8_lower(pc.fill_null(texts, "")))
    own = np.array([xxhash.xxh3_64_intdigest(w) for w in words.unique], np.uint64)
    stream = own[words.index] if len(own) else np.zeros(0, np.uint64)
    counts = words.counts
    number = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(number)])
    first = np.repeat(words.offsets[:-1] - offsets[:-1], number) + np.arange(offsets[-1])
    length = np.repeat(np.minimum(counts, size), number)
    value = length.astype(np.uint64)
    padded = np.concatenate([stream, np.zeros(size, np.uint64)])
    for k in range(size):
        value = np.where(k < length, value * np.uint64(0x9E3779B97F4A7C15) + padded[first + k], value)
    return stream, words.offsets, mix64(value), offsets


def band_hashes(values: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """MinHash bands of each text, which must have an n-gram: array (texts, bands)."""
    rng = np.random.default_rng(2)
    factor = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    least = np.full((len(offsets) - 1, bands * rows), np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for a in range(0, len(values), CHUNK):
        part, whose = values[a : a + CHUNK], owner[a : a + CHUNK]
        starts = np.flatnonzero(np.diff(whose, prepend=-1))
        texts = whose[starts]
        for k in range(bands * rows):
            least[texts, k] = np.minimum(least[texts, k], np.minimum.reduceat(part * factor[k] + shift[k], starts))
    out = np.zeros((len(least), bands), np.uint64)
    for k in range(rows):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + least[:, k::rows])
    return out.view(np.int64)


def _sign(size: int, bands: int, rows: int, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            stream, ends, values, offsets = grams(part.column("text"), size)
            nodes = [xxhash.xxh3_128_digest(stream[a:b].tobytes()) for a, b in zip(ends.tolist(), ends.tolist()[1:], strict=False)]
            count = np.diff(ends)
            banded = count >= size  # shorter texts are near no other text
            hashes = np.zeros((0, bands), np.int64)
            if banded.any():
                which = np.repeat(banded, np.diff(offsets))
                hashes = band_hashes(values[which], np.concatenate([[0], np.cumsum(np.diff(offsets)[banded])]), bands, rows)
            ends_of = pa.array(np.concatenate([[0], np.cumsum(banded * bands)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends_of, pa.array(hashes.ravel()))
            columns = [part.column("doc_id"), part.column("text_key"), pa.array(nodes, pa.binary()), pa.array(count), lists.cast(schema.field("bands").type)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the first row of its component."""
    root = np.full(len(linked), -1)
    for start in range(len(linked)):
        if root[start] >= 0:
            continue
        member = np.zeros(len(linked), bool)
        member[start], todo = True, [start]
        while todo:
            fresh = linked[todo].any(axis=0) & ~member
            member |= fresh
            todo = np.flatnonzero(fresh).tolist()
        root[member] = start
    return root


def verify(bucket: int, sets: list[np.ndarray], buckets: list[np.ndarray], side: np.ndarray, threshold: float) -> np.ndarray:
    """Matrix of links among the texts of a bucket: pairs at the threshold that share no earlier bucket. ``side``
    tells two blocks apart; if it has two values, only pairs across count."""
    m = len(sets)
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, inverse, times = np.unique(flat, return_inverse=True, return_counts=True)
    common = times[inverse] > 1
    _, column = np.unique(inverse[common], return_inverse=True)
    row, both = owner[common], np.zeros((m, m), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, [a, a + 4096])
        held = np.zeros((m, min(4096, int(column[-1]) + 1 - a)), np.float32)
        held[row[lo:hi], column[lo:hi] - a] = 1
        both += held @ held.T
    size = np.array([len(s) for s in sets], np.float64)
    union = size[:, None] + size[None, :] - both
    linked = both >= threshold * union - 1e-9
    earlier = [(i, g) for i, own in enumerate(buckets) for g in own.tolist() if g < bucket]
    if earlier:
        _, number = np.unique([g for _, g in earlier], return_inverse=True)
        member = np.zeros((m, int(number.max()) + 1), np.float32)
        member[[i for i, _ in earlier], number] = 1
        linked &= (member @ member.T) == 0
    np.fill_diagonal(linked, False)
    if side.min() != side.max():
        linked &= side[:, None] != side[None, :]
    return linked


LINKS = "node binary, other binary, texts long, docs long"


def _verified(size: int, threshold: float, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket and pair of blocks."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for part in slices(batch, "text"):
                _, _, values, offsets = grams(part.column("text"), size)
                names = ("bucket", "low", "high", "block", "node", "copies", "buckets")
                lists = [part.column(c).to_pylist() for c in names]
                for i, row in enumerate(zip(*lists, strict=True)):
                    yield *row, np.unique(values[offsets[i] : offsets[i + 1]])

    for key, group in groupby(rows(), key=lambda r: r[:3]):
        members = list(group)
        side = np.array([r[3] for r in members])
        if key[1] != key[2] and side.min() == side.max():
            continue
        linked = verify(key[0], [r[7] for r in members], [np.array(r[6], np.int64) for r in members], side, threshold)
        texts = linked.sum(axis=1)
        docs = linked @ np.array([r[5] for r in members], np.int64)
        root = _forest(linked)
        at = np.flatnonzero(texts)
        if len(at):
            nodes = [members[i][4] for i in at]
            roots = [members[i][4] for i in root[at]]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(roots, pa.binary()), pa.array(texts[at].astype(np.int64)), pa.array(docs[at].astype(np.int64))], schema=schema)


def ngram_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    threshold: float = 0.8,
    recall: float = 0.9995,
    block_texts: int = 512,
    block_words: int = 1 << 21,
    with_text_key: bool = False,
) -> DataFrame:
    """One row per document: doc_id, class_id, class_docs, copies, links, keeps; ``with_text_key`` adds text_key, the
    64-bit hash of the text that tells rows of one id apart.

    Words are what white space separates, lower-cased. Two documents are linked if the sets of their n-grams of
    ``size`` words have a Jaccard similarity of ``threshold`` or more, or all their words are equal. ``links`` is
    the number of other documents linked to this one, ``copies`` those of equal words among them; classes are the
    connected components, named by their least id, and ``keeps`` is true for the document of that id. A pair at
    the threshold is found with probability ``recall``, more similar ones with a higher one; what is found is
    exact, up to collisions of the n-grams' 64-bit hashes.

    Null and empty texts are copies of one another. A text of fewer than ``size`` words is near no different text.
    Rows with a null id take part; a class without any id has a null class_id and keeps all. Rows that repeat the
    id that stays are all kept. An empty table gives an empty result. Other columns of ``docs`` are not read. Texts
    of any length are compared whole; the longest text bounds what a task holds. A bucket is cut so that a task holds at most two blocks of ``block_texts`` texts or ``block_words`` words.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    bands, rows = choose_bands(threshold, recall)
    own = [F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text")]
    texts = docs.select(*own)
    signed = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, text_key long, node binary, words long, bands array<long>"
    arrow = to_arrow_schema(spark.createDataFrame([], signed).schema)
    signs = write_shared(texts.mapInArrow(lambda b: _sign(size, bands, rows, arrow, b), signed), "ngram-signs")

    least = F.min(F.struct("doc_id", "text_key")).alias("least")
    nodes = signs.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least_id"), least, F.first("words").alias("words"), F.first("bands").alias("bands"))
    nodes = write_shared(nodes, "ngram-nodes")

    spread = nodes.select("node", "words", F.posexplode("bands").alias("band", "hash"))
    members = F.bit_xor(F.xxhash64("node")).alias("members")
    buckets = spread.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("n_words"), members, F.min("node").alias("first"))
    same = buckets.where("n > 1").groupBy("n", "members", "first").agg(F.max("n_words").alias("n_words"), F.min(F.struct("band", "hash")).alias("at"))
    parts = F.greatest(F.ceil(F.col("n") / block_texts), F.ceil(F.col("n_words") / block_words)).cast("int")
    kept = same.select("at.band", "at.hash", parts.alias("parts"))
    held = spread.select("node", "band", "hash").join(kept, ["band", "hash"])
    bucket = F.struct(F.xxhash64("band", "hash").alias("bucket"), "parts")
    held = held.groupBy("node").agg(F.sort_array(F.collect_set(bucket)).alias("held"))  # as many as bands, at most

    asked = held.join(nodes.select("node", "copies", "least"), "node").select("node", "copies", "least.*", "held")
    asked = asked.withColumnsRenamed({"doc_id": "least_doc", "text_key": "least_key"}).hint("shuffle_hash")
    found = texts.join(asked, (F.col("text_key") == F.col("least_key")) & F.col("doc_id").eqNullSafe(F.col("least_doc")))
    found = found.groupBy("node", "copies", "held").agg(F.first("text").alias("text"))

    placed = found.select("node", "copies", "text", F.col("held.bucket").alias("buckets"), F.explode("held").alias("b"))
    placed = placed.select("node", "copies", "text", "buckets", "b.*").withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    low, high = F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    meets = pairs.select("bucket", low, high, "block", "node", "copies", "buckets", "text")
    keys = ["bucket", "low", "high"]
    meets = meets.repartition(*keys).sortWithinPartitions(*keys)
    links_schema = to_arrow_schema(spark.createDataFrame([], LINKS).schema)
    linked = write_shared(meets.mapInArrow(lambda b: _verified(size, threshold, links_schema, b), LINKS), "ngram-links")

    roots = components(linked.select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = linked.groupBy("node").agg(F.sum("docs").alias("near"))
    classed = nodes.select("node", "copies", "least_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = classed.groupBy("root").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_docs"))
    by_node = classed.join(classes, "root").join(counts, "node", "left")
    by_node = by_node.select("node", "class_id", "class_docs", (F.col("copies") - 1).alias("copies"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    # Written, so that the join shuffles both sides and Spark can split a text that very many documents have.
    by_node = write_shared(by_node, "ngram-classes")
    out = signs.select("doc_id", "text_key", "node").join(by_node, "node")
    keeps = F.col("doc_id").eqNullSafe(F.col("class_id")).alias("keeps")
    return out.select("doc_id", "class_id", "class_docs", "copies", "links", keeps, *(["text_key"] if with_text_key else []))


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``ngram_join`` keeps, with all their columns. What decides is the row, its id and its
    text, so that of rows that share an id, or have none, each goes or stays by its own text."""
    kept = ngram_join(docs, id_col, text_col, with_text_key=True).where("keeps").select("doc_id", "text_key").distinct()
    kept = write_shared(kept, "ngram-kept")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("row_id"), F.xxhash64(F.col(text_col)).alias("row_key"))
    same = (F.col("row_key") == F.col("text_key")) & F.col("row_id").eqNullSafe(F.col("doc_id"))
    return rows.join(kept, same, "left_semi").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
