"""Approximate nearest neighbours: an HNSW graph per shard, searched by blocks of queries, results merged.

Equal vectors become one node with their smallest ids, so that a vector that holds a third of all rows is one
node. Shards are hashes of the vectors; each has as many nodes as ``shard_bytes`` of memory hold, some hundred
thousand, so that there are few of them. Each shard's graph is written to shared files as flat arrays, in parts
of ``PART`` nodes; a search task gets a shard and a block of queries, which is large too: copies of queries are
rows / (mod * shard's nodes) times as many as there are queries, and a shard is read once for each block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from termloom.llm import hnsw
from termloom.llm.common import write_shared

INDEX = "dim int, shard int, part int, vectors binary, ids array<array<long>>, links array<binary>"
HITS = "query_id long, vec_id long, score double"
#: Nodes in a row of the stored index.
PART = 1 << 14


def _matrix(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(lists), -1)


def _build(links: int, width: int, dtype: str, schema: pa.Schema):
    def build(rows: pa.Table) -> pa.Table:
        hashes = rows.column("hash").to_numpy()
        level = hnsw.levels(hashes.view(np.uint64), links)
        order = np.lexsort((hashes, -level))
        vectors = _matrix(rows.column("vector"), dtype)[order]
        ids = rows.column("ids").take(pa.array(order)).combine_chunks()
        dim, shard = rows.column("dim")[0].as_py(), rows.column("shard")[0].as_py()
        graph = hnsw.build(vectors, level[order], links, width)
        parts = []
        for i, a in enumerate(range(0, len(vectors), PART)):
            layers = [layer[a : a + PART].astype("<i4").tobytes() for layer in graph.links if len(layer) > a]
            parts.append({"dim": dim, "shard": shard, "part": i, "vectors": vectors[a : a + PART].tobytes(), "ids": ids.slice(a, PART).to_pylist(), "links": layers})
        return pa.Table.from_pylist(parts, schema)

    return build


def _load(index: pa.Table, links: int, dtype: str) -> tuple[hnsw.Graph, list[list[int]]]:
    rows = sorted(index.select(["part", "dim", "vectors", "ids", "links"]).to_pylist(), key=lambda r: r["part"])
    vectors = np.concatenate([np.frombuffer(r["vectors"], dtype).reshape(-1, r["dim"]) for r in rows])
    layers = []
    for number in range(len(rows[0]["links"])):
        held = [np.frombuffer(r["links"][number], "<i4") for r in rows if len(r["links"]) > number]
        layers.append(np.concatenate(held).reshape(-1, 2 * links if number == 0 else links))
    return hnsw.Graph(vectors, layers), [ids for r in rows for ids in r["ids"]]


def _search(k: int, beam: int, links: int, dtype: str, schema: pa.Schema):
    def search(queries: pa.Table, index: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if queries.num_rows and index.num_rows:
            graph, ids = _load(index, links, dtype)
            asked = _matrix(queries.column("vector"), dtype)
            for a in range(0, len(asked), hnsw.BLOCK):
                part = asked[a : a + hnsw.BLOCK]
                found = graph.search(part, beam)
                for query_id, query, near in zip(queries.column("query_id")[a : a + hnsw.BLOCK].to_pylist(), part.astype(np.float64), found, strict=True):
                    nodes = near[near >= 0]
                    gaps = np.sqrt(((graph.vectors[nodes].astype(np.float64) - query) ** 2).sum(axis=1))
                    hits: dict[int, float] = {}
                    last = np.inf
                    for at in np.argsort(gaps, kind="stable"):
                        gap = float(gaps[at])
                        if gap > last:
                            break
                        for i in ids[nodes[at]]:
                            if i != query_id:
                                hits.setdefault(i, gap)
                        if len(hits) >= k:  # others at the same distance may have smaller ids
                            last = gap
                    for i, gap in sorted(hits.items(), key=lambda hit: (hit[1], hit[0]))[:k]:
                        for column, value in zip(out, (query_id, i, gap), strict=True):
                            column.append(value)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)

    return search


def nearest(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_mod: int = 100,
    k: int = 10,
    shard_bytes: int = 128 << 20,
    query_block: int = 1 << 18,
    links: int = 16,
    width: int = 24,
    beam: int = 2048,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``query_mod``, its ``k`` nearest.

    Nearness is Euclidean distance, computed in double precision on the original vectors for all that the graphs
    find; ties go to the smaller id. Rows with a null id, or whose vector is null, empty, all zero or has null or
    non-finite components, take no part; vectors are compared with those of their own length. Rows that repeat id
    and vector count once. An id with several vectors has one answer and is at most one hit of another's: two ids
    are as near as the nearest of their vectors, and an id is no hit of its own. With fewer candidates than ``k``
    all are returned; an empty table gives an empty result. Very long vectors make shards of fewer nodes. Other
    columns of ``rows`` are not read. ``beam`` must be above ``k``; full shards need it wide. ``shard_bytes`` is what the vectors and links
    of a shard take; a build task needs about three times as much.
    """
    spark = rows.sparkSession
    doubles = "double" in dict(rows.dtypes)[vector_col]
    dtype, kind = ("<f8", "array<double>") if doubles else ("<f4", "array<float>")
    vector = F.col("vector")
    # Whether an array contains a value that it has not is null if it has nulls; NaN is its own maximum.
    endless = F.lit(float("inf")).cast(kind.removeprefix("array<").removesuffix(">"))
    most, least = F.array_max(vector), F.array_min(vector)
    usable = ~F.array_contains(vector, endless) & ~F.isnan(most) & (least > -endless) & ((most != 0) | (least != 0))
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"))
    own = own.where(F.col("vec_id").isNotNull() & vector.isNotNull()).where(usable).distinct()

    # Of equal vectors no query can return more than its k smallest ids besides its own. Spark applies the limit
    # before it shuffles, too.
    smallest = Window.partitionBy("vector").orderBy("vec_id")
    few = own.withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= k + 1)
    nodes = few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = nodes.select("vector", "ids", F.size("vector").alias("dim"), F.xxhash64("vector").alias("hash"))
    nodes = write_shared(nodes, "ann-nodes")
    number, longest = nodes.agg(F.count(F.lit(1)), F.coalesce(F.max("dim"), F.lit(1))).first()
    per_node = longest * np.dtype(dtype).itemsize + 4 * 3 * links
    shards = max(1, -(-number * per_node // shard_bytes))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("hash", F.lit(7)), F.lit(shards)).cast("int"))
    held = spark.createDataFrame([], INDEX).schema
    index = write_shared(dealt.groupBy("dim", "shard").applyInArrow(_build(links, width, dtype, to_arrow_schema(held)), held), "ann-index")

    queries = own.where(F.col("vec_id") % query_mod == 0).select(F.col("vec_id").alias("query_id"), "vector")
    queries = write_shared(queries, "ann-queries")
    blocks = max(1, -(-queries.count() // query_block))
    asked = queries.select("*", F.size("vector").alias("dim"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    held_by = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["dim", "shard", "block"]
    hits = spark.createDataFrame([], HITS).schema
    found = asked.groupBy(*keys).cogroup(held_by.groupBy(*keys)).applyInArrow(_search(k, beam, links, dtype, to_arrow_schema(hits)), hits)
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    merged = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
