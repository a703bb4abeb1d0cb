"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Every document has a size in words; every source has a size and, by its weight, a target.
2. A source's documents fall into blocks by hash, at most ``total_blocks`` in all (plus one per source). A target
   of 2.3 times the source's size takes every block twice, and then blocks in a permuted order until the
   rest is met; of the last of them, documents are taken in a hashed order as far as they fit.
3. The splitting tree divides the sources' exact quotas of blocks among output shards: at each node a
   multivariate-hypergeometric draw says how many blocks of each source go left. A leaf then takes its blocks
   from each source's permuted list, so the shards' blocks are disjoint and exhaust the quotas.
4. A shard's documents are shuffled locally by a hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import text_or_empty, write_shared

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of the total size by weight; a target stops at ``most`` times its source's size and the excess is
    shared again by weight among the others, until none is above."""
    out, open_to, left = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0], float(sum(sizes))
    while open_to:
        weight = sum(weights[i] for i in open_to)
        above = [i for i in open_to if left * weights[i] / weight > most * sizes[i]]
        if not above:
            for i in open_to:
                out[i] = left * weights[i] / weight
            break
        for i in above:
            out[i] = most * float(sizes[i])
        left -= sum(out[i] for i in above)
        open_to = [i for i in open_to if i not in set(above)]
    return out


def _seed(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "big")


def shares(quotas: list[int], shards: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Splitting tree: for each shard in turn, the sources that it gets blocks of, and how many. Over all shards a
    source's blocks sum to its quota, and shards are as even as the total allows. A node of the tree holds only the
    sources that have blocks there, so that all of it is bounded by the number of blocks."""

    def split(first: int, last: int, sources: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if last - first == 1:
            yield first, sources, left
            return
        middle = (first + last) // 2
        total = int(left.sum())
        draw = total * (middle - first) // (last - first)
        rng = np.random.default_rng(_seed("split", seed, first, last))
        taken = rng.multivariate_hypergeometric(left, draw, method="marginals") if total else left
        for a, b, own in ((first, middle, taken), (middle, last, left - taken)):
            some = own > 0
            yield from split(a, b, sources[some], own[some])

    own = np.array(quotas, np.int64)
    yield from split(0, shards, np.flatnonzero(own > 0), own[own > 0])


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """``shares`` as one array (shards, sources)."""
    out = np.zeros((shards, len(quotas)), np.int64)
    for shard, sources, blocks in shares(quotas, shards, seed):
        out[shard, sources] = blocks
    return out


@dataclass(frozen=True)
class Draw:
    """``passes``: how often all blocks of the source are taken; ``order``: its blocks in permuted order;
    ``whole``: how many of them are taken once more; ``rest``: words still to take from the next one."""

    passes: int
    order: list[int]
    whole: int
    rest: float


def draw_blocks(words: dict[int, int], blocks: int, target: float, seed: int) -> Draw:
    size = sum(words.values())
    if not size:
        return Draw(0, list(range(blocks)), 0, 0.0)
    passes = min(int(target // size), int(target / size + 1e-9))
    order = np.random.default_rng(seed).permutation(blocks).tolist()
    rest, whole = target - passes * size, 0
    for block in order:
        if words.get(block, 0) > rest:
            break
        rest -= words.get(block, 0)
        whole += 1
    return Draw(passes, order, whole, max(0.0, rest))


@dataclass
class Mixer:
    """A drawn mix. ``documents``: one row per document; ``copies``: the mix itself, in ``shards`` output shards."""

    documents: DataFrame
    copies: DataFrame
    shards: int


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Iterable[float] = (1, 2, 3),
    most: float = 3.0,
    words_per_shard: int = 1 << 21,
    seed: int = 20,
    total_blocks: int = 1 << 17,
    block_docs: int = 32,
) -> Mixer:
    """Draw a mix of ``docs`` in which each source has its target share of words.

    ``documents`` has one row per document: doc_id, size, source_size, target, taken, and shards, the output
    shard of each taken copy. ``copies`` has one row per taken copy: the document's row in a struct ``doc`` (so
    that no column name can clash), shard, and place, the copy's hashed place in its shard.

    Sources are sorted by code point, null last, and get ``weights`` in turn, repeating. Null text has size 0; a
    document of size 0 is taken as often as its block, at no words. Rows that repeat id and text (or text alone
    where the id is null) share a block and a place in its order; a boundary block takes all of them or none. An
    empty table gives two empty ones. Reruns with the same ``seed`` take the same documents. Texts of any length are
    counted whole.

    The driver holds a row per source, and sizes and places of ``total_blocks`` blocks and one more of each source.
    These tables are written and joined; Spark broadcasts them only if their size allows. The splitting tree deals to
    ``total_blocks / 8`` shards at most; where shards of ``words_per_shard`` are more, each is cut further by a hash.
    """
    spark = docs.sparkSession
    key = [
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("draw"),
    ]
    keyed = docs.select(F.struct("*").alias("doc"), *key)
    size = F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")
    # One pass over the texts gives the sizes; all that follows reads these few bytes per document.
    sizes = write_shared(docs.select(*key, size.alias("size")), "mix-sizes")
    totals = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("size")).collect()
    totals.sort(key=lambda r: (r.source is None, r.source or ""))
    cycle = list(weights)
    goal = targets([r["size"] for r in totals], [cycle[i % len(cycle)] for i in range(len(totals))], most)
    all_words = sum(r["size"] for r in totals)
    blocks = [max(1, min(r.docs // block_docs, total_blocks * r["size"] // max(1, all_words))) for r in totals]
    wanted = max(1, -(-all_words // words_per_shard))
    shards = min(wanted, max(1, total_blocks // 8))
    cuts = -(-wanted // shards)

    # One row per source.
    catalogue = [(r.source, i, r["size"], goal[i], blocks[i]) for i, r in enumerate(totals)]
    catalogue = spark.createDataFrame(catalogue, "source_name string, source_no int, source_size long, target double, blocks int")
    catalogue = write_shared(catalogue, "mix-sources")

    def in_blocks(rows: DataFrame) -> DataFrame:
        known = rows.join(catalogue, rows["source"].eqNullSafe(catalogue["source_name"]))
        return known.withColumn("block", F.pmod(F.xxhash64("draw", F.lit(1)), F.col("blocks")).cast("int"))

    known = in_blocks(sizes)
    words: dict[int, dict[int, int]] = {}
    for no, block, n in known.groupBy("source_no", "block").agg(F.sum("size")).collect():  # total_blocks rows
        words.setdefault(no, {})[block] = n
    draws = [draw_blocks(words.get(i, {}), blocks[i], goal[i], _seed("order", seed, i)) for i in range(len(totals))]

    # The boundary block of each source gives one row: documents up to a place in the hashed order, but for a few
    # exchanged so that the sum fits. A block holds about block_docs documents, or a total_blocks-th of the corpus.
    edge = [(i, d.order[d.whole], d.rest) for i, d in enumerate(draws) if d.rest > 0]
    edges = write_shared(spark.createDataFrame(edge, "source_no int, block int, rest double"), "mix-edges")
    fitted = known.join(edges, ["source_no", "block"]).select("source_no", "draw", "size", "rest")
    fits = {r.source_no: r for r in fitted.groupBy("source_no").applyInPandas(_fit, FITTED).collect()}
    kept = [tuple(fits[i]) if i in fits else (i, None, [], []) for i in range(len(draws))]
    kept = write_shared(spark.createDataFrame(kept, FITTED), "mix-fitted")

    places: list[list[np.ndarray]] = [[] for _ in draws]
    for number, sources, taken in shares([d.passes * len(d.order) + d.whole + (d.rest > 0) for d in draws], shards, seed):
        for i, n in zip(sources.tolist(), taken.tolist(), strict=True):
            places[i].append(np.full(n, number))
    rows: dict[tuple[int, int], list[tuple[int, int, bool]]] = {}
    for i, d in enumerate(draws):
        items = [(n, b, False) for n in range(d.passes) for b in d.order]
        items += [(d.passes, b, False) for b in d.order[: d.whole]]
        items += [(d.passes, d.order[d.whole], True)] if d.rest > 0 else []
        permuted = np.random.default_rng(_seed("items", seed, i)).permutation(len(items))
        shard = np.concatenate([np.zeros(0, np.int64), *places[i]]).tolist()
        for place, item in enumerate(permuted.tolist()):
            n, block, partly = items[item]
            rows.setdefault((i, block), []).append((n, shard[place], partly))
    # One row per block that is taken.
    per_block = [(i, block, sorted(taken)) for (i, block), taken in rows.items()]
    per_block = spark.createDataFrame(per_block, "source_no int, block int, items array<struct<pass: int, shard: int, partly: boolean>>")
    per_block = write_shared(per_block, "mix-blocks")

    def drawn(rows: DataFrame) -> DataFrame:
        placed = in_blocks(rows).join(per_block, ["source_no", "block"], "left").join(kept, "source_no", "left")
        before = (F.col("draw") <= F.col("upto")) & ~F.array_contains("less", F.col("draw"))
        fit = F.coalesce(before, F.lit(False)) | F.array_contains("extra", F.col("draw"))
        none = F.array().cast("array<struct<pass: int, shard: int, partly: boolean>>")
        return placed.withColumn("fit", fit).withColumn("items", F.coalesce("items", none)).withColumn("items", F.expr("filter(items, i -> not i.partly or fit)"))

    def cut(item: Column) -> Column:
        if cuts == 1:
            return item["shard"]
        return (item["shard"] * cuts + F.pmod(F.xxhash64("draw", item["pass"], F.lit(3)), F.lit(cuts))).cast("int")

    own = drawn(sizes)
    documents = own.select("doc_id", "size", "source_size", "target", (F.size("items") * F.col("size")).alias("taken"), F.transform("items", cut).alias("shards"))
    copies = drawn(keyed).select("doc", "draw", F.explode("items").alias("item"))
    copies = copies.select("doc", cut(F.col("item")).alias("shard"), F.xxhash64("draw", "item.pass", F.lit(2)).alias("place"))
    return Mixer(documents, copies, shards * cuts)


#: Documents of a boundary block that may differ from those up to one place in the order.
EXTRA = 64
FITTED = "source_no int, upto long, extra array<long>, less array<long>"


def _fit(block: pd.DataFrame) -> pd.DataFrame:
    """First fit in the order of ``draw``, then swaps and additions that bring the sum nearer; rows that share a
    ``draw`` count together."""
    groups = block.groupby("draw", sort=True)["size"].sum()
    draws, sizes = groups.index.to_numpy(), groups.to_numpy().astype(np.float64)
    prefix = int(np.searchsorted(np.cumsum(sizes), float(block["rest"].iloc[0]), side="right"))
    left = float(block["rest"].iloc[0]) - float(sizes[:prefix].sum())
    chosen = np.arange(len(draws)) < prefix
    for at in range(prefix, len(draws)):
        if 0 < sizes[at] <= left and chosen[prefix:].sum() < EXTRA // 2:
            chosen[at] = True
            left -= sizes[at]
    for _ in range(EXTRA // 4):
        # Out of and into the choice; place -1 stands for none.
        out, into = ([-1, *np.flatnonzero(side).tolist()] for side in (chosen, ~chosen))
        gain_out, gain_in = (np.array([0.0, *sizes[side[1:]]]) for side in (out, into))
        order = np.argsort(gain_in, kind="stable")
        near = np.searchsorted(gain_in[order], left + gain_out)
        tries = [(o, order[k]) for o, n in enumerate(near) for k in (n - 1, n) if 0 <= k < len(order)]
        o, i = min(tries, key=lambda t: abs(left + gain_out[t[0]] - gain_in[t[1]]))
        new = left + gain_out[o] - gain_in[i]
        if abs(new) >= abs(left) - 0.5:
            break
        left = new
        if out[o] >= 0:
            chosen[out[o]] = False
        if into[i] >= 0:
            chosen[into[i]] = True
    upto = int(draws[prefix - 1]) if prefix else None
    more, less = draws[prefix:][chosen[prefix:]].tolist(), draws[:prefix][~chosen[:prefix]].tolist()
    return pd.DataFrame({"source_no": [block["source_no"].iloc[0]], "upto": pd.array([upto], dtype="Int64"), "extra": [more], "less": [less]})


def mixed_documents(mixer: Mixer, columns: list[str], shuffle: bool = True) -> DataFrame:
    """The mix as rows like those of the input: one per taken copy, a partition per shard in its shuffled order."""
    copies = mixer.copies
    if shuffle:
        copies = copies.repartitionById(mixer.shards, "shard").sortWithinPartitions("place")
    return copies.select(*[F.col("doc").getField(c).alias(c) for c in columns])
