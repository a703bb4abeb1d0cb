"""Exact dedup by an extendible-hash index on shared files (DataFrame functions only).

1. Every text is normalised and hashed. A directory over the leading hash bits is doubled until no bucket holds more
   than ``bucket_capacity`` hashes. Down to ``max_depth`` bits it is built from a histogram of at most
   ``2 ** max_depth`` counts. A bucket that is overfull at that depth goes on doubling by itself, over the bits that
   follow: how often is found where the hashes are, and the directory notes one number for it.
2. Rows are pre-aggregated where they are read and again in ``PARTS`` parts, so that a text that holds a third of all
   rows reaches its bucket as ``PARTS`` rows at most. What is left goes to the owner of its bucket.
3. The owner compares bytes among the texts of a bucket that have one hash; different ones form a chain. The index is
   written to shared files.
4. Each document looks itself up by bucket, hash and, along the chain, SHA-256.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import ascii_lower, literal_rows, text_or_empty, write_shared

PARTS = 16
#: Most bits by which a bucket is split beyond the directory's depth.
STEPS = 16


def build_directory(counts: dict[int, int], capacity: int, max_depth: int) -> tuple[int, list[int], list[int]]:
    """Double the directory and split overfull buckets.

    ``counts`` has the number of keys by their leading ``max_depth`` bits. Returns the directory's depth, the
    bucket of each of its ``2 ** depth`` slots, and the local depth of each bucket. Buckets are numbered in key
    order, so that a range of buckets is a range of keys.
    """
    if capacity < 1 or not 0 <= max_depth <= 20:
        raise ValueError("capacity must be positive and max_depth between 0 and 20")
    before = [0, *accumulate(counts.get(i, 0) for i in range(1 << max_depth))]

    def keys(depth: int, prefix: int) -> int:
        shift = max_depth - depth
        return before[(prefix + 1) << shift] - before[prefix << shift]

    depth, slots = 0, [(0, 0)]
    overfull = [(0, 0)] if keys(0, 0) > capacity and max_depth else []
    while overfull:
        local, prefix = overfull.pop()
        if local == depth:
            slots = [bucket for bucket in slots for _ in range(2)]
            depth += 1
        width = 1 << (depth - local - 1)
        start = prefix * 2 * width
        for side in (0, 1):
            child = (local + 1, 2 * prefix + side)
            slots[start + side * width : start + (side + 1) * width] = [child] * width
            if keys(*child) > capacity and local + 1 < max_depth:
                overfull.append(child)
    number = {bucket: i for i, bucket in enumerate(dict.fromkeys(slots))}
    return depth, [number[bucket] for bucket in slots], [local for local, _ in number]


def _slot(depth: int) -> Column:
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")


def deepen(keys: DataFrame, max_depth: int, overfull: list[int], capacity: int) -> dict[int, int]:
    """For slots of ``max_depth`` bits with more than ``capacity`` hashes: by how many further bits they are to be
    split, at most ``STEPS``, so that no part has more.

    ``keys`` are the different hashes. Their counts by all further bits stay on the executors, where halves are
    summed step by step; a slot's number is all that comes to the driver.
    """
    spark = keys.sparkSession
    # At most 2 ** max_depth rows of one number.
    listed = literal_rows(spark, [{"slot": slot} for slot in overfull], "slot long")
    held = keys.select("key", _slot(max_depth).alias("slot")).join(F.broadcast(listed), "slot")
    below = 64 - max_depth - STEPS
    part = F.shiftrightunsigned("key", below).bitwiseAND(F.lit((1 << STEPS) - 1)).alias("part")
    counted = write_shared(held.select("slot", part).groupBy("slot", "part").agg(F.count(F.lit(1)).alias("n")), "dedup-deep")
    step = F.explode(F.sequence(F.lit(1), F.lit(STEPS))).alias("bits")
    halves = counted.select("slot", "part", "n", step).groupBy("slot", "bits", F.expr(f"shiftright(part, {STEPS} - bits)").alias("part"))
    fullest = halves.agg(F.sum("n").alias("n")).groupBy("slot", "bits").agg(F.max("n").alias("n"))
    enough = F.min(F.when(F.col("n") <= capacity, F.col("bits")))
    return {row[0]: row[1] for row in fullest.groupBy("slot").agg(F.coalesce(enough, F.lit(STEPS))).collect()}


def _sha() -> Column:
    return F.unhex(F.sha2(F.col("norm").cast("binary"), 256))


def route(keyed: DataFrame, depth: int, slots: list[int], deeper: dict[int, int] | None = None) -> DataFrame:
    """``keyed`` with the bucket of each key. ``deeper`` has the further bits of those slots that have any; the parts
    of such a slot are buckets whose numbers are as many as there are slots apart."""
    # At most 2 ** max_depth rows of three numbers, whatever the input: it may be broadcast.
    rows = [{"slot": i, "bucket": b, "bits": (deeper or {}).get(i, 0)} for i, b in enumerate(slots)]
    directory = literal_rows(keyed.sparkSession, rows, "slot long, bucket long, bits int")
    routed = keyed.withColumn("slot", _slot(depth)).join(F.broadcast(directory), "slot")
    part = F.expr(f"IF(bits = 0, 0L, shiftrightunsigned(shiftleft(key, {depth}), 64 - bits))")
    return routed.withColumn("bucket", F.col("bucket") + part * F.lit(1 << depth)).drop("slot", "bits")


def fill_buckets(routed: DataFrame, owners: int = 1) -> DataFrame:
    """The index: bucket, key, chain, sha, keep_id, group_size of each different text of a bucket. Buckets go to
    ``owners`` tasks in turn."""
    parts = routed.withColumn("part", F.spark_partition_id() % PARTS).groupBy("bucket", "key", "norm", "part")
    parts = parts.agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Dealt by owner alone: the two steps below need no other shuffle, and see whole buckets.
    owned = parts.drop("part").withColumn("owner", F.pmod("bucket", F.lit(owners)).cast("int"))
    owned = owned.repartitionById(owners, "owner").groupBy("owner", "bucket", "key", "norm")
    owned = owned.agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    chained = Window.partitionBy("owner", "bucket", "key").orderBy("sha")
    owned = owned.select("owner", "bucket", "key", _sha().alias("sha"), "keep_id", "group_size")
    return owned.select("bucket", "key", (F.row_number().over(chained) - 1).alias("chain"), "sha", "keep_id", "group_size")


def look_up(routed: DataFrame, index: DataFrame) -> DataFrame:
    """Each document with its entry, looked for in its own bucket only."""
    return routed.select("doc_id", "bucket", "key", _sha().alias("sha")).join(index, ["bucket", "key", "sha"], "left")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_capacity: int = 1 << 14,
    max_depth: int = 16,
    key_bits: int = 64,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain.

    Texts are equal when their bytes are, after lower-casing A-Z. Null text counts as empty; an empty text is a
    text like any other. The largest id of a group stays. Rows with a null id are counted in group_size; keep_id
    is null, and such rows are kept, only where no row of the group has an id. Rows that repeat the id that
    stays are kept alike. An empty table gives an empty result. Other columns of ``docs`` are not read.
    ``chain`` is the key's place among those with the same hash (0 unless hashes collide); ``key_bits`` below 64
    shortens the hash, for tests of collisions. A bucket has more than ``bucket_capacity`` hashes only if they agree
    in their first ``max_depth + STEPS`` bits. Texts of any length are hashed and compared whole.
    """
    norm = ascii_lower(text_or_empty(text_col))
    unused = 64 - key_bits
    key = F.shiftleft(F.shiftrightunsigned(F.xxhash64("norm"), unused), unused)
    keyed = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).withColumn("key", key)

    keys = write_shared(keyed.select("key").distinct(), "dedup-keys")
    counts = {row[0]: row[1] for row in keys.groupBy(_slot(max_depth).alias("slot")).count().collect()}
    depth, slots, _ = build_directory(counts, bucket_capacity, max_depth)
    overfull = sorted(slot for slot, n in counts.items() if n > bucket_capacity)
    deeper = deepen(keys, max_depth, overfull, bucket_capacity) if overfull else {}
    routed = route(keyed, depth, slots, deeper)
    # A task owns one bucket, or where there are more buckets than the session has shuffle partitions, several.
    buckets = len(set(slots)) + sum((1 << bits) - 1 for bits in deeper.values())
    owners = min(buckets, max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    looked_up = look_up(routed, write_shared(fill_buckets(routed, owners), "dedup-index"))
    return looked_up.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "bucket",
        "chain",
    )
