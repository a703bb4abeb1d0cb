"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import last_written, scratch, write_shared
from termloom.sources.workspace import remove


def _stars(edges: DataFrame, own: str) -> DataFrame:
    """For each node ``a``, links its neighbours to the least among them and itself."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    # Written, so that the join shuffles both sides and Spark can split a node with very many neighbours.
    least = write_shared(least, "components-least")
    linked = edges.join(least, "a")
    if own == "large":
        return linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (a, b) but the roots; a root is the least node of its component.

    Each round is a few joins and aggregations keyed by node, written to the shared folder; only two numbers a
    round come to the driver.
    """
    spark, state = edges.sparkSession, None
    edges = write_shared(edges.select("a", "b").where("a != b").distinct(), "components")
    held = last_written()
    while True:
        with scratch(spark) as kept:
            both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            large = _stars(both, "large").where("a != b").distinct()
            downward = write_shared(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "components-large")
            edges = write_shared(_stars(downward, "small").where("a != b").distinct(), "components")
            kept.append(last_written())
        remove(spark, held)
        held = kept[0]
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
