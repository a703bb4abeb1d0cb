"""URL rules through a blocked Bloom filter and an exact hash join (DataFrame functions only).

A rule lists a canonical URL: a host and the start of a path. Each different URL asks first for its own host and the
domains above it, then, where the list has rules for one of these, for the starts of its path that are as long as
such a rule's. Both kinds of keys are tested in a blocked Bloom filter (blocks of eight 64-bit words, one bit a
word); those that may be listed go to an exact join with the list, which removes false positives. URLs that no rule
may fit end at the filter. The tables that are joined are written first, so that joins have a shuffle on both sides
(if Spark, going by their size, does not broadcast them) and Spark can split a host or a URL that very many pages have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import ascii_lower, write_shared

WORDS = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to
    ``?``, ``#`` or the end. Both are empty for a null URL or one without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    bare = F.regexp_extract(rest, r"\A[^?#]*", 0)
    host = F.substring_index(bare, "/", 1)
    return ascii_lower(host), F.substring(bare, F.length(host) + 1, F.length(bare))


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("key_host", "key_path"), F.lit(blocks))


def _masks() -> list[Column]:
    bits = F.xxhash64("key_path", "key_host", F.lit(1))
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, (F.shiftrightunsigned(bits, 6 * w).bitwiseAND(F.lit(63))).cast("int")) for w in range(WORDS)]


def bloom_filter(keys: DataFrame, bits_per_key: int = 16, max_bytes: int = 8 << 20) -> tuple[DataFrame, int]:
    """Blocked Bloom filter of (key_host, key_path): a table of the blocks that have bits, and the number of blocks.

    ``max_bytes`` bounds the table. A longer list makes the filter pass more candidates, not wrong ones.
    """
    blocks = max(1, min(keys.count() * bits_per_key // (64 * WORDS) + 1, max_bytes // (8 * WORDS)))
    masks = [mask.alias(f"m{w}") for w, mask in enumerate(_masks())]
    words = [F.bit_or(f"m{w}").alias(f"w{w}") for w in range(WORDS)]
    return keys.select(_block(blocks).alias("block"), *masks).groupBy("block").agg(*words), blocks


def may_have(candidates: DataFrame, blooms: DataFrame, blocks: int) -> DataFrame:
    """Those of ``candidates`` (with key_host and key_path) that pass the filter."""
    probes = candidates.select("*", _block(blocks).alias("block"), *[mask.alias(f"m{w}") for w, mask in enumerate(_masks())])
    passes = F.lit(True)
    for w in range(WORDS):
        passes = passes & (F.col(f"w{w}").bitwiseAND(F.col(f"m{w}")) != 0)
    # The filter has at most max_filter_bytes: it may be broadcast.
    return probes.join(F.broadcast(blooms), "block").where(passes).select(*candidates.columns)


def url_filter(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default_verdict: str = "allow",
    bits_per_key: int = 16,
    max_filter_bytes: int = 8 << 20,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    ``rules`` has host, path and verdict ('allow' or 'block'). A rule fits its host and all subdomains if the
    URL's path starts with its own; the longest rule (host and path together) wins, 'block' wins over 'allow'
    for the same rule given twice. A URL that fits none has a null rule and, being in no list,
    ``default_verdict``. A null URL has an empty host and path. Repeated pages and pages with null ids stay as
    they are; an empty table or an empty list of rules is no special case. A very long URL makes no more keys than
    its host has domains and the list has lengths of paths for these. Other columns of ``pages`` are not read.
    """
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    listed = (
        rules.select(F.coalesce("host", F.lit("")).alias("key_host"), F.coalesce("path", F.lit("")).alias("key_path"), "verdict")
        .groupBy("key_host", "key_path")
        .agg(F.max("verdict").alias("verdict"))
    )
    listed = write_shared(listed, "url-rules")
    # As many lengths as the list's longest path has characters, at most.
    hosts = listed.groupBy("key_host").agg(F.collect_set(F.length("key_path")).alias("lengths"))
    hosts = write_shared(hosts.withColumn("key_path", F.lit("")), "url-hosts")
    most_labels = hosts.agg(F.coalesce(F.max(F.size(F.split("key_host", r"\."))), F.lit(0))).first()[0]

    labels = F.sequence(F.lit(1), F.least(F.size(F.split("host", r"\.")), F.lit(max(1, most_labels))))
    above = F.expr("transform(labels, n -> substring_index(host, '.', -n))")
    asked = urls.select("host", "path").distinct().withColumn("labels", labels)
    asked = asked.select("host", "path", F.explode(above).alias("key_host"), F.lit("").alias("key_path"))
    known = may_have(asked, *bloom_filter(hosts, bits_per_key, max_filter_bytes)).drop("key_path").join(hosts.drop("key_path"), "key_host")
    starts = known.select("host", "path", "key_host", F.explode(F.expr("filter(lengths, n -> n <= length(path))")).alias("n"))
    starts = starts.select("host", "path", "key_host", F.expr("substring(path, 1, n)").alias("key_path"))
    fits = may_have(starts, *bloom_filter(listed, bits_per_key, max_filter_bytes)).join(listed, ["key_host", "key_path"])
    rule = F.concat("key_host", "key_path")
    order = F.struct(F.length(rule), F.length("key_host"))
    decided = fits.groupBy("host", "path").agg(F.max_by(F.struct(rule.alias("rule"), "verdict"), order).alias("best"))
    decided = write_shared(decided, "url-decided").hint("merge")  # it grows with the pages: never to be broadcast
    return urls.join(decided, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default_verdict)).alias("verdict"),
    )
