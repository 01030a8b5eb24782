"""Operator 6: shards of near-equal bytes by minimax contiguous partition (built-in functions only).

Atomic groups (equal texts, which stay in one shard) are ordered by size, largest first, then by digest. The smallest
capacity for which a greedy left-to-right fill needs no more than ``shards`` shards is found by binary search, and
the order is cut where that fill cuts it.

In this order groups of one size stand together, so the ordered sizes are held exactly by a histogram (size, groups).
Its length is at most sqrt(2 * all bytes), because n different sizes add up to n*n/2 at least; only this histogram
reaches the driver, where a feasibility check is a few binary searches. Rows are placed by Spark.

Defined cases: a null text counts as empty (size 8, checksum 0) and is grouped with empty texts; repeated rows are rows
of their own with a slot each; an empty table gives an empty result; with few groups some shards stay empty; the query reads doc_id and
text only; a very long text is one group, and the capacity is at least its size.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import documents, running_total, salt_of, salts, staged

SHARDS = 24
ROW_BYTES = 8
HOT_SHARE = 8192


class Runs:
    """Sizes in order, as runs of equal sizes: how far a fill from some position comes."""

    def __init__(self, runs: list[tuple[int, int]]):
        self.sizes = [s for s, _ in runs]
        self.groups = [0, *accumulate(n for _, n in runs)]
        self.bytes = [0, *accumulate(s * n for s, n in runs)]

    def reach(self, start: int, capacity: int) -> int:
        """The position after the last group that fits into one shard beginning at ``start``."""
        if start >= self.groups[-1]:
            return start
        k = bisect_right(self.groups, start) - 1
        limit = self.bytes[k] + (start - self.groups[k]) * self.sizes[k] + capacity
        k = bisect_right(self.bytes, limit) - 1
        return self.groups[k] + ((limit - self.bytes[k]) // self.sizes[k] if k < len(self.sizes) else 0)

    def cuts(self, capacity: int, shards: int) -> list[int] | None:
        """Where the greedy fill cuts, or None if ``shards`` shards of this capacity don't hold all groups."""
        out, at = [], 0
        for _ in range(shards):
            at = self.reach(at, capacity)
            out.append(at)
        return out if at >= self.groups[-1] else None

    def smallest(self, shards: int) -> int:
        low, high = max(self.sizes[0], -(-self.bytes[-1] // shards)), self.bytes[-1]
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards):
                high = middle
            else:
                low = middle + 1
        return low


def minimax_cuts(runs: list[tuple[int, int]], shards: int) -> list[int]:
    """Cut positions (groups before the end of each shard) for runs of (size, groups) in descending order of size."""
    if not runs:
        return [0] * shards
    order = Runs(runs)
    return order.cuts(order.smallest(shards), shards)


def shard_groups(groups: DataFrame, key: str, size: str, shards: int, rows: int) -> DataFrame:
    """``groups`` (one row each) with column ``shard``. ``groups`` should be a stored table."""
    histogram = groups.groupBy(size).agg(F.count("*").alias("n")).orderBy(F.desc(size)).collect()
    runs = [(r[size], r["n"]) for r in histogram]
    cuts = minimax_cuts(runs, shards)
    # a cut lies in the run of some size: before it come all larger sizes and the first few groups of this size
    ends, k, before = [], 0, 0
    for cut in cuts[:-1]:
        while k < len(runs) and before + runs[k][1] <= cut:
            before += runs[k][1]
            k += 1
        ends.append((runs[k][0], cut - before) if k < len(runs) else (0, 0))
    salted = groups.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts(rows)))).withColumn("_one", F.lit(1))
    placed = running_total(salted, [size], ["_salt"], [F.col(key)], "_one", "_rank")
    full = [(F.col(size) < s) | ((F.col(size) == s) & (F.col("_rank") > r)) for s, r in ends]
    shard = sum((c.cast("int") for c in full), F.lit(0))
    return placed.withColumn("shard", shard).drop("_salt", "_one", "_rank")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = docs.count()
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = staged(
        docs.select(
            "doc_id",
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.sha2(text, 256).alias("_text"),
        ),
        "shard-rows",
    )
    groups = staged(narrow.groupBy("_text").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows")), "shard-groups")
    sharded = staged(shard_groups(groups, "_text", "_bytes", SHARDS, rows).select("_text", "_rows", "shard"), "shard-placed")
    # texts that at least one row in HOT_SHARE holds are at most HOT_SHARE texts: they are broadcast, so that their rows stay where they are
    often = F.col("_rows") * HOT_SHARE >= rows
    hot, rest = F.broadcast(sharded.where(often).select("_text", "shard")), sharded.where(~often).select("_text", "shard")
    placed = narrow.join(hot, "_text").unionByName(narrow.join(hot.select("_text"), "_text", "left_anti").join(rest, "_text"))
    numbered = running_total(
        placed.withColumn("_salt", salt_of("doc_id", salts(rows, 4))).withColumn("_one", F.lit(1)),
        ["shard"],
        ["_salt"],
        [F.col("doc_id"), F.col("_text")],
        "_one",
        "_place",
    )
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
