"""Digests of tables that don't hang on the order of rows and add up: from partitions to groups of partitions to the whole.

A row's digest is a number of 60 bits from its SHA-256; a set's is the sum of its rows' modulo 2**60, beside their count. So digests of parts are made apart, in
any order, and merged by adding, and a tree of them finds what changed from the top down. They find mistakes and changes, not forgeries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODULUS = 1 << 60


def row_digest(*texts: Column) -> Column:
    """60 bits of the SHA-256 of the values as text, each with its length in front; null differs from all texts."""
    parts = [F.coalesce(F.concat(F.octet_length(t.cast("string")).cast("string"), F.lit(":"), t.cast("string")), F.lit("-")) for t in texts]
    return F.conv(F.substring(F.sha2(F.concat(*parts), 256), 1, 15), 16, 10).cast("long")


def added(digests: str) -> Column:
    return F.pmod(F.sum(F.col(digests).cast("decimal(38,0)")), F.lit(MODULUS).cast("decimal(38,0)")).cast("long")


def tree(rows: DataFrame, keys: list[str], columns: list[Column]) -> DataFrame:
    """(depth, keys, n, digest): the whole at depth 0, then by the first key, by the first two, and so on. Each level is added up from the one below.

    Keys that a row is summed over are null; keys of the data must not be null.
    """
    level = rows.select(*keys, row_digest(*columns).alias("digest")).groupBy(*keys).agg(F.count("*").alias("n"), added("digest").alias("digest"))
    out = [level.select(F.lit(len(keys)).alias("depth"), *keys, "n", "digest")]
    kinds = dict(level.dtypes)
    for depth in range(len(keys) - 1, -1, -1):
        level = level.groupBy(*keys[:depth]).agg(F.sum("n").alias("n"), added("digest").alias("digest"))
        if not depth:
            level = level.where("n IS NOT NULL")  # no rows have no digest
        out.append(level.select(F.lit(depth).alias("depth"), *keys[:depth], *[F.lit(None).cast(kinds[k]).alias(k) for k in keys[depth:]], "n", "digest"))
    return reduce(DataFrame.unionByName, out)


def changed(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """The lowest nodes (keys, n_one, n_other) in which two stored trees differ; null counts where a tree has no such node.

    Only children of nodes that differ are compared, level by level.
    """
    found = None
    for depth in range(1, len(keys) + 1):
        own = keys[:depth]
        a, b = (t.where(F.col("depth") == depth) for t in (one, other))
        if found is not None:
            a, b = (t.join(found.select(*own[:-1]), own[:-1], "left_semi") for t in (a, b))
        both = a.select(*own, F.col("n").alias("n_one"), F.col("digest").alias("d_one")).join(b.select(*own, F.col("n").alias("n_other"), F.col("digest").alias("d_other")), own, "full")
        found = both.where("NOT (n_one <=> n_other AND d_one <=> d_other)").drop("d_one", "d_other")
    return found
