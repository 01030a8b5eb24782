"""Operator 3: mix sources to target weights by systematic sampling (built-in functions only).

Each document expects ``target / source size`` copies. The expectations are prefix-summed within the source,
one offset is added, and a copy is emitted for each whole number that the running sum crosses. Documents are
summed in order of size, so that the words taken follow the target closely whatever the offset.

Expectations are held in units of 2**-24 copies as whole numbers: sums are then exact, and a rerun, also one
after a lost executor, takes the same copies.

Defined cases: a null or empty text has size 0 and takes 0 words (it may still be drawn); a null source is a source
of its own, ordered last; a source without words has target 0; equal rows are drawn one by one; an empty table gives
an empty result. Only the named columns are read, others, of whatever name, are carried along untouched by :func:`mix`. A very long text is
counted where it lies and moved once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import WORD, documents, running_total, salt_of, salts, staged

WEIGHTS = (3, 1, 2)
UNIT = 1 << 24
#: Up to so many sources are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_pct: int = 150, most: int = 2) -> DataFrame:
    """Per source (columns ``_null``, ``_source``): its size, weight and target.

    The targets are ``min(most * size, level * weight)`` at the level where they add up to ``share_pct`` percent of all
    sizes: what a full source can't take is shared again by weight. One row per source, so the windows are small.
    """
    per = sizes.groupBy("_null", "_source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("source_rows"))
    by_name = Window.partitionBy(F.lit(0)).orderBy("_null", "_source")
    everything = Window.partitionBy(F.lit(0))
    per = (
        per.withColumn("_k", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_k") % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("_all", F.sum("source_size").over(everything))
    )
    by_fill = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("weight"), "_k")
    full_before = F.coalesce(F.sum(most * F.col("source_size")).over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight_left = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("_level", (F.col("_all") * share_pct - full_before * 100) / (weight_left * 100)).withColumn("_order", F.row_number().over(by_fill))
    fits = F.col("_level") * F.col("weight") <= most * F.col("source_size")
    level = F.min(F.when(fits, F.struct("_order", "_level"))).over(everything)["_level"]
    return per.select(
        "_null", "_source", "source_size", "weight", F.least((most * F.col("source_size")).cast("double"), level * F.col("weight")).alias("target")
    )


def draw(sizes: DataFrame, rows: int, weights: tuple[int, ...] = WEIGHTS, share_pct: int = 150, most: int = 2) -> DataFrame:
    """``sizes`` (``_null``, ``_source``, ``_id``, ``_size``) with source_size, target and ``copies`` per row."""
    joined = expecting(sizes, fit_targets(sizes, weights, share_pct, most), rows)
    summed = running_total(joined, ["_null", "_source"], ["_band", "_salt"], [F.col("_size"), F.col("_id").asc_nulls_first()], "_expected", "_upto")
    return drawn(summed)


def fit_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_pct: int = 150, most: int = 2) -> DataFrame:
    """:func:`source_targets`, stored; broadcast up to ``BROADCAST_SOURCES`` of them."""
    targets = staged(source_targets(sizes, weights, share_pct, most), "mix-targets")
    return F.broadcast(targets) if targets.count() <= BROADCAST_SOURCES else targets


def expecting(sizes: DataFrame, targets: DataFrame, rows: int, salt: str = "_id") -> DataFrame:
    """``sizes`` with the expected copies of each row, and the band of sizes and the salt that it is summed in."""
    bits = F.bin("_size")
    expected = F.floor(F.col("target") * UNIT / F.col("source_size")).cast("long")
    return (
        sizes.join(targets, ["_null", "_source"])
        .withColumn("_expected", F.when(F.col("source_size") > 0, expected).otherwise(F.lit(0)))
        .withColumn("_band", F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 1, 4)))
        .withColumn("_salt", salt_of(salt, salts(rows)))
    )


def drawn(summed: DataFrame) -> DataFrame:
    """``summed`` (with ``_upto``, the running sum of expected copies) with ``copies``: the whole numbers that the row's part of the sum crosses."""
    # 24 bits of a digest of the source's name stand for the random offset, so that reruns agree
    name = F.concat(F.when(F.col("_null") == 1, F.lit("null:")).otherwise(F.lit("source:")), F.col("_source"))
    offset = F.conv(F.substring(F.md5(name), 1, 6), 16, 10).cast("long")
    crossed = F.floor((F.col("_upto") + offset) / UNIT) - F.floor((F.col("_upto") - F.col("_expected") + offset) / UNIT)
    return summed.withColumn("copies", crossed.cast("long")).drop("_upto", "_expected", "_band", "_salt", "weight")


def keyed(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(
        F.col(doc_id).alias("_id"),
        F.col(source).isNull().cast("int").alias("_null"),
        F.coalesce(F.col(source), F.lit("")).alias("_source"),
        word_count(text).alias("_size"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return draw(staged(keyed(docs), "mix-sizes"), docs.count()).select(
        F.col("_id").alias("doc_id"),
        F.col("_size").alias("size"),
        "source_size",
        "target",
        (F.col("copies") * F.col("_size")).alias("taken"),
        "copies",
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_pct: int = 150, most: int = 2) -> DataFrame:
    """``docs`` with each row as often as it was drawn. ``docs`` should be a stored table: it is read twice.

    Rows are drawn as they stand, so repeated and missing ids need no care. Sizes alone make the targets and the offsets of the running sums;
    texts are shuffled once.
    """
    rows = docs.count()
    # the row travels as one struct, so that none of its columns can clash with those added here
    boxed = docs.select(F.struct("*").alias("_doc"))
    of = [F.col("_doc.doc_id").alias("_id"), F.col("_doc.source").isNull().cast("int").alias("_null"), F.coalesce("_doc.source", F.lit("")).alias("_source")]
    full = boxed.select("_doc", *of, word_count("_doc.text").alias("_size"), F.xxhash64("_doc").alias("_tie")).withColumn("_deal", F.coalesce("_id", "_tie"))
    sizes = staged(full.drop("_doc"), "mix-sizes")
    targets = fit_targets(sizes, weights, share_pct, most)
    group, bucket = ["_null", "_source"], ["_band", "_salt"]
    before = Window.partitionBy(*group).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = expecting(sizes, targets, rows, "_deal").groupBy(*group, *bucket).agg(F.sum("_expected").alias("_sum"))
    offsets = sums.select(*group, *bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*group, *bucket).orderBy("_size", F.col("_id").asc_nulls_first(), "_tie").rowsBetween(Window.unboundedPreceding, 0)
    summed = expecting(full, targets, rows, "_deal").withColumn("_own", F.sum("_expected").over(within)).join(offsets, group + bucket)
    times = drawn(summed.withColumn("_upto", F.col("_own") + F.col("_before"))).where("copies > 0")
    return times.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("_doc.*")


OP3_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source IS NULL AS is_null, coalesce(source, '') AS src,
         coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents
), per AS (
  SELECT is_null, src, sum(size)::BIGINT AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY is_null, src) - 1) % 3 + 1)::BIGINT] AS weight
  FROM sizes GROUP BY is_null, src
), levels AS (
  SELECT *, row_number() OVER w AS ord,
         (sum(source_size) OVER ()::DOUBLE * 150
          - coalesce(sum(2 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 100)
         / (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * 100) AS level
  FROM per WINDOW w AS (ORDER BY source_size / weight, is_null, src)
), targets AS (
  SELECT is_null, src, source_size,
         least((2 * source_size)::DOUBLE, weight * (SELECT arg_min(level, ord) FROM levels WHERE level * weight <= 2 * source_size)) AS target
  FROM levels
), n AS (SELECT greatest(1, ceil(sqrt(count(*)) / 16))::BIGINT AS salts FROM documents
), expected AS (
  SELECT s.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target * 16777216 / t.source_size)::BIGINT ELSE 0 END AS e,
         lpad(length(bin(size))::VARCHAR, 2, '0') || substr(bin(size), 1, 4) AS band,
         coalesce(((doc_id % salts) + salts) % salts, 0) AS salt,
         ('0x' || substr(md5((CASE WHEN s.is_null THEN 'null:' ELSE 'source:' END) || s.src), 1, 6))::BIGINT AS shift
  FROM sizes s JOIN targets t ON s.is_null = t.is_null AND s.src = t.src CROSS JOIN n
), summed AS (
  SELECT *, (sum(e) OVER (PARTITION BY is_null, src ORDER BY band, salt, size, doc_id NULLS FIRST
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS upto
  FROM expected
)
SELECT doc_id, size, source_size, target,
       ((upto + shift) // 16777216 - (upto - e + shift) // 16777216) * size AS taken,
       (upto + shift) // 16777216 - (upto - e + shift) // 16777216 AS copies
FROM summed
"""
