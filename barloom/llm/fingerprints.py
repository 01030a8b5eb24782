"""Operator 1: document fingerprints, bottom-k sketches of word-shingle hashes (built-in functions only).

A sketch is the sorted array of the k smallest different 64-bit hashes of a text's shingles (five words, lower case).
It is a plain ``array<bigint>``:

* sketches of parts merge to the sketch of the whole: :func:`merge`, or :func:`merge_sketches` as an aggregation
* :func:`resemblance`, :func:`containment` and :func:`distinct_shingles` estimate from sketches alone

Texts of fewer than five words have one shingle, the whole sequence; texts without words have an empty sketch.
Two empty sketches resemble each other fully (1.0), an empty and another one not at all (0.0).

The query also needs the next document in descending order of id. Ids are cut into ranges at approximate quantiles,
so text is shuffled once, by range; each range also gets the first document of the following range, and a window
within the range finds the neighbour. At most ``MOST_RANGES`` such documents exist, whatever the input. An id that fills several ranges
(a missing one, say) is spread over them by a hash of the text.

Defined cases: a null text counts as empty; null ids come last; rows of one id are ordered by a hash of their text; with one
document the next one is the document itself; the query reads doc_id and text only; an empty table gives an empty result; a very long text is
one row, its shingles' hashes eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import GAP, documents

K = 128
SHINGLE = 5
RANGE_ROWS = 2048
MOST_RANGES = 90_000
_STEP = 300
_ALL = 1 << 30
_NO_ID = -(1 << 63)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once per row although ``body`` uses it in lambdas (which else compute it per element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column) -> Column:
    """Hashes of the text's shingles in their order, repeats included. ``text`` must not be null."""
    words = F.array_remove(F.split(F.lower(text), GAP), "")

    def shingles(h: Column) -> Column:
        n = F.size(h)
        rolled = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, SHINGLE)]))
        whole = F.when(n > 0, F.array(F.aggregate(h, F.lit(0).cast("long"), lambda acc, x: F.xxhash64(acc, x)))).otherwise(F.array().cast("array<bigint>"))
        return F.when(n >= SHINGLE, F.slice(rolled, F.lit(1), F.greatest(n - SHINGLE + 1, F.lit(0)))).otherwise(whole)

    return let(F.transform(words, lambda w: F.xxhash64(w)), shingles)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K) -> Column:
    return bottom(shingle_hashes(text), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_sketches(df: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """One merged sketch per key. Each key's hashes are made distinct before the k smallest are kept, by a ranked window
    whose limit Spark applies before the shuffle, so a hot key moves k rows per task."""
    hashes = df.select(*keys, F.explode(column).alias("_h"))
    smallest = Window.partitionBy(*keys).orderBy("_h")
    kept = hashes.withColumn("_n", F.dense_rank().over(smallest)).where(F.col("_n") <= k)
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_set("_h")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: the share of the union's k smallest hashes that both sketches hold."""
    both = let(merge(a, b, k), lambda u: F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.greatest(F.size(u), F.lit(1)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of different shingles: exact below k, else (k - 1) over the k-th hash's place in the hash range."""
    place = (F.element_at(a, -1).cast("double") + float(1 << 63)) / float(1 << 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    return F.concat_ws("", F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")))


def range_of(key: Column, bounds: list[int]) -> Column:
    """The number of ``bounds`` (ascending) that are not above ``key``, looked up in two steps."""
    if not bounds:
        return F.lit(0)
    held = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    if len(bounds) <= _STEP:
        return F.size(F.filter(held, lambda b: b <= key))
    tops = F.split(F.lit(",".join(map(str, bounds[::_STEP]))), ",").cast("array<bigint>")
    block = F.size(F.filter(tops, lambda b: b <= key))
    within = F.size(F.filter(F.slice(held, (F.greatest(block, F.lit(1)) - 1) * _STEP + 1, F.lit(_STEP)), lambda b: b <= key))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * _STEP + within)


def with_next(docs: DataFrame, value: Callable[[Column], Column]) -> DataFrame:
    """``docs`` (doc_id, text) with ``value`` of the text, and ``next_text`` and ``next_value`` of the next document in descending order of id."""
    text = F.coalesce("text", F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    keyed = docs.select("doc_id", text.alias("text"), key.alias("_key"), F.shiftrightunsigned(F.xxhash64(text), 1).alias("_hash"))
    ranges = min(MOST_RANGES, -(-docs.count() // RANGE_ROWS))
    bounds: list[int] = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        bounds = sorted(keyed.agg(F.percentile_approx("_key", shares, max(10_000, 10 * ranges))).first()[0])
    keyed = keyed.withColumn("_range", range_of(F.col("_key"), bounds))
    if len(set(bounds)) < len(bounds):
        # a key that is a bound n times has n ranges: its rows go down from the highest by their hash
        below = F.when(F.col("_key") == _NO_ID, F.lit(0)).otherwise(range_of(F.greatest(F.col("_key"), F.lit(_NO_ID + 1)) - 1, bounds))
        own = F.greatest(F.col("_range") - below, F.lit(1))
        keyed = keyed.withColumn("_range", F.col("_range") - F.least(own - 1, F.floor(F.col("_hash") / F.lit(2.0**63) * own)).cast("int"))
    # the first row of each range, handed to the range above; one row per range
    firsts = keyed.groupBy("_range").agg(F.max(F.struct("_key", (-F.col("_hash")).alias("_minus"))).alias("_first"))
    lower = Window.partitionBy(F.lit(0)).orderBy("_range")
    handed = firsts.select(F.col("_range").alias("_to"), F.coalesce(F.lag("_first").over(lower), F.max("_first").over(Window.partitionBy(F.lit(0)))).alias("_first"))
    handed = handed.select("_to", F.col("_first._key").alias("_key"), (-F.col("_first._minus")).alias("_hash"))
    guests = keyed.join(F.broadcast(handed), ["_key", "_hash"]).groupBy("_to").agg(F.min("text").alias("text"))
    guests = guests.select(F.lit(None).cast(keyed.schema["doc_id"].dataType).alias("doc_id"), "text", F.lit(0).cast("long").alias("_key"), F.lit(0).cast("long").alias("_hash"), F.col("_to").alias("_range"), F.lit(1).alias("_guest"))
    dealt = keyed.withColumn("_guest", F.lit(0)).unionByName(guests).repartition("_range").withColumn("value", value(F.col("text")))
    order = Window.partitionBy("_range").orderBy("_guest", F.desc("_key"), "_hash", "text")
    return (
        dealt.withColumn("next_text", F.lead("text").over(order))
        .withColumn("next_value", F.lead("value").over(order))
        .where(F.col("_guest") == 0)
        .drop("_guest", "_key", "_hash", "_range")
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_next(documents(spark, sf_dir).select("doc_id", "text"), sketch)
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = docs.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), n - cut), F.col("next_text").substr(F.lit(1), cut))).withColumn(
        "n_chars", n.cast("long")
    )
    both = edited.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "value", "next_value", sketch(F.col("edited")).alias("edited_value"))
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("value")).alias("fingerprint"),
        as_text(F.col("edited_value")).alias("edited_fingerprint"),
        resemblance(F.col("value"), F.col("edited_value")).alias("near_edited"),
        resemblance(F.col("value"), F.col("next_value")).alias("near_next"),
        distinct_shingles(F.col("value")).alias("shingles"),
        containment(F.col("edited_value"), F.col("value")).alias("edited_within"),
    )
