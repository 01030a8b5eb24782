"""Operator 11: quality rules and robust multivariate outliers by minimum covariance determinant (MCD), per language and source.

Base rules reject a text of under 50 words, or with over half of its words in repeated three-word windows. The others' statistics become a vector
(:data:`FEATURES`): the mean word length as a logarithm, and the shares of symbols, of repeated lines and of repeated words as arcsines of square roots,
which evens out their spread. A text is rejected where the vector's squared Mahalanobis distance from its unit's robust centre exceeds :func:`chi_square`
at :data:`TAIL`.

A unit is a language with a source; with fewer than :data:`LEAST` texts that pass the base rules it is the language's unit, then that of all texts; with
fewer texts than that altogether nothing is rejected. The estimate covers all of a unit's texts:

1. Medians and median deviations of each coordinate, from mergeable sketches, start it in three ways: equal weights, the correlation of
   the coordinates' tanh, and the covariance of their directions.
2. A concentration step takes the half of the texts that are nearest (``h = (n + p + 1) div 2``) and their mean and covariance. The texts' moments are
   summed by unit and bin of distance, before any shuffle, and the bins are added up to h, the last one in part; so a step is one aggregation over narrow rows,
   however many of them one unit holds. The determinant never grows, but for the width of a bin.
3. After two steps of each start the one of the least determinant goes on, until no determinant falls any more.
4. The covariance is made consistent by the median distance, and texts within the 0.975 quantile give the final mean and covariance.

Each coordinate's variance is raised by :data:`FLOORS` squared, what even a uniform source may vary by; so coordinates that are the same
in most texts (no symbols, no repeated lines) leave the matrix regular, and small deviations from a very even source reject nothing.

Defined cases: null and empty texts have zeros and fail the base rules; null languages and sources are values of their own; repeated rows count as often as
they come, also without an id; columns other than doc_id, text, lang and source aren't read; an empty table gives an empty result; a
very long text is counted in its task, and its length alone never rejects it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import documents, ship, staged

SYMBOLS, GAPS = "#*$%&|<>", " \t\n\r\x0b\x0c"
LEAST_WORDS, MOST_REPEATED = 50, 50
#: What of a chi-square distribution lies beyond the limit, and texts that a unit needs.
TAIL, LEAST = 1e-9, 40
FEATURES = ("word_length", "symbols", "lines", "repeats")
#: Deviations that a coordinate always has.
FLOORS = (0.08, 0.02, 0.15, 0.12)
#: Bins of a doubling of the squared distance; concentration steps at most.
BINS, STEPS = 16, 30
#: A unit's rows are dealt into so many parts for each of this many rows.
SALTED = 50_000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTED = "row long, doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in [*COUNTS, "n_lines"])


def chi_square(tail: float, p: int) -> float:
    """The value that a chi-square variable of ``p`` (even) degrees of freedom exceeds with this probability."""

    def beyond(x: float) -> float:
        return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))

    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if beyond(middle) > tail else (low, middle)
    return low


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window which the text holds more than once."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often = {w for w, n in Counter(windows).items() if n > 1}
    total, covered = 0, 0
    if often:
        for k, window in enumerate(windows):
            if window in often:
                total += k + 3 - max(k, covered)
                covered = k + 3
    return total


def statistics(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the lines that hold a word."""
    text = text or ""
    # bytes.split() knows the six ASCII gaps only, as asked for
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [line for line in text.split("\n") if line.strip(GAPS)]
    chars = len(text) - sum(map(text.count, GAPS))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, lang, source) to their statistics, with a number for each row."""
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        texts = batch.column(1)
        made = np.array([statistics(texts[k].as_py()) for k in range(batch.num_rows)], np.int64).reshape(-1, 6)
        numbers = pa.array(np.arange(row, row + batch.num_rows), pa.int64())
        row += batch.num_rows
        columns = [numbers, batch.column(0), batch.column(2), batch.column(3), *[pa.array(made[:, k]) for k in range(6)]]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in COUNTED.split(", ")])


def share(part: str, whole: str) -> Column:
    """The arcsine of a share's square root, with the usual correction for small counts."""
    return F.asin(F.sqrt((F.least(part, whole) + 0.375) / (F.col(whole) + 0.75)))


def coordinates() -> list[Column]:
    length = F.log(F.col("word_chars") / F.col("n_words"))
    return [c.alias(f"x{k}") for k, c in enumerate((length, share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")))]


P = len(FEATURES)
XS = [f"x{k}" for k in range(P)]
CROSS = [(i, j) for i in range(P) for j in range(i, P)]
ESTIMATE = "unit string, start int, mean array<double>, inverse array<double>, log_det double, spread array<double>"


def matrix(upper) -> np.ndarray:
    out = np.zeros((P, P))
    for (i, j), v in zip(CROSS, upper, strict=True):
        out[i, j] = out[j, i] = v
    return out


def flat(m: np.ndarray) -> list[float]:
    return [float(m[i, j]) for i, j in CROSS]


def estimate(unit: str, start: int, mean: np.ndarray, spread: np.ndarray) -> tuple:
    """A row of an estimate; ``spread`` is the covariance before the floors."""
    full = spread + np.diag(np.square(FLOORS))
    return unit, start, mean.tolist(), flat(np.linalg.inv(full)), float(np.linalg.slogdet(full)[1]), flat(spread)


def told(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in ESTIMATE.split(", ")])


def units(keyed: DataFrame) -> DataFrame:
    """Each language and source of the texts that pass the base rules (``of_source``, ``of_lang``: their names) with its unit and the units that its texts
    tell about: (of_source, unit, salts, joins: array of (unit, salts))."""
    own = staged(keyed.groupBy("of_source", "of_lang").agg(F.count("*").alias("n_source")), "outliers-sources")
    everything = own.agg(F.sum("n_source")).first()[0] or 0
    sized = own.join(own.groupBy(F.col("of_lang").alias("lang")).agg(F.sum("n_source").alias("n_lang")), F.col("of_lang") == F.col("lang")).withColumn("n_all", F.lit(everything))
    level = F.when(F.col("n_source") >= LEAST, "source").when(F.col("n_lang") >= LEAST, "lang").when(F.col("n_all") >= LEAST, "all")
    sized = staged(sized.withColumns({"of_all": F.lit("0"), "level": level}), "outliers-levels")
    asked = sized.where("level = 'lang'").select("lang").distinct().withColumn("asked", F.lit(True))
    nobody_else = F.lit(sized.where("level = 'all'").isEmpty())
    kinds = ("source", F.col("level") == "source"), ("lang", F.col("asked")), ("all", ~nobody_else)
    salts = {k: F.ceil(F.col(f"n_{k}") / SALTED).cast("int") for k, _ in kinds}
    joins = [F.when(wanted, F.struct(F.col(f"of_{k}").alias("unit"), salts[k].alias("salts"))) for k, wanted in kinds]
    at = {k: F.col("level") == k for k, _ in kinds}
    unit, salt = F.coalesce(*[F.when(at[k], F.col(f"of_{k}")) for k in at]), F.coalesce(*[F.when(at[k], salts[k]) for k in at])
    return sized.join(asked, "lang", "left").select("of_source", unit.alias("unit"), salt.alias("salts"), F.filter(F.array(*joins), lambda x: x.isNotNull()).alias("joins"))


def with_salt(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int"))


def by_salt(table: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row of ``table`` (by unit) for each salt of its unit."""
    return table.join(sizes, "unit").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")


def distance() -> Column:
    """The squared Mahalanobis distance of x0, x1, ... by mean and inverse."""
    d = [F.col(x) - F.get("mean", F.lit(k)) for k, x in enumerate(XS)]
    terms = [(1 if i == j else 2) * F.get("inverse", F.lit(k)) * d[i] * d[j] for k, (i, j) in enumerate(CROSS)]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


def moments(of: list[Column]) -> list[Column]:
    """Sums over texts of ones, coordinates and their products."""
    return [F.count("*").cast("double").alias("n"), *[F.sum(c).alias(f"s{k}") for k, c in enumerate(of)], *[F.sum(of[i] * of[j]).alias(f"c{i}{j}") for i, j in CROSS]]


def spread_of(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance (by n) from moments."""
    mean = total[1 : P + 1] / total[0]
    return mean, matrix(total[P + 1 :] / total[0]) - np.outer(mean, mean)


SUMS = ["n", *[f"s{k}" for k in range(P)], *[f"c{i}{j}" for i, j in CROSS]]


def starts(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Three first estimates of a unit from medians, deviations and two sets of moments."""
    row = rows.iloc[0]
    middle, scale = np.array(row["medians"]), np.maximum(np.array(row["deviations"]) * 1.4826, FLOORS)
    out = []
    for start, prefix in enumerate(("", "t_", "u_")):
        shape = np.eye(P)
        if prefix:
            _, shape = spread_of(row[[prefix + s for s in SUMS]].to_numpy(float))
            across = np.sqrt(np.maximum(np.diag(shape), 1e-12))
            shape = shape / np.outer(across, across) * 0.99 + np.eye(P) * 0.01
        out.append(estimate(key[0], start, middle, shape * np.outer(scale, scale)))
    return told(out)


def half(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The next estimate of a unit and start: moments (about the last mean) of the nearest half, by bins of distance."""
    rows = rows.sort_values("bin")
    sums = rows[SUMS].to_numpy(float)
    n = sums[:, 0].sum()
    h = (n + P + 1) // 2
    before = np.cumsum(sums[:, 0]) - sums[:, 0]
    weight = np.clip((h - before) / sums[:, 0], 0, 1)
    shift, spread = spread_of((sums * weight[:, None]).sum(axis=0))
    return told([estimate(key[0], int(key[1]), np.array(rows["mean"].iloc[0]) + shift, spread)])


def within(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The reweighted estimate: the covariance made consistent by the median distance, then texts within the 0.975 quantile."""
    rows = rows.sort_values("bin")
    sums = rows[SUMS].to_numpy(float)
    counts = np.cumsum(sums[:, 0])
    middle = 2.0 ** ((rows["bin"].to_numpy()[np.searchsorted(counts, counts[-1] / 2)] + 0.5) / BINS)
    scale = max(1.0, middle / chi_square(0.5, P))
    near = 2.0 ** (rows["bin"].to_numpy() / BINS) <= scale * chi_square(0.025, P)
    shift, spread = spread_of(sums[near].sum(axis=0))
    return told([estimate(key[0], int(key[1]), np.array(rows["mean"].iloc[0]) + shift, spread)])


def step(points: DataFrame, estimates: DataFrame, sizes: DataFrame, solve) -> DataFrame:
    """One pass over all points: moments about the last mean by unit, start and bin of distance, and what ``solve`` makes of them."""
    near = points.join(by_salt(estimates.select("unit", "start", "mean", "inverse"), sizes), ["unit", "salt"])
    about = [F.col(x) - F.get("mean", F.lit(k)) for k, x in enumerate(XS)]
    binned = near.withColumn("bin", F.floor(F.log2(distance() + 1e-12) * BINS).cast("int"))
    sums = binned.groupBy("unit", "start", "bin").agg(F.first("mean").alias("mean"), *moments(about))
    return staged(sums.groupBy("unit", "start").applyInPandas(solve, ESTIMATE), "outliers-step")


def robust(points: DataFrame, sizes: DataFrame) -> DataFrame:
    """(unit, mean, inverse) of stored ``points`` (unit, salt, x0, x1, ...): the reweighted MCD estimate of each unit."""
    medians = points.groupBy("unit").agg(F.array(*[F.percentile_approx(x, 0.5, 1000) for x in XS]).alias("medians"))
    medians = staged(medians, "outliers-medians")
    off = points.join(by_salt(medians, sizes), ["unit", "salt"])
    deviations = off.groupBy("unit").agg(F.array(*[F.percentile_approx(F.abs(F.col(x) - F.get("medians", F.lit(k))), 0.5, 1000) for k, x in enumerate(XS)]).alias("deviations"))
    scales = staged(medians.join(deviations, "unit"), "outliers-scales")
    scaled = points.join(by_salt(scales, sizes), ["unit", "salt"])
    z = [(F.col(x) - F.get("medians", F.lit(k))) / F.greatest(F.get("deviations", F.lit(k)) * 1.4826, F.lit(FLOORS[k])) for k, x in enumerate(XS)]
    norm = F.greatest(F.sqrt(sum((c * c for c in z[1:]), z[0] * z[0])), F.lit(1e-9))
    tanh = [c.alias("t_" + s) for c, s in zip(moments([F.tanh(c) for c in z]), SUMS, strict=True)]
    signs = [c.alias("u_" + s) for c, s in zip(moments([c / norm for c in z]), SUMS, strict=True)]
    shapes = scaled.groupBy("unit").agg(F.first("medians").alias("medians"), F.first("deviations").alias("deviations"), *tanh, *signs)
    now = staged(shapes.groupBy("unit").applyInPandas(starts, ESTIMATE), "outliers-starts")
    for _ in range(2):
        now = step(points, now, sizes, half)
    least = now.groupBy("unit").agg(F.min_by("start", F.struct("log_det", "start")).alias("start"))
    now = now.join(least, ["unit", "start"])
    for _ in range(STEPS):
        last, now = now, step(points, now, sizes, half)
        fell = last.select("unit", F.col("log_det").alias("before")).join(now.select("unit", "log_det"), "unit").agg(F.max(F.col("before") - F.col("log_det"))).first()[0]
        if fell is None or fell < 1e-3:
            break
    return step(points, now, sizes, within).select("unit", "mean", "inverse")


def judge(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang, source) with statistics, ``base_failed``, ``kept``, the ``unit`` that judged and the squared ``distance``."""
    ship(docs.sparkSession)
    counted = staged(docs.select(F.col("doc_id").cast("long"), "text", "lang", "source").mapInArrow(count, COUNTED), "outliers-counted")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    names = {"of_source": F.concat(F.lit("2"), F.to_json(F.struct("lang", "source"))), "of_lang": F.concat(F.lit("1"), F.to_json(F.struct("lang")))}
    named = counted.withColumn("base_failed", failed)
    passed = named.where("NOT base_failed").withColumns(names).select("row", "of_source", "of_lang", *coordinates())
    found = staged(units(passed), "outliers-units")
    # nothing is grouped behind this join, so Spark may split a hot source's rows
    met = staged(passed.drop("of_lang").join(found, "of_source").drop("of_source"), "outliers-rows")
    points = with_salt(met.select("row", *XS, F.explode("joins").alias("j")).select("row", *XS, "j.unit", "j.salts"))
    points = staged(points.drop("row", "salts"), "outliers-points")
    sizes = found.select(F.explode("joins").alias("j")).select("j.unit", "j.salts").distinct()
    models = robust(points, sizes)
    far = with_salt(met.select("row", *XS, "unit", "salts")).join(by_salt(models, sizes), ["unit", "salt"]).select("row", "unit", distance().alias("distance"))
    judged = named.join(far, "row", "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi_square(TAIL, P), F.lit(True))
    return judged.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), "unit", "distance")


def op11_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))
