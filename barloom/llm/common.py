"""Helpers that several training-data operators share."""

from __future__ import annotations

import math
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors through Spark, once for each application: their Python workers import it."""
    context = spark.sparkContext
    if not hasattr(context, "_barloom_shipped"):
        package = Path(__file__).resolve().parents[1]
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/{package.name}", "zip", package.parent, package.name)
        context.addPyFile(archive)
        context._barloom_shipped = archive


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset a local session gets a temporary folder; any other master is refused, because a
    machine-local folder is not seen by the other executors.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/barloom-{context.applicationId}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salts(rows: int, per: int = 16) -> int:
    """A number of salts that grows with the square root of the rows, so that neither the rows of a salt nor the salts become one task's burden."""
    return max(1, math.ceil(math.sqrt(rows) / per))


def salt_of(column: str, n: int) -> Column:
    return F.coalesce(F.pmod(F.col(column), F.lit(n)), F.lit(0)).cast("long")


def running_total(df: DataFrame, group: list[str], bucket: list[str], order: list, value: str, out: str) -> DataFrame:
    """Inclusive running sum of ``value`` within ``group``, in the order (``bucket``, ``order``).

    Two levels, so that a group holding a third of all rows never meets in one task: rows are summed within
    (group, bucket), and one row per bucket carries the offset. ``group`` and ``bucket`` must not be null.
    """
    keys = group + bucket
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys)
        .agg(F.sum(value).alias("_sum"))
        .select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    )
    return (
        df.withColumn(out, F.sum(value).over(within))
        .join(offsets, keys)
        .withColumn(out, F.col(out) + F.col("_before"))
        .drop("_before")
    )
