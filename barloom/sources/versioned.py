"""Tables that are changed partition by partition: only touched partitions are written anew, and a manifest that is swapped at the end says which folder holds each one.

A partition is a whole number. Readers see the table of one manifest: a run that fails, or is read meanwhile, leaves the old one whole. There is one writer at
a time; a manifest that changed since it was read stops the swap. Files go through Hadoop's file systems, so a table may lie wherever Spark reads.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

NAME = "MANIFEST.json"
NOTHING = {"version": 0, "parts": {}}


def _system(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs, conf, at.getFileSystem(conf)


def manifest(spark: SparkSession, path: str) -> dict:
    """``version`` and, by partition, its ``folder``, ``rows`` and ``open`` rows."""
    hadoop, _, system = _system(spark, path)
    file = hadoop.Path(path, NAME)
    if not system.exists(file):
        return NOTHING
    stream = system.open(file)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def swap(spark: SparkSession, path: str, before: dict, after: dict) -> None:
    """Put ``after`` in the place of ``before`` by one rename."""
    if manifest(spark, path)["version"] != before["version"]:
        raise RuntimeError(f"another writer has changed {path}")
    hadoop, conf, system = _system(spark, path)
    fresh, file = hadoop.Path(path, f".{uuid.uuid4().hex}"), hadoop.Path(path, NAME)
    out = system.create(fresh, False)
    out.write(json.dumps(after).encode())
    out.close()
    gateway = spark.sparkContext._gateway
    how = gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.OVERWRITE
    qualified = system.makeQualified(file)
    hadoop.FileContext.getFileContext(qualified.toUri(), conf).rename(system.makeQualified(fresh), qualified, how)


def scan(spark: SparkSession, path: str, schema: str | StructType, parts: list[int] | None = None, of: dict | None = None) -> DataFrame:
    """The rows of all partitions, or of ``parts``."""
    known = (of or manifest(spark, path))["parts"]
    folders = [f"{path}/{p['folder']}" for k, p in sorted(known.items()) if parts is None or int(k) in parts]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert(changes: DataFrame, path: str, keys: list[str], part: Column, is_open: Column | None = None) -> list[int]:
    """Rows of ``changes`` take the place of stored rows of the same keys, or are added; the partitions that were written anew.

    A key's partition must not change. Keys of ``changes`` are unique and not null; there are few partitions. ``is_open`` marks rows that a later run has to look at.
    """
    spark = changes.sparkSession
    before = manifest(spark, path)
    placed = changes.withColumn("_part", part.cast("int"))
    touched = sorted(r[0] for r in placed.select("_part").distinct().collect())
    if not touched:
        return []
    stored = scan(spark, path, changes.schema, touched, before)
    kept = stored.join(changes.select(*keys), keys, "left_anti").withColumn("_part", part.cast("int"))
    version = before["version"] + 1
    folder = f"v{version}-{uuid.uuid4().hex[:8]}"
    rows = kept.unionByName(placed)
    rows.repartition("_part", F.pmod(F.xxhash64(*keys), F.lit(16))).write.partitionBy("_part").parquet(f"{path}/{folder}")
    opened = F.count(F.when(is_open, 1)) if is_open is not None else F.lit(0)
    told = spark.read.schema(StructType([*changes.schema.fields]).add("_part", IntegerType())).parquet(f"{path}/{folder}").groupBy("_part").agg(F.count("*").alias("rows"), opened.alias("open")).collect()
    fresh = {str(r["_part"]): {"folder": f"{folder}/_part={r['_part']}", "rows": r["rows"], "open": r["open"]} for r in told}
    swap(spark, path, before, {"version": version, "parts": before["parts"] | fresh})
    return touched


def open_parts(spark: SparkSession, path: str) -> list[int]:
    """Partitions that hold open rows."""
    return sorted(int(k) for k, p in manifest(spark, path)["parts"].items() if p["open"])


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete partition folders of earlier versions, once nobody reads them any more; how many went."""
    hadoop, _, system = _system(spark, path)
    used = {p["folder"] for p in manifest(spark, path)["parts"].values()}
    gone = 0
    for version in system.listStatus(hadoop.Path(path)):
        if version.isDirectory():
            own = system.listStatus(version.getPath())
            stale = [f.getPath() for f in own if f.isDirectory() and f"{version.getPath().getName()}/{f.getPath().getName()}" not in used]
            for folder in stale:
                gone += bool(system.delete(folder, True))
            if len(stale) == sum(f.isDirectory() for f in own):
                system.delete(version.getPath(), True)
    return gone
