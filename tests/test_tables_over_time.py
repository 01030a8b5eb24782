"""Tables changed partition by partition, bucketed bars, and digests that find what changed."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import digests, features
from barloom.sources import files, tables, versioned

ROWS = "k long, year int, v string"


def upserted(spark, rows, path, **more):
    return versioned.upsert(spark.createDataFrame(rows, ROWS), path, ["k"], F.col("year"), **more)


def test_upsert_rewrites_touched_partitions_only(spark, tmp_path):
    path, rng, want = str(tmp_path / "t"), random.Random(1), {}
    folders = {}
    for run in range(6):
        changes = {k: (k, k % 5, f"{run}-{k}") for k in rng.sample(range(200), 8 if run else 90) if not run or k % 5 in (1, run % 5)}
        touched = upserted(spark, list(changes.values()), path, is_open=F.col("v").startswith("3-"))
        want |= changes
        assert touched == sorted({c[1] for c in changes.values()})
        told = versioned.manifest(spark, path)
        now = {int(k): p["folder"] for k, p in told["parts"].items()}
        assert told["version"] == run + 1 and {k for k in now if now[k] != folders.get(k)} == set(touched)
        folders = now
        assert sorted(tuple(r) for r in versioned.scan(spark, path, ROWS).collect()) == sorted(want.values())
    assert versioned.open_parts(spark, path) == sorted({c[1] for c in want.values() if c[2].startswith("3-")})
    assert sum(p["rows"] for p in versioned.manifest(spark, path)["parts"].values()) == len(want)
    before = sum(len(d) for _, d, _ in os.walk(path))
    assert versioned.vacuum(spark, path) > 0 and sum(len(d) for _, d, _ in os.walk(path)) < before
    assert sorted(tuple(r) for r in versioned.scan(spark, path, ROWS, [1, 2]).collect()) == sorted(c for c in want.values() if c[1] in (1, 2))


def test_a_failed_run_and_a_second_writer_leave_the_table_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    assert upserted(spark, [(1, 1, "a"), (2, 2, "b")], path) == [1, 2]
    fails = spark.createDataFrame([(1, 1, "x")], ROWS).withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        versioned.upsert(fails, path, ["k"], F.col("year"))
    old = versioned.manifest(spark, path)
    assert upserted(spark, [(3, 2, "c")], path) == [2] and upserted(spark, [], path) == []
    with pytest.raises(RuntimeError):
        versioned.swap(spark, path, old, old)
    assert sorted(tuple(r) for r in versioned.scan(spark, path, ROWS).collect()) == [(1, 1, "a"), (2, 2, "b"), (3, 2, "c")]
    assert [tuple(r) for r in versioned.scan(spark, path, ROWS, of=old).orderBy("k").collect()] == [(1, 1, "a"), (2, 2, "b")]


def test_only_years_with_open_predictions_are_written(spark, tmp_path):
    path, days = str(tmp_path / "p"), [dt.date(2020, 1, 1) + dt.timedelta(days=40 * k) for k in range(30)]
    panel = spark.createDataFrame([("A", d, 10.0 + k) for k, d in enumerate(days)], "symbol string, bar date, close double")
    made = panel.select("symbol", "bar", F.lit("1d").alias("horizon"), F.lit(0.7).alias("prob"))
    old, late = F.col("bar") <= F.lit(days[20]), F.col("bar") > F.lit(days[20])
    years = sorted({d.year for d in days})
    assert files.record_predictions(made.where(old), path) == [y for y in years if y <= days[20].year]
    files.resolve_open(panel.where(old), path, {"1d": 1})
    assert versioned.open_parts(spark, path) == [days[20].year]
    parts = versioned.manifest(spark, path)["parts"]
    files.record_predictions(made.where(late), path)
    assert set(files.resolve_open(panel, path, {"1d": 1})) == {d.year for d in days[20:-1]}
    now = versioned.manifest(spark, path)["parts"]
    assert now[str(years[0])] == parts[str(years[0])] and versioned.open_parts(spark, path) == [days[-1].year]
    got = versioned.scan(spark, path, files.PREDICTIONS).orderBy("bar").collect()
    assert [(r.bar, r.resolved_at, r.correct) for r in got] == [*zip(days, days[1:], [1] * 29, strict=False), (days[-1], None, None)]


def walk_panel(spark):
    rng = random.Random(7)
    rows = [(s, dt.date(2020, 1, 6) + dt.timedelta(days=7 * k), *[round(rng.uniform(90, 110), 2) for _ in range(4)], float(rng.randint(1, 99))) for s in "ABCDEF" for k in range(80)]
    return spark.createDataFrame(rows, "symbol string, bar date, open double, high double, low double, close double, volume double")


def test_bucketed_bars_need_no_exchange_by_symbol(spark, tmp_path):
    panel = walk_panel(spark)
    stored = files.write_bucketed(panel, "bars_of_a_test", str(tmp_path / "b"), 4)
    tables.benchmark(panel).write.parquet(str(tmp_path / "bench"))
    bench = spark.read.parquet(str(tmp_path / "bench"))
    one, other = features.feature_panel(stored, bench), features.feature_panel(panel, bench)
    key = F.md5(F.to_json(F.struct("*")))
    assert sorted(r[0] for r in one.select(key).collect()) == sorted(r[0] for r in other.select(key).collect())

    def exchanges(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange hashpartitioning(symbol")

    assert exchanges(one) == 0 and exchanges(other) > 0
    spark.sql("DROP TABLE bars_of_a_test")


def test_digests_add_up_and_find_changes(spark, tmp_path):
    panel = walk_panel(spark).withColumn("year", F.year("bar"))
    of = [F.col("symbol"), F.col("bar"), F.col("close")]
    keys = ["year", "symbol"]
    one = sorted(tuple(r) for r in digests.tree(panel, keys, of).na.fill("", ["symbol"]).na.fill(0, ["year"]).collect())
    assert one == sorted(tuple(r) for r in digests.tree(panel.repartition(7).orderBy(F.rand(1)), keys, of).na.fill("", ["symbol"]).na.fill(0, ["year"]).collect())
    assert sum(r[3] for r in one if r[0] == 2) == 480 and [r[3] for r in one if r[0] == 0] == [480]
    tweaked = panel.withColumn("close", F.when((F.col("symbol") == "C") & (F.col("bar") == F.lit(dt.date(2021, 2, 1))), F.col("close") + 0.01).otherwise(F.col("close")))
    moved = panel.where("NOT (symbol = 'E' AND year = 2020)")
    stored = []
    for k, df in enumerate((panel, tweaked, moved, panel.unionByName(panel.where("symbol = 'A' AND bar = '2020-01-06'")))):
        digests.tree(df, keys, of).write.parquet(str(tmp_path / f"d{k}"))
        stored.append(spark.read.parquet(str(tmp_path / f"d{k}")))
    assert digests.changed(stored[0], stored[0], keys).collect() == []
    assert [(r.year, r.symbol) for r in digests.changed(stored[0], stored[1], keys).collect()] == [(2021, "C")]
    assert [tuple(r) for r in digests.changed(stored[0], stored[2], keys).collect()] == [(2020, "E", 52, None)]
    assert [tuple(r) for r in digests.changed(stored[0], stored[3], keys).collect()] == [(2020, "A", 52, 53)]
    assert digests.tree(panel.limit(0), keys, of).collect() == []
