"""Steps whose work must spread over tasks and grow with their rows."""

import datetime as dt
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickerloom.config import FoldSettings
from tickerloom.functions.series import Series, expanding_pct_rank
from tickerloom.operators import folds, models, statistics, tracking
from tickerloom.session import removed, stored_rounded


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_expanding_rank_reads_each_row_once(spark):
    """Ties, signed zeros, NaN above all numbers, missing values, null dates first, null keys without a rank; rows are not multiplied."""
    values = [3.0, None, 1.0, -0.0, 0.0, 3.0, float("nan"), float("inf"), float("nan")]
    rows = [("a", i, i % 2, v) for i, v in enumerate(values)] + [("a", None, 0, 9.0), (None, 1, 0, 2.0), ("b", 5, 1, None)]
    df = spark.createDataFrame(rows, "z string, d int, other int, v double")
    out = expanding_pct_rank(df, "v", "r", 2, Series(("z",), ("d",)))
    assert out.columns == ["z", "d", "other", "v", "r"] and "Generate" not in plan(out)
    got = {(r["z"], r["d"]): r["r"] for r in out.collect()}
    past, want = [9.0], {}
    order = lambda v: (1, 0.0) if math.isnan(v) else (0, v + 0.0)
    for i, v in enumerate(values):
        if v is not None:
            past.append(v)
            below, equal = sum(order(p) < order(v) for p in past), sum(order(p) == order(v) for p in past)
            want[i] = (below + (equal + 1) / 2) / len(past)
    assert all(got["a", i] == (pytest.approx(want[i]) if i in want else None) for i in range(len(values)))
    assert got["a", None] is None and got[None, 1] is None and got["b", 5] is None and len(got) == len(rows)


def test_backfilled_pairs_are_made_in_many_tasks(spark):
    runs = spark.range(40).select(F.col("id").alias("run_id"), F.when(F.col("id") % 2 == 0, "completed").otherwise("failed").alias("status")).coalesce(1)
    have = spark.createDataFrame([(0,), (4,)], "run_id long")
    listing = spark.range(30).select(F.concat(F.lit("f"), "id").alias("name"), F.col("id").alias("size_bytes"), F.lit("t").alias("content_type"), F.lit("o").alias("artifact_type"))
    out = tracking.backfill_artifacts(runs, have, listing)
    assert out.columns == ["run_id", "name", "size_bytes", "content_type", "artifact_type"] and out.distinct().count() == out.count() == 18 * 30
    assert "collect_list" not in plan(out) and out.select(F.spark_partition_id().alias("p")).distinct().count() > 3
    assert tracking.backfill_artifacts(runs, have, listing.limit(0)).isEmpty()


def test_regime_filter_never_gathers_a_fold(spark):
    """No row of ``train`` is dealt by its fold, however large the tables are taken to be."""
    rows = spark.range(1000).select((F.col("id") % 2).cast("int").alias("fold"), (F.col("id") % 7).cast("int").alias("regime"), "id")
    current = spark.createDataFrame([(0, 3), (1, 6)], "fold int, current_regime int")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = folds.regime_filter(rows, current)
        assert plan(out).count("SortMergeJoin") <= 1  # that of the rules themselves
        assert {(r["fold"], r["regime"]) for r in out.select("fold", "regime").distinct().collect()} == {(0, 3), (1, 6)}
        assert folds.regime_filter(rows, current, min_rows=10_000).count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_days_are_joined_without_a_shuffle_of_rows(spark, tmp_path):
    """The mark of validation and the weight by age come from a row for each fold and day; only the day of the cut is ranked."""
    data = [(fold, dt.date(2020, 1, 1) + dt.timedelta(days=d), f"t{(7 * i + d) % 11:02d}", float(i)) for fold in (0, 1) for d in range(12) for i in range(11)]
    rows = spark.createDataFrame([*data, (0, None, "t00", 0.0), (None, dt.date(2020, 1, 1), "t00", 0.0)], "fold int, date date, ticker string, x double")
    split = folds.train_valid_split(rows, fraction=0.3, min_rows=5)
    weighted = folds.time_decay_weights(rows, 0.9)
    for made in (split, weighted):
        assert "BroadcastHashJoin" in made._jdf.queryExecution().sparkPlan().toString()
    found = split.collect()
    for fold in (0, 1):
        last = sorted(((r["date"], r["ticker"]) for r in found if r["fold"] == fold), reverse=True)
        assert len(last) == 132 and {(r["date"], r["ticker"]) for r in found if r["fold"] == fold and r["is_valid"]} == set(last[:39])
        mine = [r for r in weighted.collect() if r["fold"] == fold]
        assert len(mine) == 132 and abs(sum(r["weight"] for r in mine) - 132) < 1e-9
    assert {r["fold"] for r in found} == {0, 1}


def test_folds_are_dealt_without_copies_of_their_rows(spark, tmp_path, monkeypatch):
    """Rows lie in several folds; what is written has a row for each fold and day, and the one day of each fold that is ranked."""
    monkeypatch.setattr("tickerloom.session.shared_folder", lambda spark: str(tmp_path))
    data = [(dt.date(2020, 1, 1) + dt.timedelta(days=d), f"t{i:02d}", 1, float(i), 0) for d in range(100) for i in range(9)]
    table = spark.createDataFrame(data, "date date, ticker string, regime int, x double, label int")
    ends = [folds.Fold(k, dt.date(2020, 1, 1), dt.date(2020, 2, 10 + k), dt.date(2020, 2, 11 + k), dt.date(2020, 3, 30)) for k in range(3)]
    rows = models.fold_rows(table, ends, FoldSettings(min_test_rows=1))
    made = {p.name: spark.read.parquet(str(p)) for p in tmp_path.iterdir()}
    assert made and all("x" not in t.columns or t.count() <= 3 * 9 for t in made.values())
    got = {r["fold"]: (r["n"], r["v"]) for r in rows.train.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_valid").cast("int")).alias("v")).collect()}
    assert got == {k: (n, int(n * 0.2)) for k, n in ((0, 41 * 9), (1, 42 * 9), (2, 43 * 9))} and rows.test.where("fold = 0").count() == 49 * 9
    assert rows.train.where("is_valid").exceptAll(rows.train.where("is_valid")).isEmpty()


def test_files_of_a_shuffle_go_with_its_statement(spark):
    """Another reader of the same plan makes them anew."""
    from tickerloom.session import apply_settings

    held = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    known = lambda: sum(held.containsShuffle(i) for i in range(3000))
    counts = apply_settings(spark).range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before = known()
    first = counts.collect()
    assert known() <= before and sorted(map(tuple, first)) == sorted(map(tuple, counts.collect()))


def test_drift_and_leakage_take_all_features_in_one_pass(spark):
    """Rows are not multiplied by features; the figures are those of long tables and of numpy. A constant, an empty and a scarce column."""
    r = np.random.default_rng(2)
    data = [(i, float(v), 7.1, None, float(v) if i % 300 == 0 else None, float(w)) for i, (v, w) in enumerate(r.normal(size=(900, 2)))]
    rows = spark.createDataFrame(data, "id int, a double, b double, c double, d double, fwd_return double").withColumn("fwd_return", F.when(F.col("id") % 9 != 0, F.col("a") + F.col("fwd_return"))).repartition(5)
    names, old, new = list("abcd"), rows.where("id < 500"), rows.where("id >= 500")
    found = statistics.feature_psi(old, new, names)
    assert "Generate" not in plan(found)
    want = {x["feature"]: x["psi"] for x in statistics.psi_table(statistics.long_features(old, names), statistics.long_features(new, names)).collect()}
    assert {x["feature"]: x["psi"] for x in found.collect()} == pytest.approx(want, rel=1e-12) and set(want) == {"a", "b"}
    told = {x["feature"]: x for x in statistics.leakage_check(rows, names).collect()}
    pairs = rows.where("fwd_return is not null").toPandas()
    assert told["a"]["corr"] == pytest.approx(np.corrcoef(pairs.a, pairs.fwd_return)[0, 1], rel=1e-12) and told["a"]["n_pairs"] == 800 and told["a"]["suspicious"]
    assert [(told[n]["n_pairs"], told[n]["corr"], told[n]["suspicious"]) for n in "bc"] == [(800, None, False), (0, None, False)] and not told["d"]["suspicious"]
    assert [x["n_pairs"] for x in statistics.leakage_check(rows.limit(0), names).collect()] == [0] * 4


def test_rounded_rows_are_read_as_the_same_doubles(spark, tmp_path, monkeypatch):
    """Whole millionths where they are exact, else the double itself; the rows can be deleted."""
    monkeypatch.setattr("tickerloom.session.shared_folder", lambda spark: str(tmp_path))
    r = np.random.default_rng(3)
    values = [None, float("nan"), float("inf"), -1e300, 0.0, 1e9, 999999999.999999, 123456789.1234565, 2.5e-7, -7.0000005, *np.round(r.normal(size=500) * 10.0 ** r.integers(-5, 9, 500), 7).tolist()]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    read = stored_rounded(df, ["x"], f"{tmp_path}/rows")
    assert read.columns == ["i", "x"]
    both = df.select("i", F.round("x", 6).alias("want")).join(read, "i")
    assert both.where("NOT (want <=> x)").isEmpty() and both.count() == len(values)
    removed(spark, f"{tmp_path}/rows")
    assert list(tmp_path.iterdir()) == []


def test_backfilled_runs_meet_a_file_in_blocks(spark, monkeypatch):
    """Blocks are bounded and hold every run, a null one too."""
    monkeypatch.setattr(tracking, "RUN_BLOCK", 4)
    batch = pa.RecordBatch.from_pydict({"run_id": pa.array([None, *range(9)], pa.int64())})
    made = [b.column("runs").to_pylist() for b in tracking._blocks(iter([batch, batch.slice(0, 0)]))]
    assert made == [[[None, 0, 1, 2], [3, 4, 5, 6], [7, 8]], []]
    runs = spark.range(100).select(F.when(F.col("id") > 0, F.col("id")).alias("run_id"), F.lit("completed").alias("status"))
    listing = spark.range(10).select(F.concat(F.lit("f"), "id").alias("name"), F.col("id").alias("size_bytes"), F.lit("t").alias("content_type"), F.lit("o").alias("artifact_type"))
    rows = tracking.backfill_artifacts(runs, spark.createDataFrame([(7,)], "run_id long"), listing).collect()
    assert len(rows) == len(set(rows)) == 99 * 10 and sum(r["run_id"] is None for r in rows) == 10
