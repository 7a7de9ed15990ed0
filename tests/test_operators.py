from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import day
from tidemart.functions import scalars as fn
from tidemart.operators import series
from tidemart.operators.quantile import exact_quantiles, top_fraction_cut
from tidemart.operators.splits import stratified_split


def test_exact_quantiles_on_skewed_values(spark):
    rng = np.random.default_rng(1)
    values = np.round(np.concatenate([np.full(400, 7.25), rng.lognormal(6, 2, 800)]), 2)
    df = spark.createDataFrame(pd.DataFrame({"g": np.arange(1200) % 2, "v": values})).withColumn("v", F.col("v"))
    got = {(r.g, r.prob): r.quantile for r in exact_quantiles(df, "v", [0.0, 0.3, 0.5, 0.95, 1.0], 100, ["g"]).collect()}
    for (g, p), q in got.items():
        assert q == pytest.approx(np.quantile(values[np.arange(1200) % 2 == g], p), abs=1e-9)
    assert len(got) == 10
    cut = top_fraction_cut(df, "v", 0.015, 100)
    assert df.where(F.col("v") > cut).count() == 18


def test_quantiles_of_large_small_and_null_groups(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.expr("(id * 7919) % 60013 - 30000").alias("v"))
    rows = rows.union(spark.createDataFrame([(7, 5), (7, -3), (8, 4), (9, None)], "g long, v long"))
    got = {(r.g, r.prob): r.quantile for r in exact_quantiles(rows, "v", [0.001, 0.5, 0.985, 0.5], 10, ["g"]).collect()}
    pdf = rows.toPandas()
    assert len(got) == 15
    for (g, p), q in got.items():
        mine = pdf[pdf.g.isna() if g is None else pdf.g == g].v
        assert q == pytest.approx(np.quantile(mine, p), abs=1e-9), (g, p)
    assert exact_quantiles(rows.limit(0), "v", [0.5], 1, []).isEmpty()


def test_a_quantile_scans_its_input_twice(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    frame = spark.read.parquet(str(tmp_path / "t"))
    plan = exact_quantiles(frame, "id", [0.5], 1, [])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2


def test_split_is_exact_and_stable(spark):
    df = spark.range(10_000).select(F.col("id").alias("k"), (F.col("id") % 100 == 0).alias("label"))
    one = stratified_split(df, "label", ["k"], 0.25, 42)
    assert {r.label: r.n for r in one.where("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()} == {True: 25, False: 2475}
    again = stratified_split(df.repartition(7), "label", ["k"], 0.25, 42)
    assert one.where("is_test").exceptAll(again.where("is_test")).isEmpty()


def test_gap_fill_history_tail_and_holdout(spark):
    rows = [("a", day(-4), 1.0), ("a", day(-1), 2.0), ("b", day(0), 5.0)]
    filled = series.gap_fill(spark.createDataFrame(rows, "series_id string, ds date, y double"))
    got = sorted((r.series_id, r.ds, r.y) for r in filled.collect())
    assert got == [("a", day(-4), 1.0), ("a", day(-3), 0.0), ("a", day(-2), 0.0), ("a", day(-1), 2.0), ("b", day(0), 5.0)]
    assert {r.series_id for r in series.with_min_history(filled, 4).collect()} == {"a"}
    assert sorted(r.ds for r in series.tail(filled, 2).where("series_id = 'a'").collect()) == [day(-2), day(-1)]
    assert sorted(r.ds for r in series.with_holdout(filled, 1).where("is_test").collect()) == [day(-1), day(0)]


def test_scalar_edges(spark):
    df = spark.createDataFrame([(0.59, 4, 0), (0.6, 4, 2), (0.3, 4, 4), (float("nan"), 4, 1)], "p double, a int, b int")
    rows = df.select(
        fn.risk_tier("p").alias("tier"), fn.safe_divide("a", "b").alias("q"), fn.nan_to_null("p").alias("n"),
        fn.clip_at_zero(F.col("p") - 0.5).alias("c"), fn.lookup({"x": 1.0}, F.lit("y")).alias("m"),
    ).collect()
    assert [r.tier for r in rows[:3]] == ["medium", "high", "medium"]
    assert rows[0].q is None and rows[1].q == 2 and rows[3].n is None and rows[2].c == 0.0 and rows[0].m is None
    dates = spark.range(1).select(fn.date_range(F.lit(day(0)), F.lit(day(-1))).alias("none"), F.size(fn.date_range(day(-60), day(0), 30)).alias("n"))
    assert dates.first().none == [] and dates.first().n == 3
