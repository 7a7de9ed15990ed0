"""Daily series: gap filling, history limits, tails and hold-outs.

Input and output are long frames ``(series_id, ds, y)``, already summed to one row per series and
day, so that a series is never longer than the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemart.functions.scalars import date_range


def gap_fill(daily: DataFrame) -> DataFrame:
    """Every day between a series' own first and last day; missing days get 0.

    The next observed day of a row bounds the zeros that follow it, so rows are filled in place
    of a join against a calendar.
    """
    w = Window.partitionBy("series_id").orderBy("ds")
    until = F.coalesce(F.date_sub(F.lead("ds").over(w), 1), F.col("ds"))
    spans = daily.withColumn("_until", until).withColumn(
        "_day", F.explode(date_range(F.col("ds"), F.col("_until")))
    )
    return spans.select(
        "series_id",
        F.col("_day").alias("ds"),
        F.when(F.col("_day") == F.col("ds"), F.col("y").cast("double")).otherwise(F.lit(0.0)).alias("y"),
    )


def with_min_history(series: DataFrame, points: int) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("series_id"))
    return series.withColumn("_n", n).where(F.col("_n") >= points).drop("_n")


def _from_end():
    return F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("ds")))


def tail(series: DataFrame, points: int) -> DataFrame:
    """The last ``points`` rows of each series."""
    return series.withColumn("_r", _from_end()).where(F.col("_r") <= points).drop("_r")


def with_holdout(series: DataFrame, points: int) -> DataFrame:
    """Adds ``is_test`` for the last ``points`` rows of each series."""
    return series.withColumn("is_test", _from_end() <= points)


def quarter_means(daily: DataFrame, day: str, value: str) -> DataFrame:
    """Mean of the first and of the last quarter of a daily series: one row."""
    rank = F.row_number().over(Window.orderBy(day))  # one row per calendar day
    n = F.count("*").over(Window.partitionBy())
    quarter = F.floor(F.col("_n") / 4)
    return (
        daily.withColumn("_r", rank)
        .withColumn("_n", n)
        .agg(
            F.avg(F.when(F.col("_r") <= quarter, F.col(value))).alias("first_quarter_mean"),
            F.avg(F.when(F.col("_r") > F.col("_n") - quarter, F.col(value))).alias("last_quarter_mean"),
        )
    )
