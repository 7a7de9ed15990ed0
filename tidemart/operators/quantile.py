"""Exact order statistics without sorting and without one task that sees every value.

A sketch of each group brackets every wanted rank; a second pass counts the rows below the bracket and those at each
value within it. The bracket holds a share of about ``4 * MARGIN`` of the rows, so what is ordered stays small, and two
scans are all there is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemart.functions.scalars import col

#: Accuracy of the sketch, and the distance of the bracket from a rank: several times the sketch's largest error.
ACCURACY = 10_000
MARGIN = 4 / ACCURACY


def _bracket(p: float) -> Column:
    """Values below and above the ranks next to the share ``p`` of a group's values."""
    low = F.min("_v") if p <= MARGIN else F.percentile_approx("_v", F.lit(p - MARGIN), F.lit(ACCURACY))
    high = F.max("_v") if p >= 1 - MARGIN else F.percentile_approx("_v", F.lit(p + MARGIN), F.lit(ACCURACY))
    # In a small group the next rank may lie further away than the margin.
    few = F.count(F.lit(1)) * MARGIN < 2
    return F.struct(
        F.lit(p).alias("p"), F.when(few, F.min("_v")).otherwise(low).alias("lo"), F.when(few, F.max("_v")).otherwise(high).alias("hi")
    )


def exact_quantiles(df: DataFrame, value: str | Column, probs: list[float], scale: int, by: list[str]) -> DataFrame:
    """Linearly interpolated quantiles per group, as ``(*by, prob, quantile)``.

    ``value * scale`` is rounded to a whole number, so ``scale`` states the precision of the result. NULL values
    are left out.
    """
    groups = [f"_g{i}" for i in range(len(by))]
    scaled = F.round(col(value) * F.lit(scale)).cast("bigint")
    vals = df.select(*[F.col(c).alias(g) for c, g in zip(by, groups)], scaled.alias("_v")).where(F.col("_v").isNotNull())
    brackets = vals.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("_n"), F.array(*[_bracket(float(p)) for p in dict.fromkeys(probs)]).alias("_b")
    )
    if by:  # one small row per group
        named = brackets.toDF(*[f"{g}_of" for g in groups], "_n", "_b")
        joined = vals.join(named, reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"{g}_of")) for g in groups]))
    else:  # one row in all
        joined = vals.crossJoin(F.broadcast(brackets))
    near = (
        joined.select(*groups, "_n", "_v", F.explode("_b").alias("_b"))
        .where(F.col("_v") <= F.col("_b.hi"))
        .select(*groups, "_n", F.col("_b.p").alias("_p"), F.when(F.col("_v") >= F.col("_b.lo"), F.col("_v")).alias("_at"))
    )
    # NULL stands for all rows below the bracket.
    counts = near.groupBy(*groups, "_n", "_p", "_at").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*groups, "_p").orderBy(F.asc_nulls_first("_at")))
    pos = F.col("_p") * (F.col("_n") - 1)
    holds = lambda rank: (F.col("_end") - F.col("_c") <= rank) & (rank < F.col("_end"))
    placed = counts.withColumn("_end", upto).where(holds(F.floor(pos)) | holds(F.ceil(pos)))
    low, high = F.min("_at"), F.max("_at")
    share = F.first(pos - F.floor(pos))
    return placed.groupBy(*groups, "_p").agg(((low + (high - low) * share) / F.lit(float(scale))).alias("quantile")).select(
        *[F.col(g).alias(c) for c, g in zip(by, groups)], F.col("_p").alias("prob"), "quantile"
    )


def top_fraction_cut(df: DataFrame, score: str | Column, fraction: float, scale: int) -> Column:
    """Scalar subquery: the score that the top ``fraction`` of rows exceeds."""
    return exact_quantiles(df, score, [1.0 - fraction], scale, []).select("quantile").scalar()
