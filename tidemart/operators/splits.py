"""Deterministic train/test splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# Leading hex digits of the hash that form a bucket: 65,536 buckets per label.
BUCKET_DIGITS = 4


def stratified_split(df: DataFrame, label: str, keys: list[str], test_share: float, seed: int) -> DataFrame:
    """Adds ``is_test``: exactly floor(test_share * n) rows of each label, chosen by hash order.

    The order is that of md5(keys, seed), so the split depends on neither partitioning nor
    retries. Ranking a whole label in one window would put all its rows into one task. A
    histogram of hash buckets decides all rows but those of the one bucket per label in which
    the cut falls, and only these are ranked.
    """
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    rows = df.withColumn("_h", digest).withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS))
    w = Window.partitionBy(label).orderBy("_b")
    total = F.sum("_c").over(Window.partitionBy(label))
    buckets = (
        rows.groupBy(label, "_b")
        .agg(F.count("*").alias("_c"))
        .withColumn("_end", F.sum("_c").over(w))
        .withColumn("_cut", F.floor(total * F.lit(test_share)))
        .withColumn("_start", F.col("_end") - F.col("_c"))
        .select(label, "_b", "_start", "_end", "_cut")
    )
    placed = rows.join(buckets, [label, "_b"])
    # Only the bucket with the cut is ranked as a group; elsewhere each row is its own group.
    split_bucket = (F.col("_start") < F.col("_cut")) & (F.col("_cut") < F.col("_end"))
    lane = F.when(split_bucket, F.lit("")).otherwise(F.col("_h"))
    rank = F.row_number().over(Window.partitionBy(label, "_b", "_lane").orderBy("_h"))
    return (
        placed.withColumn("_lane", lane)
        .withColumn("_rank", rank)
        .withColumn(
            "is_test",
            F.when(split_bucket, F.col("_start") + F.col("_rank") <= F.col("_cut")).otherwise(
                F.col("_end") <= F.col("_cut")
            ),
        )
        .select(*df.columns, "is_test")
    )
