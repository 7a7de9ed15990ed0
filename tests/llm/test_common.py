from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from tidemart.llm import common
from tidemart.llm.components import components


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = [d.getPath() for d in manager.localDirs()]
    return sum(f.startswith("shuffle_") for top in folders for _, _, files in os.walk(top) for f in files)


def left_beyond(spark, before):
    """Whether more shuffle files than before stay; they are deleted in the background."""
    until = time.time() + 5
    while shuffle_files(spark) > before and time.time() < until:
        time.sleep(0.1)
    return shuffle_files(spark) > before


@pytest.mark.parametrize("keep", [common.checkpointed, lambda df: common.stored(df, "kept")])
def test_kept_frames_leave_no_shuffle_files(spark, keep):
    before = shuffle_files(spark)
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    kept = keep(counted.join(spark.range(50).hint("merge"), F.col("k") == F.col("id")).groupBy("count").agg(F.sum("k")))
    assert not left_beyond(spark, before)
    assert kept.count() == 2
    assert spark.conf.get(common._FREE_SHUFFLES, "false") == "false"


def test_components_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    roots = components(edges)
    assert not left_beyond(spark, before)
    assert [tuple(r) for r in roots.groupBy("root").count().collect()] == [(0, 201)]
