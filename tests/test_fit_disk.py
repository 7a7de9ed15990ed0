from __future__ import annotations

from pyspark.sql import functions as F

from tests.conftest import AS_OF
from tests.test_sources import small  # noqa: F401
from tests.test_store_disk import shuffle_bytes
from tidemart import session
from tidemart.models import churn
from tidemart.plans import marts


def test_materialise_in_slices_frees_shuffles(small, spark, tmp_path, monkeypatch):  # noqa: F811
    assert session.input_bytes(spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "a int")) == 0  # not known
    small["order_items"].write.parquet(str(tmp_path / "items"))
    items = spark.read.parquet(str(tmp_path / "items"))
    items = items.unionByName(items).distinct()
    before = shuffle_bytes(spark)
    whole = session.materialise(items, "whole", by="order_id")
    assert len(session.slices(items, "order_id", 3)) == 3
    monkeypatch.setattr(session, "SLICE_BYTES", 1 + session.input_bytes(items) // 3)
    parts = session.materialise(items, "parts", by="order_id")
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect())) == sorted(map(str, items.collect()))
    assert len(parts.inputFiles()) > len(whole.inputFiles())
    assert shuffle_bytes(spark) <= before + 100_000  # those of the collects alone


def test_fit_reads_narrow_rows_that_go_afterwards(spark, tmp_path, monkeypatch):
    """A cached frame held ids and dates, and its shuffle files lay beside the regression's blocks."""
    n = F.col("id")
    people = spark.range(400).select(
        n.cast("string").alias("customer_id"), F.lit(AS_OF).alias("snapshot_date"), (n % 90).alias("recency_days"), (n % 5).alias("frequency_90d"),
        (n % 7 * 10).alias("monetary_90d"), F.lit(2.5).alias("avg_order_value"), (n + 30).alias("tenure_days"),
        F.concat(F.lit("p"), n % 3).alias("plan_type"), F.concat(F.lit("r"), n % 2).alias("region"), (n % 11 == 0).alias("churned_next_30d"),
    ).repartition(4, "customer_id")
    monkeypatch.setattr("tidemart.session.scratch_dir", lambda spark, purpose: str(tmp_path / purpose))
    seen, fit, before = [], churn._fit, shuffle_bytes(spark)

    def spied(rows):
        seen.append((rows.columns, shuffle_bytes(spark) <= before, spark.conf.get("spark.sql.files.maxPartitionBytes")))
        return fit(rows)

    monkeypatch.setattr(churn, "_fit", spied)
    model = churn.fit(people)
    assert seen == [([*churn.NUMERIC, *churn.CATEGORICAL, "label"], True, str(churn.ROW_BYTES))]
    assert not (tmp_path / "training-rows").exists() and spark.conf.get("spark.sql.files.maxPartitionBytes") != str(churn.ROW_BYTES)
    cached = fit(churn.training_rows(people).persist())
    assert max(abs(a - b) for a, b in zip(model.pipeline.stages[-1].coefficients, cached.stages[-1].coefficients)) < 1e-8
    assert marts.model_ready_customers(people).count() == churn.score(model, people).count()
