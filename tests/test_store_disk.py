from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tests.conftest import AS_OF
from tests.test_sources import small  # noqa: F401
from tidemart.plans.layers import clustered
from tidemart.plans.steps import STEPS
from tidemart.plans.store import LayerStore


def shuffle_bytes(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))


def test_a_refresh_leaves_no_shuffle_files(small, spark, tmp_path):  # noqa: F811
    store = LayerStore(spark, str(tmp_path))
    store.load_raw(small)
    before = shuffle_bytes(spark)
    store.refresh(AS_OF)
    assert shuffle_bytes(spark) <= before + 1000  # one-row jobs that choose dates keep some hundred bytes


def test_sorted_once_and_compressed(small, spark, tmp_path):  # noqa: F811
    plan = clustered(small["orders"], "order_date", ["customer_id"])._jdf.queryExecution().optimizedPlan()
    order = plan.outputOrdering()
    assert [order.apply(i).child().sql() for i in range(order.size())] == ["part_month", "order_date", "customer_id"]
    store = LayerStore(spark, str(tmp_path))
    store.load_raw(small)
    store.refresh(AS_OF, ["dwh.fact_orders"])
    files = [f.name for f in tmp_path.rglob("versions/**/*.parquet")]
    assert files and all(".zstd." in f for f in files)


def test_slices_together_are_the_whole_table(small, spark, tmp_path, monkeypatch):  # noqa: F811
    """Copies, rows without keys and versions of a key come out as from one pass."""
    orders = small["orders"]
    doubled = small | {"orders": orders.unionByName(orders).unionByName(orders.selectExpr("CAST(NULL AS STRING) order_id", *orders.columns[1:]))}
    tables = []
    for part in (None, 900):
        if part:
            for name, step in STEPS.items():
                monkeypatch.setitem(STEPS, name, replace(step, slice_bytes=part))
        store = LayerStore(spark, str(tmp_path / str(part)))
        store.load_raw(doubled)
        written = []
        write = LayerStore._write
        monkeypatch.setattr(LayerStore, "_write", lambda self, df, name, run, by=None, slices=1: written.append(slices) or write(self, df, name, run, by, slices))
        done = store.refresh(AS_OF)
        monkeypatch.setattr(LayerStore, "_write", write)
        assert (max(written) > 2) == bool(part)
        tables.append({n: sorted(map(str, done.table(n).collect())) for n in done.names})
    assert tables[0] == tables[1] and all(tables[0][n] for n in ("staging.orders", "mart.customer_features", "dwh.fact_order_items"))


def test_slices_are_cut_before_the_exchanges(small, spark, tmp_path):  # noqa: F811
    store = LayerStore(spark, str(tmp_path))
    store.load_raw(small)
    done = store.refresh(AS_OF)
    for name, step in STEPS.items():
        if step.sliced_by:
            frame = step.frame(AS_OF, *[done.table(i) for i in step.inputs])
            part = frame.where(F.pmod(F.xxhash64(step.sliced_by), F.lit(5)) == 2)
            plan = part._jdf.queryExecution().optimizedPlan().toString().splitlines()
            assert all("xxhash64" in above for above, line in zip(plan, plan[1:]) if " Relation [" in line), name
