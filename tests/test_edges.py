"""Cases at the edges: streamed index batches, bad dates, missing order dates, partial loads, sampling sizes."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemart.models import anomaly
from tidemart.operators.pit import previous_day_gap
from tidemart.search import bm25
from tidemart.sources import jdbc
from tidemart.sources.documents import parse_documents


def test_a_streamed_batch_keeps_what_is_indexed(spark, tmp_path):
    schema = "doc_id string, source string, content string"
    index = bm25.SearchIndex(spark, str(tmp_path / "index"), attributes=("source",))
    index.refresh(spark.createDataFrame([("a", "s", "red apple"), ("b", "s", "green apple")], schema), 0)
    for checkpoint in ("one", "two"):  # a new checkpoint starts its batches at 0 again
        spark.createDataFrame([("z" + checkpoint, "s", "blue apple")], schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        index.refresh_stream(stream, str(tmp_path / checkpoint)).awaitTermination()
    assert {r.doc_id for r in index.search("apple").collect()} == {"a", "b", "zone", "ztwo"}


def test_bad_dates_in_documents_give_null(spark):
    rows = [("x.md", f"---\ntitle: T\ncategory: C\nupdated_at: {d}\n---\nbody") for d in ("2024-02-03", "", "soon")]
    got = [r.updated_at for r in parse_documents(spark.createDataFrame(rows, "file_name string, value string")).collect()]
    assert got == [dt.date(2024, 2, 3), None, None]


def test_rows_without_a_day_have_no_gap(spark):
    rows = [(1, None, 1), (1, None, 2), (1, None, 3), (1, dt.date(2024, 1, 1), 4), (1, dt.date(2024, 1, 3), 5)]
    frame = spark.createDataFrame(rows, "customer_id int, order_date date, order_id int")
    got = {r.order_id: r.hours_since_last_order for r in previous_day_gap(frame).collect()}
    assert got == {1: None, 2: None, 3: None, 4: None, 5: 48}


def test_a_load_that_would_empty_other_tables_is_refused():
    with pytest.raises(ValueError, match="empties"):
        jdbc.load_tables({"customers": None}, None)


@pytest.mark.parametrize("n", [500, 200_000])
def test_samples_are_drawn_alike_at_every_size(spark, n):
    drawn = anomaly.draw_samples(spark.range(n).withColumnRenamed("id", "k"), "k", n, trees=20, sample=64)
    sizes = [r["count"] for r in drawn.groupBy("tree_id").count().collect()]
    assert len(sizes) == 20 and max(sizes) <= 64 and min(sizes) >= 40
    assert drawn.groupBy("tree_id", "k").count().where(F.col("count") > 1).isEmpty()
