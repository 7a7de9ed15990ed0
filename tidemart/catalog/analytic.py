"""Registered queries that train or apply models, stream, or search."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart.catalog.relational import d
from tidemart.functions import scalars as fn
from tidemart.models import anomaly, churn, forecast, registry, segments
from tidemart.operators import series
from tidemart.operators.quantile import top_fraction_cut
from tidemart.plans import marts, overview, quality, semantic
from tidemart.plans.layers import Warehouse
from tidemart.search import bm25
from tidemart.session import materialise, scratch_dir, tune
from tidemart.sources.driver_tables import read_table

QUERIES = {}

NONE: frozenset[str] = frozenset()
ITEMS = frozenset({"item_count"})


def query(lookups: frozenset[str] = NONE):
    """Register ``f(warehouse)`` under its own name."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Warehouse.open(tune(spark), sf_dir, lookups))
        return f

    return register


def source_query(f):
    """Register ``f(spark, sf_dir)`` under its own name."""
    QUERIES[f.__name__] = lambda spark, sf_dir: f(tune(spark), sf_dir)
    return f


# --- documents


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("content"))


@source_query
def q10_document_search(spark, sf_dir):
    hits = bm25.search(_corpus(spark, sf_dir), "in from ertion", attributes={"source": "src1"})
    return hits.select("doc_id", "score")


@source_query
def q10_document_search_all(spark, sf_dir):
    return bm25.search(_corpus(spark, sf_dir), "Für, anre; hation del")


def _streamed_index(spark: SparkSession, sf_dir: str) -> bm25.SearchIndex:
    """Documents arrive as files, a third of them with outdated texts, and once more with their texts of today."""
    docs = _corpus(spark, sf_dir)
    changed = F.pmod("doc_id", F.lit(3)) == 0
    old = docs.withColumn("content", F.when(changed, F.lit("in from ertion in")).otherwise(F.col("content")))
    arriving, checkpoint = scratch_dir(spark, "arriving"), scratch_dir(spark, "stream")
    index = bm25.SearchIndex(spark, scratch_dir(spark, "index"), attributes=("source",))
    for batch in (old, docs.where(changed)):
        batch.write.mode("append").parquet(arriving)
        index.refresh_stream(spark.readStream.schema(docs.schema).parquet(arriving), checkpoint).awaitTermination()
    return index


@source_query
def q11_search_index_refresh(spark, sf_dir):
    """An index kept by a stream, merged, then searched."""
    index = _streamed_index(spark, sf_dir)
    index.compact()
    return index.search("in from ertion", attributes={"source": "src1"}).select("doc_id", "score")


@source_query
def q11_search_index_deletes(spark, sf_dir):
    """A fifth of the documents is deleted from the index."""
    index = _streamed_index(spark, sf_dir)
    gone = _corpus(spark, sf_dir).where(F.pmod("doc_id", F.lit(5)) == 0)
    index.refresh(gone.limit(0), deleted=gone.select("doc_id"))
    return index.search("in from ertion").select("doc_id", "score")


@source_query
def q16_qc_corpus(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    renamed = docs.select("doc_id", F.col("lang").alias("category"), F.col("text").alias("content"))
    return quality.corpus_checks(renamed, ["en", "de"])


# --- forecasts


def _sales(w) -> DataFrame:
    return forecast.as_series(w.daily_sales, "channel", "order_date", "total_amount")


def _demand_series(daily: DataFrame) -> DataFrame:
    return forecast.as_series(daily, "product_id", "order_date", "quantity_sold")


def _demand(w) -> DataFrame:
    return _demand_series(w.daily_product_demand)


@query()
def ts7_holt_winters_fit(w):
    return forecast.fit(_sales(w)).select(
        "series_id", "alpha", "beta", "gamma", "level", "trend", "resid_std", "n_points", "last_ds"
    )


@query()
def ts8_holdout_evaluate(w):
    return forecast.fit(_sales(w)).select("series_id", *forecast.metric_columns())


@query()
def ts9_sales_forecast(w):
    horizon = forecast.check_horizon(forecast.SALES_HORIZON, forecast.SALES_HORIZON_MAX)
    return forecast.forecast(forecast.fit(_sales(w)), horizon)


@query()
def ts9_demand_forecast(w):
    """Forecasts of the top products with their names."""
    points = forecast.forecast(forecast.fit(_demand(w)), forecast.DEMAND_HORIZON)
    names = w.staged("products").select(F.col("product_id").alias("series_id"), "name")
    return points.join(names, "series_id", "left").withColumn("name", F.coalesce("name", "series_id"))


@query()
def ts10_warehouse_forecast(w):
    """Forecast of all channels at another horizon and interval."""
    return forecast.forecast(forecast.fit(_sales(w)), horizon=60, level=0.95)


@query()
def ts11_holiday_forecast(w):
    """Channels fitted with year-end days as holidays; facts of each forecast of 60 days."""
    sales = _sales(w)
    span = sales.agg(F.min("ds").alias("a"), F.date_add(F.max("ds"), 60).alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("date"))
    names = F.when(F.date_format("date", "MM-dd") == "12-25", "christmas").when(F.dayofmonth("date") == 15, "mid month")
    holidays = days.select("date", names.alias("holiday")).where("holiday IS NOT NULL")
    models = forecast.fit(sales, holidays)
    ahead = forecast.forecast(models, 60, holidays=holidays).join(models.select("series_id", "holidays"), "series_id")
    ordered = (F.col("p10") <= F.col("value")) & (F.col("value") <= F.col("p90")) & (F.col("p10") >= 0)
    return ahead.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.min("ds").alias("first_ds"),
        F.max("ds").alias("last_ds"),
        F.array_join(F.first("holidays"), ",").alias("holidays"),
        F.bool_and(ordered).alias("ordered"),
    )


@query()
def p14_series_lookup_guard(w):
    """Without a key the first series is taken."""
    sales = _sales(w)
    return forecast.select_series(sales, sales.select("series_id"), None).select("series_id", "ds", d("y"))


@query()
def u3_history_plus_forecast(w):
    sales = _sales(w)
    return forecast.chart_rows(sales, forecast.fit(sales), forecast.SALES_HORIZON)


@query()
def a15_forecast_error(w):
    """Errors of the value one week before as a forecast."""
    actual = series.gap_fill(
        w.daily_sales.select(F.col("channel").alias("series_id"), F.col("order_date").alias("ds"), F.col("total_amount").alias("y"))
    )
    naive = actual.select("series_id", F.date_add("ds", 7).alias("ds"), F.col("y").alias("value"))
    return forecast.errors(naive, actual)


@query()
def a16_residual_std(w):
    return _sales(w).groupBy("series_id").agg(fn.rounded(F.stddev_pop("y"), 4).alias("resid_std"))


# --- churn


@query()
def m1_scale(w):
    """Scaled numbers of the newest snapshot: mean and spread per feature."""
    return segments.scaled_moments(segments.train(w.latest_features), w.latest_features)


@query()
def m2_one_hot(w):
    """One-hot categories; plans unseen in fitting become all zeros."""
    seen = w.latest_features.where(F.col("plan_type") != "BUILDING")
    return churn.category_ones(seen, w.latest_features).groupBy("plan_type").agg(F.max("ones").alias("ones"))


@query()
def m3_churn_fit(w):
    return churn.coefficients(churn.fit(w.customer_features), w.latest_features)


@query()
def m4_auc(w):
    """Hold-out AUC. Churn in the driver tables is derived from order gaps, so it proves no skill."""
    auc = churn.evaluate(w.customer_features)
    return overview.metric_rows(w.fact_orders.sparkSession, "churn_model", {"auc": auc and round(auc, 4)})


def _scored(w) -> DataFrame:
    return churn.score(churn.fit(w.customer_features), w.latest_features)


@query()
def m5_churn_score(w):
    return _scored(w).select("customer_id", "snapshot_date", "churn_probability")


@query()
def a17_high_risk_count(w):
    return _scored(w).agg(F.count_if(F.col("churn_probability") >= fn.RISK_TIERS["high"]).alias("high_risk"))


@query()
def t2_top_risk_customers(w):
    return churn.top_risk(_scored(w), limit=50)


@query()
def p12_min_risk_filter(w):
    return churn.at_risk(_scored(w), min_risk=0.3)


@query()
def m12_model_persistence(w):
    """Save the fitted model, load it by path, score with the loaded one."""
    path = scratch_dir(w.fact_orders.sparkSession, "churn-model")
    churn.save(churn.fit(w.customer_features), path)
    return churn.score(churn.load(path), w.latest_features).select("customer_id", "churn_probability")


@query(ITEMS)
def m12_model_registry(w):
    """All five models saved twice and loaded by name: rows scored, and how many scores differ from the model's own."""
    spark = w.fact_orders.sparkSession
    models = registry.ModelRegistry(spark, scratch_dir(spark, "models"))
    # The items' exchanges are the largest by far; order features and demand read what comes out of them.
    items = w.fact_order_items.select("order_id", "order_date", "product_id", "quantity", "unit_price", "discount_pct")
    items = materialise(items, "items", by="order_id")
    orders = materialise(marts.order_transaction_features(w.fact_orders, items), "orders")
    latest = materialise(w.latest_features, "latest")
    ahead = lambda horizon: lambda m: forecast.forecast(m, horizon).select(F.concat_ws("|", "series_id", "ds").alias("k"), "value")
    cases = {
        "churn_model": ("churn", churn.fit(w.customer_features), lambda m: churn.score(m, latest).select("customer_id", "churn_probability")),
        "customer_segments_model": ("segments", segments.train(latest), lambda m: segments.assign(m, latest).select("customer_id", "cluster_id")),
        "anomaly_model": (
            "forest",
            materialise(anomaly.grow_forest(orders), "forest"),
            lambda m: anomaly.isolation_scores(orders, m).select("order_id", "isolation"),
        ),
        "sales_forecast_model": ("forecast", materialise(forecast.fit(_sales(w)), "sales"), ahead(forecast.SALES_HORIZON)),
        "demand_forecast_model": ("forecast", materialise(forecast.fit(_demand_series(marts.daily_product_demand(items))), "demand"), ahead(forecast.DEMAND_HORIZON)),
    }
    rows = []
    for name, (kind, model, scores) in cases.items():
        for _ in range(2):
            version = models.save(name, kind, model)
        own, loaded = (scores(m).toDF("k", "v") for m in (model, models.load(name)))
        both = own.join(loaded.toDF("k", "w"), "k", "full")
        differ = F.count_if(~F.col("v").eqNullSafe(F.col("w")))
        rows.append(both.agg(F.count(F.lit(1)).alias("n_rows"), differ.alias("n_different")).select(F.lit(name).alias("model"), F.lit(version).cast("bigint").alias("version"), "n_rows", "n_different"))
    return quality.union_all(rows)


# --- segments


@query()
def m6_kmeans(w):
    model = segments.train(w.latest_features)
    return segments.assign(model, w.latest_features).select("customer_id", "cluster_id")


@query()
def m7_silhouette(w):
    """Silhouette on squared Euclidean distances of the scaled features."""
    model = segments.train(w.latest_features)
    return overview.metric_rows(
        w.fact_orders.sparkSession,
        "customer_segments_model",
        {"silhouette_squared": model.silhouette_sq and round(model.silhouette_sq, 4)},
    )


@query()
def m13_latest_snapshot_predict(w):
    """Cluster members as reported: id, cluster, and the three shown features."""
    model = segments.train(w.latest_features)
    assigned = segments.assign(model, w.latest_features)
    return assigned.select("customer_id", "cluster_id", d("recency_days", 1), d("frequency_90d", 1), d("monetary_90d", 1))


@query()
def a13_cluster_centers(w):
    return segments.centers(segments.assign(segments.train(w.latest_features), w.latest_features))


@query()
def a14_cluster_summary(w):
    return segments.summary(segments.assign(segments.train(w.latest_features), w.latest_features))


@query()
def w2_rank_labels(w):
    """Labels by falling mean spend; the plans stand in for clusters."""
    groups = segments.model_ready_customers(w.latest_features).withColumn("cluster_id", F.col("plan_type"))
    return segments.with_rank_labels(segments.centers(groups)).select("cluster_id", "size", "label")


# --- anomalies


@query(ITEMS)
def m8_isolation_forest(w):
    rows = materialise(w.order_features, "order-features")
    return anomaly.isolation_scores(rows, anomaly.grow_forest(rows)).select("order_id", "isolation")


@query(ITEMS)
def m9_contamination_threshold(w):
    return anomaly.detect_isolation(w.order_features).select("order_id", "score", "is_anomaly")


@query(ITEMS)
def m10_reconstruction_anomaly(w):
    return anomaly.detect_reconstruction(w.order_features).select("order_id", "score", "is_anomaly")


@query(ITEMS)
def t3_top_anomalies(w):
    return anomaly.top_anomalies(anomaly.detect_isolation(w.order_features), limit=100, window_days=90)


@query(ITEMS)
def a22_flagged_count(w):
    top = anomaly.top_anomalies(anomaly.detect_isolation(w.order_features), limit=100)
    return top.agg(F.count_if("is_anomaly").alias("flagged"), F.count("*").alias("shown"))


@query(ITEMS)
def q8_anomaly_amount_total(w):
    return semantic.anomaly_amount_total(anomaly.detect_isolation(w.order_features)).select(d("anomaly_amount_total"))


@query(ITEMS)
def a18_detection_recall(w):
    """Recall of the amount cut on orders with many items."""
    cut = top_fraction_cut(w.fact_orders, "order_amount", anomaly.CONTAMINATION, 100)
    flagged = w.fact_orders.select(
        (F.col("order_amount").cast("double") > cut).alias("is_anomaly"), (F.col("item_count") >= 6).alias("truth")
    )
    return anomaly.recall(flagged, "truth")


# --- metrics, sentences, overview


@query()
def m11_evaluation_metrics(w):
    """Metrics of the churn model and of every sales series as rows."""
    auc = churn.evaluate(w.customer_features)
    rows = overview.metric_rows(w.fact_orders.sparkSession, "churn_model", {"auc": auc and round(auc, 4)})
    return rows.unionByName(overview.series_metric_rows(forecast.fit(_sales(w)), "sales_forecast_model"))


@query()
def m14_forecast_insights(w):
    return overview.forecast_insights(forecast.fit(_sales(w)), "sales_forecast_model", forecast.SALES_HORIZON)


@query()
def m14_churn_insight(w):
    model = churn.train(w.customer_features)
    return overview.churn_insight(churn.score(model, w.latest_features), model.auc)


@query()
def m14_segment_insight(w):
    model = segments.train(w.latest_features)
    return overview.segment_insight(segments.summary(segments.assign(model, w.latest_features)), model.silhouette_sq)


@query(ITEMS)
def m14_anomaly_insight(w):
    return overview.anomaly_insight(anomaly.detect_isolation(w.order_features), anomaly.CONTAMINATION)


@query()
def m15_overview_summaries(w):
    auc = churn.evaluate(w.customer_features)
    silhouette = segments.train(w.latest_features).silhouette_sq
    return overview.summaries(overview.kpis(w.dim_customer, w.fact_orders), auc, silhouette, anomaly.CONTAMINATION)
