"""Overview figures and the sentences built from finished metrics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart.functions.scalars import rounded

SOURCE = "spark"

METRIC_SCHEMA = "model string, series_id string, metric string, value double"


def kpis(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """One row: customers, active customers, orders, revenue. Two one-row aggregates, no join."""
    people = customers.agg(
        F.struct(F.count("*").alias("total"), F.count_if("is_active").alias("active")).alias("c")
    ).scalar()
    return orders.agg(
        F.count("*").alias("total_orders"), rounded(F.sum("order_amount"), 2).alias("total_revenue")
    ).select(
        people["total"].alias("total_customers"),
        people["active"].alias("active_customers"),
        "total_orders",
        "total_revenue",
    )


def metric_rows(spark: SparkSession, model: str, values: Mapping[str, float | None]) -> DataFrame:
    """Metrics of one model as rows."""
    rows = [(model, None, name, None if v is None else float(v)) for name, v in values.items()]
    return spark.createDataFrame(rows, METRIC_SCHEMA)


def series_metric_rows(models: DataFrame, model: str) -> DataFrame:
    """MAE and RMSE of every fitted series as rows."""
    return models.select(
        F.lit(model).alias("model"),
        "series_id",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), rounded(m, 2).alias("value"))
                    for m in ("mae", "rmse")
                ]
            )
        ),
    )


def _insight(text: Column) -> list[Column]:
    return [
        F.lit(SOURCE).alias("source"),
        text.alias("ai_insight"),
        F.lit("template").alias("ai_insight_generated_by"),
    ]


def forecast_insights(models: DataFrame, model: str, horizon: int) -> DataFrame:
    """One sentence per series from its hold-out errors."""
    text = F.format_string(
        f"Forecast of the next {horizon} days for %s; on the last 14 days held out MAE was %s and RMSE %s.",
        F.col("series_id"),
        F.format_number("mae", 0),
        F.format_number("rmse", 0),
    )
    return models.select(F.lit(model).alias("model"), "series_id", *_insight(text))


def churn_insight(scored: DataFrame, auc: float | None) -> DataFrame:
    quality = "not available" if auc is None else f"{auc:.2f}"
    return scored.agg(
        F.count("*").alias("customers"), F.count_if(F.col("churn_probability") >= 0.6).alias("high_risk")
    ).select(
        F.lit("churn_model").alias("model"),
        "customers",
        "high_risk",
        *_insight(
            F.format_string(
                f"Logistic regression (AUC {quality}) puts %d of %d customers at high risk.", "high_risk", "customers"
            )
        ),
    )


def segment_insight(summary: DataFrame, silhouette: float | None) -> DataFrame:
    """One sentence over the cluster summary, which has one row per cluster."""
    quality = "not available" if silhouette is None else f"{silhouette:.2f}"
    sizes = F.transform(
        F.sort_array(F.collect_list(F.struct("avg_monetary_90d", "label", "size")), asc=False),
        lambda s: F.format_string("%s (%d)", s["label"], s["size"]),
    )
    return summary.agg(sizes.alias("parts")).select(
        F.lit("customer_segments_model").alias("model"),
        *_insight(
            F.concat(
                F.lit(f"K-means segments (squared silhouette {quality}) by falling spend: "),
                F.array_join("parts", ", "),
                F.lit("."),
            )
        ),
    )


def anomaly_insight(detected: DataFrame, contamination: float) -> DataFrame:
    return detected.agg(F.count_if("is_anomaly").alias("flagged")).select(
        F.lit("order_anomaly_model").alias("model"),
        "flagged",
        *_insight(
            F.format_string(f"%d orders flagged at an expected rate of {contamination * 100:.1f}%%.", "flagged")
        ),
    )


def summaries(kpi_row: DataFrame, auc: float | None, silhouette: float | None, contamination: float) -> DataFrame:
    """Five rows ``(key, label, headline, detail)``, one per use case."""
    number = lambda v: "n/a" if v is None else f"{v:.2f}"
    use_cases = [
        ("sales-forecast", "Sales forecast", F.format_number("total_revenue", 0), "Revenue to date, forecast per channel"),
        ("churn", "Churn", F.lit(f"AUC {number(auc)}"), "Churn probability by logistic regression"),
        ("segmentation", "Segments", F.lit("4 clusters"), f"K-means, squared silhouette {number(silhouette)}"),
        ("anomaly", "Anomalies", F.lit(f"{contamination * 100:.1f}%"), "Order anomalies by isolation forest"),
        ("demand-forecast", "Demand forecast", F.lit("Top 20 products"), "Forecast per product"),
    ]
    entries = [
        F.struct(F.lit(k).alias("key"), F.lit(l).alias("label"), h.alias("headline"), F.lit(d).alias("detail"))
        for k, l, h, d in use_cases
    ]
    return kpi_row.select(F.inline(F.array(*entries)))
