"""Registered queries over the layers: sources, projections, joins, aggregates, windows, functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart.functions import scalars as fn
from tidemart.operators import pit, series
from tidemart.operators.quantile import exact_quantiles, top_fraction_cut
from tidemart.operators.splits import stratified_split
from tidemart.plans import dwh, marts, overview, quality, semantic, staging
from tidemart.plans.layers import Warehouse
from tidemart.schemas import RAW_COLUMNS
from tidemart.session import scratch_dir, tune
from tidemart.sources import landing
from tidemart.sources.driver_tables import SEGMENT_MRR, conform, raw_orders, read_table

QUERIES = {}

NONE: frozenset[str] = frozenset()
ORDER_REGION = frozenset({"order_region"})
ITEMS = frozenset({"item_count"})
LANDING_DATE = dt.date(2001, 8, 1)


def query(lookups: frozenset[str] = NONE):
    """Register ``f(warehouse)`` under its own name."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Warehouse.open(tune(spark), sf_dir, lookups))

        run.__name__ = f.__name__
        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        return f

    return register


def source_query(f):
    """Register ``f(spark, sf_dir)`` under its own name."""
    QUERIES[f.__name__] = lambda spark, sf_dir: f(tune(spark), sf_dir)
    return f


def d(name: str, digits: int = 2):
    """A decimal or double column as a rounded double."""
    return fn.rounded(name, digits).alias(name)


def big(name: str):
    return F.col(name).cast("bigint").alias(name)


def feature_columns():
    return [
        "customer_id",
        "snapshot_date",
        big("recency_days"),
        big("frequency_90d"),
        d("monetary_90d"),
        d("avg_order_value", 6),
        big("tenure_days"),
        "plan_type",
        "region",
    ]


def order_feature_columns():
    return [
        "order_id",
        "order_date",
        "customer_id",
        d("order_amount"),
        big("item_count"),
        d("discount_pct", 6),
        d("avg_unit_price", 6),
        big("hours_since_last_order"),
    ]


def order_columns():
    return [
        "order_id",
        "customer_id",
        "order_date",
        "channel",
        "region",
        d("order_amount"),
        big("item_count"),
        "status",
    ]


# --- sources and sinks


@source_query
def s1_parquet_scan(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("o_orderdate"), "o_totalprice"
    )


@source_query
def s4_landing_write(spark, sf_dir):
    """The same date is landed twice; the second write replaces the first."""
    root = scratch_dir(spark, "landing")
    orders = raw_orders(spark, sf_dir)
    for _ in range(2):
        landing.write_landing(orders, "orders", root, LANDING_DATE)
    landed = spark.read.parquet(f"{root}/orders")
    return landed.select(*order_columns(), F.col("run_date").cast("date").alias("run_date"))


@source_query
def s5_object_store_write(spark, sf_dir):
    """Land one table, publish it to a second root with the same layout, read it there."""
    root, store = scratch_dir(spark, "landing"), scratch_dir(spark, "store")
    path = landing.write_landing(Warehouse.open(spark, sf_dir).raw.products, "products", root, LANDING_DATE)
    landing.publish(spark, path, "products", LANDING_DATE, landing.ObjectStore(store), strict=True)
    return landing.read_parquet(spark, "products", f"{store}/products").select(
        "product_id", "name", "category", d("unit_price"), "launch_date"
    )


@source_query
def s6_etl_run(spark, sf_dir):
    """Extract, land and publish all five tables; rows per landed table."""
    root, store = scratch_dir(spark, "landing"), scratch_dir(spark, "store")
    raw = Warehouse.open(spark, sf_dir).raw
    landing.run_extract(spark, raw.table, root, LANDING_DATE, landing.ObjectStore(store), strict=True)
    counts = [
        landing.read_parquet(spark, t, f"{store}/{t}").agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n")
        for t in landing.EXTRACT_TABLES
    ]
    return quality.union_all(counts)


@source_query
def s10_ctas_replace(spark, sf_dir):
    """The daily sales mart stored twice in place and read back."""
    path = scratch_dir(spark, "mart")
    sales = Warehouse.open(spark, sf_dir, NONE).daily_sales
    for _ in range(2):
        sales.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    return spark.read.schema(sales.schema).parquet(path).select("order_date", "channel", d("total_amount"))


@query()
def s13_model_input_view(w):
    """View of resolved training rows, read by name."""
    spark = w.fact_orders.sparkSession
    resolved = marts.resolved_labels(w.customer_features, w.as_of)
    resolved.createOrReplaceTempView("customer_features_view")
    return spark.table("customer_features_view").select(*feature_columns(), "churned_next_30d")


@query()
def s16_table_read(w):
    """SQL with bound parameters over a named table."""
    spark = w.fact_orders.sparkSession
    w.daily_sales.createOrReplaceTempView("daily_sales_view")
    return spark.sql(
        "SELECT order_date, CAST(total_amount AS DOUBLE) AS total_amount FROM daily_sales_view WHERE channel = :channel",
        args={"channel": "1-URGENT"},
    )


# --- projections and filters


@query()
def p1_column_projection(w):
    return w.dim_customer


@query(ORDER_REGION | ITEMS)
def p2_drop_internal_columns(w):
    """An internal column on the input never reaches the declared table."""
    marked = w.raw.orders.withColumn("is_injected_anomaly", F.lit(True))
    return conform(marked, "orders").select(*order_columns())


@query()
def p3_not_null_filter(w):
    return w.raw.customers.na.drop(subset=["customer_id", "signup_date"]).select("customer_id", "signup_date")


@query()
def p4_value_filter(w):
    items = w.staged("order_items").where(F.col("quantity") > 25)
    return items.select("order_item_id", big("quantity"), d("unit_price"))


@query()
def p5_null_default(w):
    gaps = w.raw.customers.select(
        "customer_id",
        "churn_date",
        F.when(F.col("plan_type") != "BUILDING", F.col("plan_type")).alias("plan_type"),
        F.when(F.col("region") != "ASIA", F.col("region")).alias("region"),
        F.when(F.col("plan_type") != "MACHINERY", F.col("is_active")).alias("is_active"),
    )
    return staging.with_defaults(gaps).select("customer_id", "is_active", "plan_type", "region")


@query()
def p6_constant_column(w):
    return w.fact_subscription_events.select("subscription_id", "event_type")


@query()
def p7_as_of_filter(w):
    cut = F.date_sub(F.lit(w.as_of), 365)
    return w.fact_orders.where(F.col("order_date") <= cut).select("order_id", "order_date")


@query()
def p8_half_open_window_filter(w):
    return w.fact_orders.where(fn.in_trailing_window("order_date", w.as_of, 90)).select("order_id", "order_date")


@query()
def p9_pit_eligibility(w):
    at = F.date_sub(F.lit(w.as_of), 180)
    return w.dim_customer.where(fn.eligible_at("signup_date", "churn_date", at)).select("customer_id", "signup_date", "churn_date")


@query()
def p10_recent_days_filter(w):
    return w.fact_orders.where(F.col("order_date") >= F.date_sub(F.lit(w.as_of), 30)).select("order_id", "order_date", d("order_amount"))


@query()
def p11_latest_snapshot_filter(w):
    return w.latest_features.select(*feature_columns(), "churned_next_30d")


@query()
def p13_in_list(w):
    return w.fact_orders.where(F.dayofweek("order_date").isin(1, 7)).select("order_id", "order_date")


@query(ITEMS)
def p16_null_fill_features(w):
    return marts.model_ready_orders(w.order_features).select(*order_feature_columns())


@query()
def p17_rename(w):
    return w.fact_orders.select("order_id", F.col("order_amount").cast("double").alias("total_amount"))


@query()
def p18_resolved_label_filter(w):
    rows = marts.resolved_labels(w.customer_features, w.as_of, horizon_days=60)
    return rows.select("customer_id", "snapshot_date", "churned_next_30d")


# --- joins


@query()
def j1_inner_equi(w):
    return w.fact_order_items.select(
        "order_item_id", "order_id", "order_date", "product_id", "customer_id", big("quantity"), d("unit_price"), d("discount_pct", 4)
    )


@query()
def j2_inner_agg_join(w):
    return w.fact_orders.join(marts.order_item_averages(w.fact_order_items), "order_id").select(
        "order_id", d("order_amount"), d("avg_unit_price", 6), d("discount_pct", 6)
    )


@query()
def j3_left_agg_join(w):
    return w.fact_orders.join(marts.order_item_averages(w.fact_order_items), "order_id", "left").select(
        "order_id", d("order_amount"), d("avg_unit_price", 6), d("discount_pct", 6)
    )


@query()
def j4_left_join_then_conditional_agg(w):
    return w.customer_features.select("customer_id", "snapshot_date", big("frequency_90d"), d("monetary_90d"))


@query()
def j5_eligible_snapshots(w):
    """Customer and snapshot pairs, expanded per customer from its own first to last index."""
    start, stop = marts.snapshot_grid(w.dim_customer, w.as_of, marts.LABEL_HORIZON_DAYS)
    first, last = pit.snapshot_bounds(start, stop, 30, F.col("signup_date"), F.col("churn_date"))
    spans = w.dim_customer.withColumns({"lo": first, "hi": last}).where(F.col("lo") <= F.col("hi"))
    return spans.select("customer_id", F.explode(F.sequence("lo", "hi")).alias("i")).select(
        "customer_id", F.date_add(F.lit(start), F.col("i") * 30).alias("snapshot_date")
    )


@query()
def j6_two_key_self_join(w):
    """Snapshot rows joined on both keys with the label rows of the same mart."""
    features = w.customer_features
    labels = features.where("churned_next_30d").select("customer_id", "snapshot_date", F.lit(True).alias("churns"))
    return features.join(labels, ["customer_id", "snapshot_date"]).select(
        "customer_id", "snapshot_date", big("tenure_days"), "churns"
    )


@query()
def j7_left_semi(w):
    top = marts.top_products(w.fact_order_items).select("product_id")
    return w.fact_order_items.join(top, "product_id", "left_semi").select("order_item_id", "product_id", big("quantity"))


@query()
def j8_left_anti(w):
    """Orders without any item."""
    return w.fact_orders.join(w.staged("order_items").select("order_id"), "order_id", "left_anti").select("order_id", "customer_id")


@query()
def j9_lookup_with_default(w):
    """Demand with product names; a product missing in the lookup shows its id."""
    names = w.staged("products").where(F.col("category") != "PROMO").select("product_id", "name")
    return w.daily_product_demand.join(names, "product_id", "left").select(
        "order_date", "product_id", F.coalesce("name", "product_id").alias("product_name"), big("quantity_sold")
    )


@query()
def j10_map_lookup(w):
    return w.dim_customer.select("customer_id", fn.lookup(SEGMENT_MRR, "plan_type").alias("mrr"))


@query()
def j11_as_of_last(w):
    probes = w.customer_features.select("customer_id", "snapshot_date")
    return pit.last_on_or_before(probes, w.fact_orders, "customer_id", "snapshot_date", "order_date", "last_order_date")


@query()
def j12_set_disjoint_check(w):
    return quality.churned_in_features(w.customer_features, w.dim_customer).agg(F.count("*").alias("overlap"))


# --- aggregates


@query()
def a1_daily_sales(w):
    return w.daily_sales.select("order_date", "channel", d("total_amount"))


@query()
def a2_daily_product_demand(w):
    return w.daily_product_demand.select("order_date", "product_id", big("quantity_sold"))


@query()
def a3_product_revenue(w):
    return marts.product_revenue(w.fact_order_items).select("product_id", d("revenue"))


@query()
def a4_order_item_avgs(w):
    return marts.order_item_averages(w.fact_order_items).select("order_id", d("avg_unit_price", 6), d("discount_pct", 6))


def _recent_stats(w):
    recent = fn.in_trailing_window("order_date", w.as_of, 90)
    return recent, w.fact_orders.groupBy("customer_id")


@query()
def a5_conditional_count(w):
    recent, grouped = _recent_stats(w)
    return grouped.agg(F.count_if(recent).alias("frequency_90d"))


@query()
def a6_conditional_sum(w):
    recent, grouped = _recent_stats(w)
    total = F.sum(F.when(recent, F.col("order_amount")).otherwise(F.lit(0)))
    return grouped.agg(fn.rounded(total, 2).alias("monetary_90d"))


@query()
def a7_conditional_max(w):
    at = F.date_sub(F.lit(w.as_of), 180)
    return w.fact_orders.groupBy("customer_id").agg(
        F.max(F.when(F.col("order_date") <= at, F.col("order_date"))).alias("last_order_date")
    )


@query()
def a8_global_min_max(w):
    return w.dim_customer.agg(F.min("signup_date").alias("first_signup"), F.max("signup_date").alias("last_signup"))


@query(ORDER_REGION | ITEMS)
def a9_distinct_rows(w):
    doubled = w.raw.orders.unionByName(w.raw.orders)
    return staging.clean(doubled, "orders").select(*order_columns())


@query()
def a10_distinct_series_keys(w):
    return w.fact_orders.select("channel").distinct().orderBy("channel")


@query()
def a11_distinct_count(w):
    return w.fact_order_items.agg(
        F.count_distinct("product_id").alias("products"), F.count_distinct("customer_id").alias("customers")
    )


@query()
def a12_overview_kpis(w):
    return overview.kpis(w.dim_customer, w.fact_orders)


@query()
def a19_median_quantile(w):
    """Exact median and 95th percentile of order amounts per status."""
    wide = exact_quantiles(w.fact_orders, "order_amount", [0.5, 0.95], 100, ["status"])
    return wide.select("status", d("prob"), d("quantile", 4))


@query()
def a20_label_rate(w):
    return w.customer_features.agg(fn.rounded(F.avg(F.col("churned_next_30d").cast("int")), 6).alias("churn_rate"))


@query()
def a21_weekday_weekend_avg(w):
    daily = w.fact_orders.groupBy("order_date").agg(F.count("*").alias("n"))
    return daily.groupBy(fn.is_weekend("order_date").alias("is_weekend")).agg(fn.rounded(F.avg("n"), 4).alias("avg_orders"))


# --- windows


@query()
def w1_lag_hours(w):
    return pit.previous_day_gap(w.fact_orders.select("order_id", "customer_id", "order_date"))


def _sales_series(w):
    daily = w.daily_sales.select(F.col("channel").alias("series_id"), F.col("order_date").alias("ds"), F.col("total_amount").alias("y"))
    return series.gap_fill(daily)


def _demand_series(w):
    daily = w.daily_product_demand.select(
        F.col("product_id").alias("series_id"), F.col("order_date").alias("ds"), F.col("quantity_sold").alias("y")
    )
    return series.gap_fill(daily)


@query()
def w3_series_tail(w):
    return series.tail(_sales_series(w), 90).select("series_id", "ds", d("y"))


@query()
def w4_time_holdout_split(w):
    return series.with_holdout(_sales_series(w), 14).select("series_id", "ds", d("y"), "is_test")


@query()
def w5_stratified_split(w):
    rows = w.customer_features.select("customer_id", "snapshot_date", "churned_next_30d")
    return stratified_split(rows, "churned_next_30d", ["customer_id", "snapshot_date"], 0.25, 42)


@query()
def w6_quarter_trend(w):
    daily = w.fact_orders.groupBy("order_date").agg(F.sum("order_amount").cast("double").alias("total"))
    return series.quarter_means(daily, "order_date", "total").select(d("first_quarter_mean", 4), d("last_quarter_mean", 4))


@query()
def w7_contamination_cutoff(w):
    """The 1.5 % largest orders by the exact quantile cut."""
    cut = top_fraction_cut(w.fact_orders, "order_amount", 0.015, 100)
    return w.fact_orders.where(F.col("order_amount").cast("double") > cut).select("order_id", d("order_amount"))


# --- sorts and limits


@query()
def t1_top_products(w):
    return marts.top_products(w.fact_order_items).select("product_id", d("revenue"))


@query()
def t4_total_order(w):
    return w.daily_sales.select("order_date", "channel", d("total_amount")).orderBy("order_date", "channel")


@query()
def t5_top_demand_30d(w):
    """Top products by units over the last 30 days, all products."""
    recent = w.fact_order_items.where(F.col("order_date") >= F.date_sub(F.lit(w.as_of), 30))
    return (
        recent.groupBy("product_id")
        .agg(F.sum("quantity").alias("total_quantity"))
        .orderBy(F.desc("total_quantity"), "product_id")
        .limit(5)
    )


@query()
def t6_first_key_default(w):
    return w.fact_orders.agg(F.min("channel").alias("channel"))


# --- set operations


@query()
def u1_subscription_events(w):
    return w.fact_subscription_events.select("subscription_id", "customer_id", "event_date", "event_type", "plan", d("mrr"))


@query()
def u2_snapshot_concat(w):
    """All snapshots in one plan: rows and churners per snapshot."""
    return w.customer_features.groupBy("snapshot_date").agg(
        F.count("*").alias("customers"), F.count_if("churned_next_30d").alias("churners")
    )


# --- scalar functions


@query()
def f1_date_add_sub(w):
    return w.fact_orders.select(
        "order_id", F.date_add("order_date", 30).alias("plus_30"), F.date_sub("order_date", 90).alias("minus_90")
    )


@query()
def f2_date_diff_days(w):
    return w.fact_orders.select("order_id", F.datediff(F.lit(w.as_of), "order_date").cast("bigint").alias("age_days"))


@query()
def f3_hour_diff(w):
    return w.fact_orders.select("order_id", fn.hours_between("order_date", F.lit(w.as_of)).alias("age_hours"))


@query()
def f4_date_parts(w):
    return w.dim_date.select("date", big("year"), big("month"), big("day_of_week"))


@query()
def f5_is_weekend(w):
    return w.dim_date.select("date", "is_weekend")


@query()
def f6_date_spine(w):
    span = w.fact_orders.agg(F.min("order_date").alias("a"), F.max("order_date").alias("b"))
    return span.select(F.explode(fn.date_range(F.col("a"), F.col("b"), 30)).alias("snapshot_date"))


@query()
def f7_month_trunc(w):
    return w.fact_orders.select("order_id", F.trunc("order_date", "month").alias("month"))


@query()
def f9_safe_divide(w):
    recent, grouped = _recent_stats(w)
    stats = grouped.agg(
        F.count_if(recent).alias("n"), F.sum(F.when(recent, F.col("order_amount")).otherwise(F.lit(0))).alias("total")
    )
    return stats.select("customer_id", fn.rounded(fn.safe_divide("total", "n"), 6).alias("avg_order_value"))


@query()
def f10_if_case(w):
    """Risk tiers of an item's discount scaled to 0..1."""
    p = F.col("discount_pct").cast("double") * 10
    return w.fact_order_items.select("order_item_id", fn.risk_tier(p).alias("tier"))


@query()
def f11_label_expr(w):
    at = F.date_sub(F.lit(w.as_of), 30)
    rows = w.dim_customer.where(fn.eligible_at("signup_date", "churn_date", at)).withColumn("snapshot_date", at)
    return rows.select("customer_id", fn.in_forward_window("churn_date", "snapshot_date", 30).alias("churned_next_30d"))


@query()
def f12_round(w):
    share = F.col("order_amount").cast("double") / 7
    return w.fact_orders.select("order_id", F.round(share, 4).alias("r4"), F.round(share, 2).alias("r2"), d("order_amount", 1))


@query()
def f13_clip_at_zero(w):
    rest = F.col("order_amount").cast("double") - 200000.0
    return w.fact_orders.select("order_id", F.round(fn.clip_at_zero(rest), 2).alias("above_floor"))


@query()
def f14_abs_sqrt_square(w):
    e = F.col("order_amount").cast("double") - 200000.0
    return w.fact_orders.groupBy("channel").agg(
        fn.rounded(F.avg(F.abs(e)), 4).alias("mae"), fn.rounded(F.sqrt(F.avg(e * e)), 4).alias("rmse")
    )


@query()
def f15_sign_flip(w):
    return w.fact_orders.select("order_id", (-F.col("order_amount").cast("double")).alias("flipped"))


@query()
def f16_iso_date(w):
    return w.fact_orders.select("order_id", fn.iso_date("order_date").alias("order_day"))


@query()
def f17_number_format(w):
    """Grouped and fixed-point numbers of a one-row total per channel."""
    sums = w.fact_orders.groupBy("channel").agg(F.sum("order_amount").alias("s"), F.count("*").alias("n"))
    return sums.select(
        "channel",
        F.format_number(F.round("s", 0), 0).alias("grouped"),
        F.format_string("%d orders", "n").alias("counted"),
    )


@query()
def f18_string_ops(w):
    """Product names split, trimmed and joined again."""
    words = F.split(F.concat(F.lit("  "), "name", F.lit(" ")), " ")
    return w.staged("products").select(
        "product_id",
        F.trim(F.concat(F.lit("  "), "name", F.lit(" "))).alias("trimmed"),
        F.array_join(F.filter(words, lambda x: x != ""), "-").alias("joined"),
        F.regexp_extract("name", r"^(\w+)", 1).alias("stem"),
    )


@query()
def f19_row_to_object(w):
    """Rows as JSON objects, and a field read back with fallback keys."""
    obj = F.to_json(F.struct("customer_id", "plan_type"))
    value = F.coalesce(F.get_json_object(obj, "$.tier"), F.get_json_object(obj, "$.plan_type"), F.lit("none"))
    return w.dim_customer.select("customer_id", obj.alias("row_object"), value.alias("field"))


@query()
def f20_cast(w):
    return w.fact_orders.select(
        "order_id",
        F.col("order_id").try_cast("bigint").alias("order_number"),
        F.col("channel").try_cast("int").cast("bigint").alias("channel_number"),
        F.col("order_amount").cast("double").alias("order_amount"),
    )


@query()
def f21_null_to_none(w):
    """A NaN becomes NULL before a load."""
    amount = F.when(F.col("status") == "P", F.lit(float("nan"))).otherwise(F.col("order_amount").cast("double"))
    return w.fact_orders.select("order_id", fn.nan_to_null(amount).alias("order_amount"))


@query()
def f22_column_lowercase(w):
    upper = w.daily_sales.select(*[F.col(c).alias(c.upper()) for c in w.daily_sales.columns])
    return upper.toDF(*[c.lower() for c in upper.columns]).select("order_date", "channel", d("total_amount"))


# --- feature tables and series


@query()
def ts1_customer_features(w):
    rows = marts.customer_features_at(w.dim_customer, w.fact_orders, w.as_of)
    return rows.select(*feature_columns())


@query()
def ts2_customer_features_with_label(w):
    at = F.date_sub(F.lit(w.as_of), 90)
    rows = marts.with_churn_label(marts.customer_features_at(w.dim_customer, w.fact_orders, at), 60)
    return rows.select(*feature_columns(), "churned_next_30d")


@query()
def ts3_customer_training_dataset(w):
    return w.customer_features.select(*feature_columns(), "churned_next_30d")


@query(ITEMS)
def ts4_order_transaction_features(w):
    return w.order_features.select(*order_feature_columns())


@query(ITEMS)
def ts4_order_features_recent_with_itemless(w):
    """Orders of the last 90 days, also those without items."""
    rows = marts.order_transaction_features(w.fact_orders, w.staged("order_items"), 90, w.as_of, how="left")
    return rows.select(*order_feature_columns())


@query()
def ts5_gap_fill(w):
    return _demand_series(w).select("series_id", "ds", d("y"))


@query()
def ts6_min_history_filter(w):
    kept = series.with_min_history(_demand_series(w), 2350)
    return kept.groupBy("series_id").agg(F.count("*").alias("points"))


@query()
def ts11_holiday_calendar(w):
    """The calendar with holidays from a table: here the days without a single order."""
    quiet = w.dim_date.join(w.fact_orders.select(F.col("order_date").alias("date")).distinct(), "date", "left_anti")
    first_days = w.dim_date.where(F.dayofmonth("date") == 1)
    holidays = quiet.select("date").unionByName(first_days.select("date"))
    span = dwh.days_until(F.col("order_date"), F.col("order_date"), w.fact_orders)
    return dwh.dim_date(span, holidays).select("date", "is_weekend", "is_holiday_jp")


# --- semantic layer and quality


@query()
def q1_monthly_revenue_by_channel(w):
    return semantic.monthly_revenue_by_channel(w.daily_sales).select("month", "channel", d("revenue"))


@query()
def q2_high_risk_count_by_region(w):
    return semantic.high_risk_by_region(w.latest_features)


@query()
def q3_top_products_by_demand(w):
    return semantic.top_products_by_demand(w.daily_product_demand, w.as_of)


@query()
def q4_metric_query(w):
    """Asked by synonyms: spend and frequency by plan and year."""
    return semantic.metric_query(
        {"customer_features": w.customer_features},
        "customer_features",
        {"消費額": "sum", "frequency_90d": "max"},
        dimensions=["プラン"],
        grain="year",
        filters={"region": "ASIA"},
    ).select("period", "plan_type", d("sum_monetary_90d"), big("max_frequency_90d"))


@query()
def q4_metric_ranges(w):
    """Several facts in a range of days and of tenure, for two regions."""
    return semantic.Metric(
        "customer_features",
        (("購入金額", "sum"), ("monetary_90d", "max"), ("customer_id", "distinct"), (semantic.ALL, "count")),
        ("region", "churned_next_30d"),
        "quarter",
        (
            ("region", ["ASIA", "EUROPE"]),
            ("snapshot_date", semantic.Range(dt.date(1997, 1, 1), dt.date(1999, 12, 31))),
            ("tenure_days", semantic.Range(least=200)),
        ),
    ).plan({"customer_features": w.customer_features}).select(
        "period", "region", "churned_next_30d", d("sum_monetary_90d"), d("max_monetary_90d"), big("distinct_customer_id"), big("count_all")
    )


@query()
def q4_verified_monthly_revenue(w):
    """Asked for by its question."""
    return semantic.answer(w.marts(), "チャネル別の月次売上を教えて").select("month", "channel", d("revenue"))


@query()
def q4_verified_high_risk(w):
    return semantic.answer(w.marts(), "high_risk_customer_count_by_region")


@query()
def q4_verified_top_products(w):
    return semantic.answer(w.marts(), "直近30日で最も需要が多い商品トップ5は？", w.as_of)


@query()
def q5_total_revenue(w):
    return semantic.total_revenue(w.daily_sales).select(d("total_revenue"))


@query()
def q6_churn_rate(w):
    return semantic.churn_rate(w.customer_features).select(d("churn_rate", 6))


@query()
def q7_high_risk_customers(w):
    return semantic.high_risk_customers(w.latest_features)


@query()
def q9_top_product_demand_30d(w):
    return semantic.demand_last_days(w.daily_product_demand, 30)


@query(ITEMS)
def q13_qc_profile(w):
    orders = w.raw.orders.withColumn("order_amount", F.col("order_amount").cast("decimal(18,2)"))
    rows = quality.profile(orders, ["order_id", "order_date", "channel", "order_amount", "item_count"])
    return rows.select("column_name", d("null_rate", 6), "min_value", "max_value")


@query()
def q13_qc_duplicates(w):
    """Line items keyed by order and product: real duplicates."""
    return quality.duplicate_keys(w.raw.order_items, ["order_id", "product_id"])


@query()
def q14_qc_referential_integrity(w):
    """With the products of one category removed there are orphans to find."""
    tables = {t: w.raw.table(t) for t in RAW_COLUMNS}
    tables["products"] = tables["products"].where(F.col("category") != "PROMO")
    return quality.referential_integrity(tables)


@query()
def q15_qc_business_rules(w):
    return quality.mart_rules(w.daily_sales, w.daily_product_demand, w.customer_features, marts.TOP_PRODUCTS)


@query(ORDER_REGION | ITEMS)
def st2_repeated_full_extracts(w):
    """Two full extracts of one table, one of them with changed rows: exact repeats fold, versions stay."""
    changed = w.raw.orders.withColumn(
        "status", F.when(F.col("channel") == "5-LOW", F.lit("X")).otherwise(F.col("status"))
    )
    return staging.clean(w.raw.orders.unionByName(changed), "orders").select(*order_columns())


@query()
def st2_latest_by_key(w):
    """Opt-in: only the newest version of each key of two extracts."""
    first = w.raw.orders.select("order_id", "status", F.lit(1).alias("extract_no"))
    second = first.where(F.col("status") != "F").select("order_id", F.lit("X").alias("status"), F.lit(2).alias("extract_no"))
    latest = staging.latest_by_key(first.unionByName(second), "order_id", "extract_no")
    return latest.select("order_id", "status", big("extract_no"))
