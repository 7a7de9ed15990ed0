"""Independent SQL for the registered queries, over the same Parquet tables.

The common table expressions spell the layers out in another form than the Spark plans use: snapshots meet the
customers' order days by a range join, LAG runs over the whole key, quantiles are functions.
"""

from __future__ import annotations

from tidemart.sources.driver_tables import SEGMENT_MRR

_MRR = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEGMENT_MRR.items()) + " END"

LAYERS = f"""
as_of AS (SELECT max(CAST(o_orderdate AS DATE)) AS d FROM orders),
cust AS (
  SELECT c_custkey, c_mktsegment, r_name AS region
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
line_counts AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey),
raw_orders AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
         CAST(o_orderdate AS DATE) AS order_date, o_orderpriority AS channel, region,
         CAST(o_totalprice AS DECIMAL(12,2)) AS order_amount, CAST(coalesce(n, 0) AS BIGINT) AS item_count,
         o_orderstatus AS status
  FROM orders LEFT JOIN cust ON o_custkey = c_custkey LEFT JOIN line_counts ON o_orderkey = l_orderkey),
raw_items AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS order_item_id,
         CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_partkey AS VARCHAR) AS product_id,
         CAST(l_quantity AS BIGINT) AS quantity, CAST(p_retailprice AS DECIMAL(12,2)) AS unit_price,
         CAST(l_discount + 0.0 AS DECIMAL(5,4)) AS discount_pct
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey),
launched AS (
  SELECT l_partkey, min(CAST(o_orderdate AS DATE)) AS launch_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey),
raw_products AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS name, p_type AS category,
         CAST(p_retailprice AS DECIMAL(12,2)) AS unit_price, launch_date
  FROM part LEFT JOIN launched ON p_partkey = l_partkey),
spans AS (
  SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS first_d, max(CAST(o_orderdate AS DATE)) AS last_d
  FROM orders GROUP BY o_custkey),
cust_dates AS (
  SELECT c_custkey, c_mktsegment, region, first_d,
         CASE WHEN last_d < (SELECT d FROM as_of) - 365 THEN last_d + 365 END AS churn_d
  FROM cust LEFT JOIN spans ON c_custkey = o_custkey),
raw_customers AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id, first_d AS signup_date, churn_d AS churn_date,
         churn_d IS NULL AS is_active, c_mktsegment AS plan_type, region
  FROM cust_dates),
raw_subs AS (
  SELECT 'S' || CAST(c_custkey AS VARCHAR) AS subscription_id, CAST(c_custkey AS VARCHAR) AS customer_id,
         c_mktsegment AS plan, CAST({_MRR} AS DECIMAL(12,2)) AS mrr, first_d AS start_date, churn_d AS end_date,
         CASE WHEN churn_d IS NULL THEN 'active' ELSE 'cancelled' END AS status
  FROM cust_dates),
stg_orders AS (
  SELECT DISTINCT * FROM raw_orders
  WHERE order_id IS NOT NULL AND customer_id IS NOT NULL AND order_amount >= 0),
stg_items AS (
  SELECT DISTINCT * FROM raw_items WHERE order_item_id IS NOT NULL AND order_id IS NOT NULL AND quantity > 0),
stg_products AS (SELECT DISTINCT * FROM raw_products WHERE product_id IS NOT NULL AND unit_price > 0),
stg_customers AS (
  SELECT DISTINCT customer_id, signup_date, churn_date, coalesce(is_active, churn_date IS NULL) AS is_active,
         coalesce(plan_type, 'unknown') AS plan_type, coalesce(region, 'unknown') AS region
  FROM raw_customers WHERE customer_id IS NOT NULL),
stg_subs AS (SELECT DISTINCT * FROM raw_subs WHERE subscription_id IS NOT NULL AND customer_id IS NOT NULL),
dim_customer AS (SELECT customer_id, region, plan_type, signup_date, churn_date, is_active FROM stg_customers),
dim_date AS (
  SELECT CAST(t AS DATE) AS date, CAST(year(t) AS BIGINT) AS year, CAST(month(t) AS BIGINT) AS month,
         CAST(dayofweek(t) + 1 AS BIGINT) AS day_of_week, dayofweek(t) IN (0, 6) AS is_weekend
  FROM (SELECT unnest(generate_series(
      (SELECT CAST(min(order_date) AS TIMESTAMP) FROM stg_orders),
      (SELECT CAST(max(order_date) AS TIMESTAMP) FROM stg_orders), INTERVAL 1 DAY)) AS t)),
fact_items AS (
  SELECT order_item_id, order_id, o.order_date, product_id, o.customer_id, quantity, unit_price, discount_pct
  FROM stg_items JOIN stg_orders o USING (order_id)),
fact_events AS (
  SELECT subscription_id, customer_id, start_date AS event_date, 'started' AS event_type, plan, mrr FROM stg_subs
  UNION ALL
  SELECT subscription_id, customer_id, end_date, 'cancelled', plan, mrr FROM stg_subs WHERE end_date IS NOT NULL),
daily_sales AS (
  SELECT order_date, channel, sum(order_amount) AS total_amount FROM stg_orders GROUP BY order_date, channel),
revenue AS (
  SELECT product_id, sum(quantity * unit_price) AS revenue FROM fact_items GROUP BY product_id),
best_sellers AS (SELECT product_id, revenue FROM revenue ORDER BY revenue DESC, product_id LIMIT 20),
demand AS (
  SELECT order_date, product_id, CAST(sum(quantity) AS BIGINT) AS quantity_sold
  FROM fact_items WHERE product_id IN (SELECT product_id FROM best_sellers) GROUP BY order_date, product_id),
eligible AS (
  SELECT c.*, CAST(unnest(generate_series(
    CAST(first_day AS TIMESTAMP), CAST(last_day AS TIMESTAMP), INTERVAL 30 DAY)) AS DATE) AS snapshot_date
  FROM dim_customer c, (SELECT (SELECT min(signup_date) + 180 FROM dim_customer) AS first_day, d - 30 AS last_day FROM as_of)),
grid AS (
  SELECT * FROM eligible WHERE signup_date <= snapshot_date AND coalesce(churn_date > snapshot_date, TRUE)),
customer_days AS (
  SELECT customer_id, order_date, count(*) AS n, sum(order_amount) AS amount FROM stg_orders GROUP BY customer_id, order_date),
spend AS (
  SELECT g.customer_id, g.snapshot_date, max(t.order_date) AS last_order_date,
    sum(CASE WHEN t.order_date > g.snapshot_date - 90 THEN n ELSE 0 END) AS frequency_90d,
    sum(CASE WHEN t.order_date > g.snapshot_date - 90 THEN amount ELSE 0 END) AS monetary_90d
  FROM grid g JOIN customer_days t ON t.customer_id = g.customer_id AND t.order_date <= g.snapshot_date
  GROUP BY g.customer_id, g.snapshot_date),
features AS MATERIALIZED (
  SELECT g.customer_id, g.snapshot_date, CAST(g.snapshot_date - last_order_date AS BIGINT) AS recency_days,
    CAST(coalesce(frequency_90d, 0) AS BIGINT) AS frequency_90d,
    CAST(round(coalesce(monetary_90d, 0), 2) AS DOUBLE) AS monetary_90d,
    round(CAST(monetary_90d AS DOUBLE) / nullif(frequency_90d, 0), 6) AS avg_order_value,
    CAST(g.snapshot_date - signup_date AS BIGINT) AS tenure_days, plan_type, region,
    coalesce(churn_date BETWEEN g.snapshot_date + 1 AND g.snapshot_date + 30, FALSE) AS churned_next_30d
  FROM grid g LEFT JOIN spend s ON s.customer_id = g.customer_id AND s.snapshot_date = g.snapshot_date),
latest AS (SELECT * FROM features WHERE snapshot_date = (SELECT max(snapshot_date) FROM features)),
item_avgs AS (
  SELECT order_id, round(avg(CAST(unit_price AS DOUBLE)), 6) AS avg_unit_price,
         round(avg(CAST(discount_pct AS DOUBLE)), 6) AS discount_pct
  FROM fact_items GROUP BY order_id),
order_features AS (
  SELECT o.order_id, o.order_date, o.customer_id, CAST(o.order_amount AS DOUBLE) AS order_amount, o.item_count,
    discount_pct, avg_unit_price,
    CAST(24 * (o.order_date - lag(o.order_date) OVER (PARTITION BY o.customer_id ORDER BY o.order_date, o.order_id)) AS BIGINT)
      AS hours_since_last_order
  FROM stg_orders o JOIN item_avgs USING (order_id)),
all_order_features AS (
  SELECT o.order_id, o.order_date, o.customer_id, CAST(o.order_amount AS DOUBLE) AS order_amount, o.item_count,
    discount_pct, avg_unit_price,
    CAST(24 * (o.order_date - lag(o.order_date) OVER (PARTITION BY o.customer_id ORDER BY o.order_date, o.order_id)) AS BIGINT)
      AS hours_since_last_order
  FROM stg_orders o LEFT JOIN item_avgs USING (order_id)),
sales_series AS (
  SELECT g.channel AS series_id, g.ds, coalesce(CAST(s.total_amount AS DOUBLE), 0.0) AS y
  FROM (SELECT channel, CAST(unnest(generate_series(CAST(min(order_date) AS TIMESTAMP), CAST(max(order_date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS ds
        FROM daily_sales GROUP BY channel) g
  LEFT JOIN daily_sales s ON s.channel = g.channel AND s.order_date = g.ds),
demand_series AS (
  SELECT g.product_id AS series_id, g.ds, coalesce(CAST(s.quantity_sold AS DOUBLE), 0.0) AS y
  FROM (SELECT product_id, CAST(unnest(generate_series(CAST(min(order_date) AS TIMESTAMP), CAST(max(order_date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS ds
        FROM demand GROUP BY product_id) g
  LEFT JOIN demand s ON s.product_id = g.product_id AND s.order_date = g.ds),
lengths AS (
  SELECT doc_id, source, len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS len FROM documents),
words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS word FROM documents)
"""

ORDER_COLUMNS = (
    "order_id, customer_id, order_date, channel, region, CAST(order_amount AS DOUBLE) AS order_amount, item_count, status"
)
FEATURES = (
    "customer_id, snapshot_date, recency_days, frequency_90d, monetary_90d, avg_order_value, tenure_days, plan_type, region"
)
RECENT = "order_date > (SELECT d FROM as_of) - 90 AND order_date <= (SELECT d FROM as_of)"


def _features_at(day: str, horizon: int | None = None) -> str:
    """Features at one date, written out with joins to all orders."""
    label = (
        ""
        if horizon is None
        else f", coalesce(churn_date > s AND churn_date <= s + {horizon}, FALSE) AS churned_next_30d"
    )
    return f"""
SELECT customer_id, s AS snapshot_date, CAST(s - last_d AS BIGINT) AS recency_days, n AS frequency_90d,
  CAST(round(m, 2) AS DOUBLE) AS monetary_90d, round(CAST(m AS DOUBLE) / nullif(n, 0), 6) AS avg_order_value,
  CAST(s - signup_date AS BIGINT) AS tenure_days, plan_type, region{label}
FROM (
  SELECT c.customer_id, c.signup_date, c.churn_date, c.plan_type, c.region, s,
    count(*) FILTER (WHERE o.order_date > s - 90) AS n,
    coalesce(sum(o.order_amount) FILTER (WHERE o.order_date > s - 90), 0) AS m, max(o.order_date) AS last_d
  FROM dim_customer c CROSS JOIN (SELECT {day} AS s FROM as_of)
  LEFT JOIN stg_orders o ON o.customer_id = c.customer_id AND o.order_date <= s
  WHERE c.signup_date <= s AND (c.churn_date IS NULL OR c.churn_date > s)
  GROUP BY ALL)"""


def _bm25(terms: list[str], where: str, live: str = "TRUE") -> str:
    """Ranked search over exploded words of the documents that are live."""
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean_len))), 9) AS score
FROM (SELECT doc_id, word, count(*) AS tf FROM words WHERE word IN ({listed}) AND {live} GROUP BY doc_id, word)
JOIN (SELECT word, count(DISTINCT doc_id) AS df FROM words WHERE {live} GROUP BY word) USING (word)
JOIN lengths USING (doc_id), (SELECT count(*) AS n, avg(len) AS mean_len FROM lengths WHERE {live})
WHERE {where}
GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10"""


_STATUS_CHANGED = "CASE WHEN channel = '5-LOW' THEN 'X' ELSE status END"

_RAW = {
    "customers": "raw_customers",
    "subscriptions": "raw_subs",
    "products": "raw_products",
    "orders": "raw_orders",
    "order_items": "raw_items",
}
_STAGED = {t: c.replace("raw_", "stg_") for t, c in _RAW.items()}
# A refresh has its calendar up to the run date, whatever the newest order.
_DAYS = """(SELECT unnest(generate_series(
  (SELECT CAST(min(order_date) AS TIMESTAMP) FROM stg_orders), (SELECT CAST(d AS TIMESTAMP) FROM as_of), INTERVAL 1 DAY)))"""
_STORED = {
    **{f"raw.{t}": c for t, c in _RAW.items()},
    **{f"staging.{t}": c for t, c in _STAGED.items()},
    "dwh.dim_customer": "dim_customer",
    "dwh.dim_product": "stg_products",
    "dwh.dim_date": _DAYS,
    "dwh.fact_orders": "stg_orders",
    "dwh.fact_order_items": "fact_items",
    "dwh.fact_subscription_events": "fact_events",
    "mart.daily_sales": "daily_sales",
    "mart.daily_product_demand": "demand",
    "mart.customer_features": "features",
    "mart.order_transaction_features": "order_features",
}

SQL: dict[str, str] = {
    "s1_parquet_scan": "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice FROM orders",
    "s4_landing_write": f"SELECT {ORDER_COLUMNS}, DATE '2001-08-01' AS run_date FROM raw_orders",
    "s5_object_store_write": (
        "SELECT product_id, name, category, CAST(unit_price AS DOUBLE) AS unit_price, launch_date FROM raw_products"
    ),
    "s6_etl_run": """
SELECT 'customers' AS table_name, count(*) AS n FROM raw_customers
UNION ALL SELECT 'subscriptions', count(*) FROM raw_subs
UNION ALL SELECT 'products', count(*) FROM raw_products
UNION ALL SELECT 'orders', count(*) FROM raw_orders
UNION ALL SELECT 'order_items', count(*) FROM raw_items""",
    "s7_auto_ingest": f"SELECT {ORDER_COLUMNS.replace('status', f'{_STATUS_CHANGED} AS status')} FROM raw_orders",
    "s7_ingest_ledger": "\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, DATE '2001-08-01' AS run_date, count(*) AS ledger_rows, count(*) AS raw_rows FROM {c}"
        for t, c in _RAW.items()
    ),
    "s5_publish_contract": "\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, FALSE AS without_store, FALSE AS unreachable, TRUE AS published, count(*) AS n_rows FROM {c}"
        for t, c in _RAW.items()
    ),
    "s9_bulk_load_raw": "\nUNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {c}" for t, c in _RAW.items()),
    "s9_bulk_load_raw_orders": f"SELECT {ORDER_COLUMNS} FROM raw_orders",
    "s14_namespaces": "\nUNION ALL ".join(
        f"SELECT '{layer}' AS namespace, '{t}' AS table_name, count(*) AS n_rows FROM {c}"
        for layer, t, c in [
            *(("raw", t, c) for t, c in _RAW.items()),
            ("staging", "customers", "stg_customers"),
            ("staging", "products", "stg_products"),
            ("dwh", "dim_customer", "dim_customer"),
            ("dwh", "dim_product", "stg_products"),
        ]
    ),
    "s8_copy_by_name": f"SELECT {ORDER_COLUMNS} FROM raw_orders",
    "s10_ctas_replace": "SELECT order_date, channel, CAST(total_amount AS DOUBLE) AS total_amount FROM daily_sales",
    "s11_ctas_if_absent": f"SELECT {ORDER_COLUMNS} FROM stg_orders",
    "s12_partitioned_clustered_write": (
        f"SELECT {ORDER_COLUMNS} FROM stg_orders WHERE order_date BETWEEN DATE '1997-01-15' AND DATE '1999-12-31'"
    ),
    "s12_bucketed_join": """
SELECT order_item_id, i.order_id, i.order_date, product_id, quantity, channel, CAST(order_amount AS DOUBLE) AS order_amount
FROM fact_items i JOIN stg_orders o ON o.order_id = i.order_id""",
    "s13_model_input_view": (
        f"SELECT {FEATURES}, churned_next_30d FROM features WHERE snapshot_date <= (SELECT d - 30 FROM as_of)"
    ),
    "s16_table_read": (
        "SELECT order_date, CAST(total_amount AS DOUBLE) AS total_amount FROM daily_sales WHERE channel = '1-URGENT'"
    ),
    "s17_daily_sales": "SELECT order_date, channel, CAST(total_amount AS DOUBLE) AS total_amount FROM daily_sales",
    "s17_daily_product_demand": "SELECT order_date, product_id, quantity_sold FROM demand",
    "s17_customer_features": f"SELECT {FEATURES}, churned_next_30d FROM features",
    "s17_order_transaction_features": "SELECT * FROM order_features",
    "p1_column_projection": "SELECT customer_id, region, plan_type, signup_date, churn_date, is_active FROM dim_customer",
    "p2_drop_internal_columns": f"SELECT {ORDER_COLUMNS} FROM raw_orders",
    "p3_not_null_filter": "SELECT customer_id, signup_date FROM raw_customers WHERE customer_id IS NOT NULL AND signup_date IS NOT NULL",
    "p4_value_filter": "SELECT order_item_id, quantity, CAST(unit_price AS DOUBLE) AS unit_price FROM stg_items WHERE quantity > 25",
    "p5_null_default": """
SELECT customer_id, coalesce(CASE WHEN plan_type <> 'MACHINERY' THEN is_active END, churn_date IS NULL) AS is_active,
  coalesce(CASE WHEN plan_type <> 'BUILDING' THEN plan_type END, 'unknown') AS plan_type,
  coalesce(CASE WHEN region <> 'ASIA' THEN region END, 'unknown') AS region
FROM raw_customers""",
    "p6_constant_column": "SELECT subscription_id, event_type FROM fact_events",
    "p7_as_of_filter": "SELECT order_id, order_date FROM stg_orders WHERE order_date <= (SELECT d - 365 FROM as_of)",
    "p8_half_open_window_filter": f"SELECT order_id, order_date FROM stg_orders WHERE {RECENT}",
    "p9_pit_eligibility": """
SELECT customer_id, signup_date, churn_date FROM dim_customer, (SELECT d - 180 AS s FROM as_of)
WHERE signup_date <= s AND (churn_date IS NULL OR churn_date > s)""",
    "p10_recent_days_filter": (
        "SELECT order_id, order_date, CAST(order_amount AS DOUBLE) AS order_amount FROM stg_orders "
        "WHERE order_date >= (SELECT d - 30 FROM as_of)"
    ),
    "p11_latest_snapshot_filter": f"SELECT {FEATURES}, churned_next_30d FROM latest",
    "p13_in_list": "SELECT order_id, order_date FROM stg_orders WHERE dayofweek(order_date) + 1 IN (1, 7)",
    "p16_null_fill_features": """
SELECT order_id, order_date, customer_id, coalesce(order_amount, 0.0) AS order_amount, coalesce(item_count, 0) AS item_count,
  coalesce(discount_pct, 0.0) AS discount_pct, coalesce(avg_unit_price, 0.0) AS avg_unit_price,
  coalesce(hours_since_last_order, 8760) AS hours_since_last_order
FROM order_features""",
    "p17_rename": "SELECT order_id, CAST(order_amount AS DOUBLE) AS total_amount FROM stg_orders",
    "p18_resolved_label_filter": (
        "SELECT customer_id, snapshot_date, churned_next_30d FROM features WHERE snapshot_date <= (SELECT d - 60 FROM as_of)"
    ),
    "j1_inner_equi": """
SELECT order_item_id, order_id, order_date, product_id, customer_id, quantity,
  CAST(unit_price AS DOUBLE) AS unit_price, CAST(discount_pct AS DOUBLE) AS discount_pct
FROM fact_items""",
    "j2_inner_agg_join": (
        "SELECT order_id, CAST(order_amount AS DOUBLE) AS order_amount, avg_unit_price, discount_pct "
        "FROM stg_orders JOIN item_avgs USING (order_id)"
    ),
    "j3_left_agg_join": (
        "SELECT order_id, CAST(order_amount AS DOUBLE) AS order_amount, avg_unit_price, discount_pct "
        "FROM stg_orders LEFT JOIN item_avgs USING (order_id)"
    ),
    "j4_left_join_then_conditional_agg": "SELECT customer_id, snapshot_date, frequency_90d, monetary_90d FROM features",
    "j5_eligible_snapshots": "SELECT customer_id, snapshot_date FROM grid",
    "j6_two_key_self_join": """
SELECT a.customer_id, a.snapshot_date, CAST(a.snapshot_date - a.signup_date AS BIGINT) AS tenure_days, TRUE AS churns
FROM grid a JOIN grid b ON b.customer_id = a.customer_id AND b.snapshot_date = a.snapshot_date
WHERE b.churn_date BETWEEN b.snapshot_date + 1 AND b.snapshot_date + 30""",
    "j7_left_semi": (
        "SELECT order_item_id, product_id, quantity FROM fact_items WHERE product_id IN (SELECT product_id FROM best_sellers)"
    ),
    "j8_left_anti": (
        "SELECT order_id, customer_id FROM stg_orders o WHERE NOT EXISTS (SELECT 1 FROM stg_items i WHERE i.order_id = o.order_id)"
    ),
    "j9_lookup_with_default": """
SELECT order_date, product_id, coalesce(name, product_id) AS product_name, quantity_sold
FROM demand LEFT JOIN (SELECT product_id, name FROM stg_products WHERE category <> 'PROMO') USING (product_id)""",
    "j10_map_lookup": f"SELECT customer_id, CAST({_MRR.replace('c_mktsegment', 'plan_type')} AS DOUBLE) AS mrr FROM dim_customer",
    "j11_as_of_last": "SELECT customer_id, snapshot_date, last_order_date FROM grid LEFT JOIN spend USING (customer_id, snapshot_date)",
    "j12_set_disjoint_check": (
        "SELECT count(*) AS overlap FROM features JOIN dim_customer USING (customer_id) WHERE churn_date <= snapshot_date"
    ),
    "a1_daily_sales": "SELECT order_date, channel, CAST(total_amount AS DOUBLE) AS total_amount FROM daily_sales",
    "a2_daily_product_demand": "SELECT order_date, product_id, quantity_sold FROM demand",
    "a3_product_revenue": "SELECT product_id, CAST(revenue AS DOUBLE) AS revenue FROM revenue",
    "a4_order_item_avgs": "SELECT order_id, avg_unit_price, discount_pct FROM item_avgs",
    "a5_conditional_count": f"SELECT customer_id, count(*) FILTER (WHERE {RECENT}) AS frequency_90d FROM stg_orders GROUP BY customer_id",
    "a6_conditional_sum": (
        f"SELECT customer_id, CAST(sum(CASE WHEN {RECENT} THEN order_amount ELSE 0 END) AS DOUBLE) AS monetary_90d "
        "FROM stg_orders GROUP BY customer_id"
    ),
    "a7_conditional_max": (
        "SELECT customer_id, max(CASE WHEN order_date <= (SELECT d - 180 FROM as_of) THEN order_date END) AS last_order_date "
        "FROM stg_orders GROUP BY customer_id"
    ),
    "a8_global_min_max": "SELECT min(signup_date) AS first_signup, max(signup_date) AS last_signup FROM dim_customer",
    "a9_distinct_rows": f"SELECT {ORDER_COLUMNS} FROM (SELECT * FROM stg_orders UNION SELECT * FROM stg_orders)",
    "a10_distinct_series_keys": "SELECT DISTINCT channel FROM stg_orders ORDER BY channel",
    "a11_distinct_count": (
        "SELECT count(DISTINCT product_id) AS products, count(DISTINCT customer_id) AS customers FROM fact_items"
    ),
    "a12_overview_kpis": """
SELECT (SELECT count(*) FROM dim_customer) AS total_customers,
  (SELECT count(*) FROM dim_customer WHERE is_active) AS active_customers,
  count(*) AS total_orders, CAST(sum(order_amount) AS DOUBLE) AS total_revenue
FROM stg_orders""",
    "a19_median_quantile": """
SELECT status, p AS prob, round(CASE WHEN p = 0.5 THEN m ELSE t END, 4) AS quantile
FROM (SELECT status, quantile_cont(CAST(order_amount AS DOUBLE), 0.5) AS m, quantile_cont(CAST(order_amount AS DOUBLE), 0.95) AS t
      FROM stg_orders GROUP BY status), (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.95 AS DOUBLE))) v(p)""",
    "a20_label_rate": "SELECT round(avg(CAST(churned_next_30d AS INT)), 6) AS churn_rate FROM features",
    "a21_weekday_weekend_avg": """
SELECT dayofweek(order_date) IN (0, 6) AS is_weekend, round(avg(n), 4) AS avg_orders
FROM (SELECT order_date, count(*) AS n FROM stg_orders GROUP BY order_date) GROUP BY 1""",
    "w1_lag_hours": """
SELECT order_id, customer_id, order_date, CAST(24 * (order_date -
  lag(order_date) OVER (PARTITION BY customer_id ORDER BY order_date, order_id)) AS BIGINT) AS hours_since_last_order
FROM stg_orders""",
    "w3_series_tail": """
SELECT series_id, ds, round(y, 2) AS y FROM sales_series
QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) <= 90""",
    "w4_time_holdout_split": """
SELECT series_id, ds, round(y, 2) AS y, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) <= 14 AS is_test
FROM sales_series""",
    "w5_stratified_split": """
SELECT customer_id, snapshot_date, churned_next_30d,
  row_number() OVER (PARTITION BY churned_next_30d ORDER BY md5(customer_id || '|' || CAST(snapshot_date AS VARCHAR) || '|42'))
  <= floor(0.25 * count(*) OVER (PARTITION BY churned_next_30d)) AS is_test
FROM features""",
    "w6_quarter_trend": """
SELECT round(avg(total) FILTER (WHERE r <= q), 4) AS first_quarter_mean,
  round(avg(total) FILTER (WHERE r > n - q), 4) AS last_quarter_mean
FROM (SELECT total, row_number() OVER (ORDER BY order_date) AS r, count(*) OVER () AS n, count(*) OVER () // 4 AS q
      FROM (SELECT order_date, CAST(sum(order_amount) AS DOUBLE) AS total FROM stg_orders GROUP BY order_date))""",
    "w7_contamination_cutoff": """
SELECT order_id, CAST(order_amount AS DOUBLE) AS order_amount FROM stg_orders
WHERE CAST(order_amount AS DOUBLE) > (SELECT quantile_cont(CAST(order_amount AS DOUBLE), 0.985) FROM stg_orders)""",
    "t1_top_products": "SELECT product_id, CAST(revenue AS DOUBLE) AS revenue FROM best_sellers",
    "t4_total_order": "SELECT order_date, channel, CAST(total_amount AS DOUBLE) AS total_amount FROM daily_sales ORDER BY 1, 2",
    "t5_top_demand_30d": """
SELECT product_id, CAST(sum(quantity) AS BIGINT) AS total_quantity FROM fact_items
WHERE order_date >= (SELECT d - 30 FROM as_of) GROUP BY product_id ORDER BY total_quantity DESC, product_id LIMIT 5""",
    "t6_first_key_default": "SELECT min(channel) AS channel FROM stg_orders",
    "u1_subscription_events": (
        "SELECT subscription_id, customer_id, event_date, event_type, plan, CAST(mrr AS DOUBLE) AS mrr FROM fact_events"
    ),
    "u2_snapshot_concat": (
        "SELECT snapshot_date, count(*) AS customers, count(*) FILTER (WHERE churned_next_30d) AS churners "
        "FROM features GROUP BY snapshot_date"
    ),
    "f1_date_add_sub": "SELECT order_id, order_date + 30 AS plus_30, order_date - 90 AS minus_90 FROM stg_orders",
    "f2_date_diff_days": "SELECT order_id, CAST((SELECT d FROM as_of) - order_date AS BIGINT) AS age_days FROM stg_orders",
    "f3_hour_diff": (
        "SELECT order_id, date_diff('hour', CAST(order_date AS TIMESTAMP), CAST((SELECT d FROM as_of) AS TIMESTAMP)) AS age_hours "
        "FROM stg_orders"
    ),
    "f4_date_parts": "SELECT date, year, month, day_of_week FROM dim_date",
    "f5_is_weekend": "SELECT date, is_weekend FROM dim_date",
    "f6_date_spine": """
SELECT CAST(unnest(generate_series(CAST(min(order_date) AS TIMESTAMP), CAST(max(order_date) AS TIMESTAMP), INTERVAL 30 DAY)) AS DATE)
  AS snapshot_date FROM stg_orders""",
    "f7_month_trunc": "SELECT order_id, CAST(date_trunc('month', order_date) AS DATE) AS month FROM stg_orders",
    "f9_safe_divide": f"""
SELECT customer_id, round(CAST(sum(CASE WHEN {RECENT} THEN order_amount ELSE 0 END) AS DOUBLE)
  / nullif(count(*) FILTER (WHERE {RECENT}), 0), 6) AS avg_order_value
FROM stg_orders GROUP BY customer_id""",
    "f10_if_case": """
SELECT order_item_id, CASE WHEN CAST(discount_pct AS DOUBLE) * 10 >= 0.6 THEN 'high'
  WHEN CAST(discount_pct AS DOUBLE) * 10 >= 0.3 THEN 'medium' ELSE 'low' END AS tier
FROM fact_items""",
    "f11_label_expr": """
SELECT customer_id, coalesce(churn_date > s AND churn_date <= s + 30, FALSE) AS churned_next_30d
FROM dim_customer, (SELECT d - 30 AS s FROM as_of) WHERE signup_date <= s AND (churn_date IS NULL OR churn_date > s)""",
    "f12_round": """
SELECT order_id, round(CAST(order_amount AS DOUBLE) / 7, 4) AS r4, round(CAST(order_amount AS DOUBLE) / 7, 2) AS r2,
  CAST(round(order_amount, 1) AS DOUBLE) AS order_amount FROM stg_orders""",
    "f13_clip_at_zero": (
        "SELECT order_id, round(greatest(CAST(order_amount AS DOUBLE) - 200000.0, 0.0), 2) AS above_floor FROM stg_orders"
    ),
    "f14_abs_sqrt_square": """
SELECT channel, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse
FROM (SELECT channel, CAST(order_amount AS DOUBLE) - 200000.0 AS e FROM stg_orders) GROUP BY channel""",
    "f15_sign_flip": "SELECT order_id, -CAST(order_amount AS DOUBLE) AS flipped FROM stg_orders",
    "f16_iso_date": "SELECT order_id, strftime(order_date, '%Y-%m-%d') AS order_day FROM stg_orders",
    "f17_number_format": """
SELECT channel, format('{:,}', CAST(round(sum(order_amount), 0) AS BIGINT)) AS grouped, count(*) || ' orders' AS counted
FROM stg_orders GROUP BY channel""",
    "f18_string_ops": """
SELECT product_id, name AS trimmed, replace(name, ' ', '-') AS joined, regexp_extract(name, '^(\\w+)', 1) AS stem
FROM stg_products""",
    "f19_row_to_object": """
SELECT customer_id, '{"customer_id":"' || customer_id || '","plan_type":"' || plan_type || '"}' AS row_object,
  plan_type AS field FROM dim_customer""",
    "f20_cast": """
SELECT order_id, CAST(order_id AS BIGINT) AS order_number, CAST(TRY_CAST(channel AS INTEGER) AS BIGINT) AS channel_number,
  CAST(order_amount AS DOUBLE) AS order_amount FROM stg_orders""",
    "f21_null_to_none": (
        "SELECT order_id, CASE WHEN status <> 'P' THEN CAST(order_amount AS DOUBLE) END AS order_amount FROM stg_orders"
    ),
    "f22_column_lowercase": "SELECT order_date, channel, CAST(total_amount AS DOUBLE) AS total_amount FROM daily_sales",
    "ts1_customer_features": _features_at("d"),
    "ts2_customer_features_with_label": _features_at("d - 90", 60),
    "ts3_customer_training_dataset": f"SELECT {FEATURES}, churned_next_30d FROM features",
    "ts4_order_transaction_features": "SELECT * FROM order_features",
    "ts4_order_features_recent_with_itemless": (
        "SELECT * FROM all_order_features WHERE order_date >= (SELECT d - 90 FROM as_of)"
    ),
    "ts5_gap_fill": "SELECT series_id, ds, round(y, 2) AS y FROM demand_series",
    "ts6_min_history_filter": (
        "SELECT series_id, count(*) AS points FROM demand_series GROUP BY series_id HAVING count(*) >= 2350"
    ),
    "ts11_holiday_calendar": """
SELECT date, is_weekend, day(date) = 1 OR date NOT IN (SELECT order_date FROM stg_orders) AS is_holiday_jp FROM dim_date""",
    "q1_monthly_revenue_by_channel": """
SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, channel, CAST(sum(total_amount) AS DOUBLE) AS revenue
FROM daily_sales GROUP BY 1, 2 ORDER BY 1, 2""",
    "q2_high_risk_count_by_region": (
        "SELECT region, count(*) AS high_risk_customers FROM latest WHERE churned_next_30d GROUP BY region ORDER BY 2 DESC, 1"
    ),
    "q3_top_products_by_demand": """
SELECT product_id, CAST(sum(quantity_sold) AS BIGINT) AS total_quantity FROM demand
WHERE order_date >= (SELECT d - 30 FROM as_of) GROUP BY product_id ORDER BY total_quantity DESC, product_id LIMIT 5""",
    "q4_metric_query": """
SELECT CAST(date_trunc('year', snapshot_date) AS DATE) AS period, plan_type, round(sum(monetary_90d), 2) AS sum_monetary_90d,
  max(frequency_90d) AS max_frequency_90d
FROM features WHERE region = 'ASIA' GROUP BY 1, 2""",
    "q4_metric_ranges": """
SELECT CAST(date_trunc('quarter', snapshot_date) AS DATE) AS period, region, churned_next_30d,
  round(sum(monetary_90d), 2) AS sum_monetary_90d, max(monetary_90d) AS max_monetary_90d,
  count(DISTINCT customer_id) AS distinct_customer_id, count(*) AS count_all
FROM features
WHERE region IN ('ASIA', 'EUROPE') AND snapshot_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' AND tenure_days >= 200
GROUP BY 1, 2, 3""",
    "ts11_holiday_forecast": """
SELECT series_id, CAST(60 AS BIGINT) AS n_days, max(ds) + 1 AS first_ds, max(ds) + 60 AS last_ds,
  CASE WHEN bool_or(month(ds) = 12 AND day(ds) = 25) THEN 'christmas,' ELSE '' END
    || CASE WHEN bool_or(day(ds) = 15) THEN 'mid month' ELSE '' END AS holidays, TRUE AS ordered
FROM sales_series GROUP BY series_id HAVING count(*) >= 28""",
    "m12_model_registry": """
SELECT model, CAST(2 AS BIGINT) AS version, CAST(n AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_different FROM (
  SELECT 'churn_model' AS model, (SELECT count(*) FROM latest) AS n
  UNION ALL SELECT 'customer_segments_model', (SELECT count(*) FROM latest)
  UNION ALL SELECT 'anomaly_model', (SELECT count(*) FROM order_features)
  UNION ALL SELECT 'sales_forecast_model', (SELECT 30 * count(*) FROM (SELECT 1 FROM sales_series GROUP BY series_id HAVING count(*) >= 28))
  UNION ALL SELECT 'demand_forecast_model', (SELECT 14 * count(*) FROM (SELECT 1 FROM demand_series GROUP BY series_id HAVING count(*) >= 28)))""",
    "q5_total_revenue": "SELECT CAST(sum(total_amount) AS DOUBLE) AS total_revenue FROM daily_sales",
    "q6_churn_rate": "SELECT round(avg(CAST(churned_next_30d AS INT)), 6) AS churn_rate FROM features",
    "q7_high_risk_customers": (
        "SELECT count(DISTINCT customer_id) AS high_risk_customer_count FROM latest WHERE churned_next_30d"
    ),
    "q9_top_product_demand_30d": (
        "SELECT CAST(coalesce(sum(quantity_sold), 0) AS BIGINT) AS demand_last_days FROM demand "
        "WHERE order_date > (SELECT max(order_date) - 30 FROM demand)"
    ),
    "q12_qc_row_counts": "\nUNION ALL ".join(
        f"SELECT '{layer}' AS layer, '{t}' AS table_name, l.n AS loaded_rows, s.n AS source_rows, l.n = s.n AS matches "
        f"FROM (SELECT count(*) AS n FROM {loaded}) l, (SELECT count(*) AS n FROM {_RAW[t]}) s"
        for layer, tables in (("raw", _RAW), ("staging", _STAGED))
        for t, loaded in tables.items()
    ),
    "q13_qc_profile": "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(avg(CAST({e} IS NULL AS INT)), 6) AS null_rate, "
        f"CAST(min({e}) AS VARCHAR) AS min_value, CAST(max({e}) AS VARCHAR) AS max_value FROM raw_orders"
        for c, e in [
            ("order_id", "order_id"),
            ("order_date", "order_date"),
            ("channel", "channel"),
            ("order_amount", "CAST(order_amount AS DECIMAL(18, 2))"),
            ("item_count", "item_count"),
        ]
    ),
    "q13_qc_duplicates": """
SELECT count(*) AS n_rows, count(DISTINCT (order_id, product_id)) AS n_keys,
  count(*) - count(DISTINCT (order_id, product_id)) AS duplicate_rows FROM raw_items""",
    "q14_qc_referential_integrity": """
SELECT 'subscriptions' AS child_table, 'customer_id' AS column_name, 'customers' AS parent_table, count(*) AS orphan_rows
FROM raw_subs WHERE customer_id NOT IN (SELECT customer_id FROM raw_customers)
UNION ALL SELECT 'orders', 'customer_id', 'customers', count(*)
FROM raw_orders WHERE customer_id NOT IN (SELECT customer_id FROM raw_customers)
UNION ALL SELECT 'order_items', 'order_id', 'orders', count(*)
FROM raw_items WHERE order_id NOT IN (SELECT order_id FROM raw_orders)
UNION ALL SELECT 'order_items', 'product_id', 'products', count(*)
FROM raw_items WHERE product_id NOT IN (SELECT product_id FROM raw_products WHERE category <> 'PROMO')""",
    "q15_qc_business_rules": """
SELECT 'sales_amount_positive' AS rule, count(*) FILTER (WHERE NOT coalesce(total_amount > 0, FALSE)) AS violations FROM daily_sales
UNION ALL SELECT 'tenure_not_negative', count(*) FILTER (WHERE tenure_days < 0) FROM features
UNION ALL SELECT 'recency_not_negative', count(*) FILTER (WHERE recency_days < 0) FROM features
UNION ALL SELECT 'frequency_not_negative', count(*) FILTER (WHERE frequency_90d < 0) FROM features
UNION ALL SELECT 'at_most_top_products', greatest(count(DISTINCT product_id) - 20, 0) FROM demand
UNION ALL SELECT 'both_labels_occur', 2 - count(DISTINCT churned_next_30d) FROM features""",
    "st2_repeated_full_extracts": f"""
SELECT {ORDER_COLUMNS} FROM stg_orders
UNION SELECT {ORDER_COLUMNS.replace("status", f"{_STATUS_CHANGED} AS status")} FROM stg_orders""",
    "a15_forecast_error": """
SELECT a.series_id, round(avg(abs(b.y - a.y)), 2) AS mae, round(sqrt(avg((b.y - a.y) * (b.y - a.y))), 2) AS rmse
FROM sales_series a JOIN sales_series b ON a.series_id = b.series_id AND b.ds = a.ds - 7 GROUP BY a.series_id""",
    "a16_residual_std": "SELECT series_id, round(stddev_pop(y), 4) AS resid_std FROM sales_series GROUP BY series_id",
    "a18_detection_recall": """
SELECT round(count(*) FILTER (WHERE CAST(order_amount AS DOUBLE) > c AND item_count >= 6) / CAST(count(*) FILTER (WHERE item_count >= 6) AS DOUBLE), 4) AS recall
FROM stg_orders, (SELECT quantile_cont(CAST(order_amount AS DOUBLE), 0.985) AS c FROM stg_orders)""",
    "w2_rank_labels": """
SELECT cluster_id, size, CASE least(r, 4) WHEN 1 THEN 'VIP' WHEN 2 THEN '優良顧客' WHEN 3 THEN '一般顧客' ELSE '休眠リスク' END AS label
FROM (SELECT plan_type AS cluster_id, count(*) AS size, row_number() OVER (ORDER BY avg(monetary_90d) DESC, plan_type) AS r
      FROM latest GROUP BY plan_type)""",
    "s15_document_load": """
SELECT 'doc-' || doc_id AS doc_id, 'Text ' || doc_id AS title, source AS category,
  regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS content,
  CASE WHEN doc_id % 100 <> 7 THEN DATE '2001-08-01' END AS updated_at
FROM documents""",
    "q10_document_search": _bm25(["in", "from", "ertion"], "source = 'src1'"),
    "q10_document_search_all": _bm25(["für", "anre", "hation", "del"], "TRUE"),
    "q11_search_index_deletes": _bm25(["in", "from", "ertion"], "TRUE", "doc_id % 5 <> 0"),
    "q11_search_index_refresh": _bm25(["in", "from", "ertion"], "source = 'src1'"),
    "q16_qc_corpus": """
SELECT 'category_allowed' AS rule, count(*) FILTER (WHERE lang NOT IN ('en', 'de')) AS violations FROM documents
UNION ALL SELECT 'body_long_enough', count(*) FILTER (WHERE NOT length(text) > 100) FROM documents
UNION ALL SELECT 'doc_id_unique', count(*) - count(DISTINCT doc_id) FROM documents""",
    "st2_latest_by_key": """
SELECT order_id, CASE WHEN status <> 'F' THEN 'X' ELSE status END AS status,
  CAST(CASE WHEN status <> 'F' THEN 2 ELSE 1 END AS BIGINT) AS extract_no FROM raw_orders""",
}

# The verified queries of the semantic model ask what these ask.
SQL |= {
    "q4_verified_monthly_revenue": SQL["q1_monthly_revenue_by_channel"],
    "q4_verified_high_risk": SQL["q2_high_risk_count_by_region"],
    "q4_verified_top_products": SQL["q3_top_products_by_demand"],
}


def _refresh_counts(layers: str, refresh: str) -> str:
    """Rows of all stored tables after one refresh, in a WITH of its own."""
    counts = "\nUNION ALL ".join(
        f"SELECT '{refresh}' AS refresh, '{name}' AS table_name, count(*) AS n_rows FROM {cte}" for name, cte in _STORED.items()
    )
    return f"SELECT * FROM (WITH {layers.strip()}\n{counts})"


def statements() -> dict[str, str]:
    """Complete statements: the layers followed by each query's own SELECT."""
    out = {name: f"WITH {LAYERS.strip()}\n{sql.strip()}" for name, sql in SQL.items()}
    first = LAYERS.replace("ON o_orderkey = l_orderkey),\nraw_items", "ON o_orderkey = l_orderkey\n  WHERE o_orderstatus = 'F'),\nraw_items")
    out["s17_mart_refresh"] = f"{_refresh_counts(first, 'first')}\nUNION ALL\n{_refresh_counts(LAYERS, 'second')}"
    return out
