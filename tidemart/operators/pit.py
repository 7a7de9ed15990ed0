"""Point-in-time operators: as-of lookups, snapshot grids, previous event.

They share one idea. Dates are days, so what a key can contribute is bounded by the calendar,
not by its number of rows. Rows are first reduced per (key, day) or per (key, calendar bucket)
with partial aggregation; only those bounded sets are ordered in a window.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemart.functions.scalars import DateLike, as_date, hours_between


SAME_DAY_SALTS = 1024


def previous_day_gap(
    rows: DataFrame, key: str = "customer_id", day: str = "order_date", tie: str = "order_id"
) -> DataFrame:
    """Adds ``hours_since_last_order``: hours since the key's previous row by (day, tie).

    The plain form, a LAG over one partition per key, puts all rows of a hot key into one task.
    Here each (key, day, salt) group first names its leader, the row with the smallest tie. A row
    that is not a leader has a predecessor on the same day, so its gap is 0; without a day it is NULL. Leaders go on to the
    LAG over the key; a key has at most ``SAME_DAY_SALTS`` of them per calendar day. Between two
    leaders of one day the LAG gives 0 as it should, and the day's first row is always a leader
    whose previous leader lies on the key's previous active day. All other rows are spread by
    their own hash, so both exchanges stay even.
    """
    row_hash = F.xxhash64(*rows.columns)  # of the whole row, so versions of one tie spread too
    salt = F.pmod(row_hash, F.lit(SAME_DAY_SALTS))
    same_day = Window.partitionBy(key, day, "_salt").orderBy(tie)
    led = rows.withColumn("_salt", salt).withColumn("_leader", F.row_number().over(same_day) == 1)
    lane = F.when(F.col("_leader"), F.lit(-1)).otherwise(row_hash)
    history = Window.partitionBy(key, "_lane").orderBy(day, tie)
    gap = hours_between(F.lag(day).over(history), day)
    return (
        led.withColumn("_lane", lane)
        .withColumn("hours_since_last_order", F.when(F.col("_leader"), gap).when(F.col(day).isNotNull(), F.lit(0)))
        .select(*rows.columns, F.col("hours_since_last_order").cast("bigint"))
    )


def last_on_or_before(
    probes: DataFrame, events: DataFrame, key: str, probe_day: str, event_day: str, out: str
) -> DataFrame:
    """As-of lookup: the latest event day not after each probe day, NULL when there is none."""
    marks = events.select(key, F.col(event_day).alias("_day")).distinct()
    marks = marks.withColumn("_event", F.col("_day"))
    asked = probes.select("*", F.col(probe_day).alias("_day"), F.lit(True).alias("_probe"))
    w = Window.partitionBy(key).orderBy("_day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        asked.unionByName(marks, allowMissingColumns=True)
        .withColumn(out, F.max("_event").over(w))
        .where(F.col("_probe"))
        .select(*probes.columns, out)
    )


def snapshot_bounds(
    start: DateLike, stop: DateLike, interval_days: int, signup: Column, churn: Column
) -> tuple[Column, Column]:
    """First and last grid index at which a customer is eligible.

    Grid dates are start + i * interval up to stop. Eligible: signed up by the date and not
    churned at it. The range is empty when last < first.
    """
    origin = as_date(start)
    # greatest() skips NULLs; a customer without signup must not start at the first snapshot.
    first = F.when(
        signup.isNotNull(), F.greatest(F.lit(0), F.ceil(F.datediff(signup, origin) / F.lit(interval_days)))
    )
    grid_end = F.floor(F.datediff(as_date(stop), origin) / F.lit(interval_days))
    churn_end = F.floor((F.datediff(churn, origin) - 1) / F.lit(interval_days))
    return first.cast("int"), F.least(grid_end, churn_end).cast("int")


def snapshot_rollup(
    customers: DataFrame,
    orders: DataFrame,
    start: DateLike,
    stop: DateLike,
    interval_days: int,
    window_days: int,
) -> DataFrame:
    """Order statistics of every eligible (customer, snapshot) pair.

    Result: the customer columns, ``snapshot_date``, ``last_order_date``, ``frequency`` and
    ``monetary`` over the half-open window (snapshot - window_days, snapshot].

    Orders are summed once per (customer, calendar bucket). The bucket width divides both the
    interval and the window, so every window is a whole number of buckets and every snapshot a
    bucket edge. Customers travel through the exchange as one row each and are expanded to
    their snapshots only after it.
    """
    width = gcd(interval_days, window_days)
    origin = as_date(start)
    bucket = F.ceil(F.datediff("order_date", origin) / F.lit(width)).cast("int")
    sums = (
        orders.where(F.col("order_date") <= as_date(stop))
        .groupBy("customer_id", bucket.alias("_lo"))
        .agg(
            F.count("*").alias("_n"),
            F.sum("order_amount").alias("_amount"),
            F.max("order_date").alias("_last"),
        )
        .withColumn("_hi", F.col("_lo"))
    )
    first, last = snapshot_bounds(
        start, stop, interval_days, F.col("signup_date"), F.col("churn_date")
    )
    step = interval_days // width
    spans = (
        customers.withColumns({"_lo": first * step, "_hi": last * step, "_origin": origin})
        .where(F.col("_lo") <= F.col("_hi"))
        .withColumn("_base", F.lit(True))
    )
    merged = spans.unionByName(sums, allowMissingColumns=True).repartition("customer_id")
    points = merged.withColumn("_at", F.explode(F.sequence("_lo", "_hi", F.lit(step))))

    upto = Window.partitionBy("customer_id").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    recent = (
        Window.partitionBy("customer_id").orderBy("_at").rangeBetween(1 - window_days // width, 0)
    )
    return (
        points.withColumns(
            {
                "last_order_date": F.max("_last").over(upto),
                "frequency": F.coalesce(F.sum("_n").over(recent), F.lit(0)),
                "monetary": F.coalesce(F.sum("_amount").over(recent), F.lit(0)),
            }
        )
        .where(F.col("_base"))
        .select(
            *customers.columns,
            F.date_add("_origin", F.col("_at") * width).alias("snapshot_date"),
            "last_order_date",
            "frequency",
            "monetary",
        )
    )
