"""Semantic layer: named dimensions and facts over the marts, compiled to DataFrame plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemart.functions.scalars import DateLike, as_date


@dataclass(frozen=True)
class SemanticTable:
    """A mart with its queryable columns; values are synonyms users may write instead."""

    dimensions: Mapping[str, tuple[str, ...]]
    time_dimension: str
    facts: Mapping[str, tuple[str, ...]]
    primary_key: tuple[str, ...] = ()


# Tables, columns and synonyms of the semantic model.
SEMANTIC_MODEL: dict[str, SemanticTable] = {
    "daily_sales": SemanticTable(
        dimensions={"channel": ("販売経路", "チャネル")},
        time_dimension="order_date",
        facts={"total_amount": ("売上", "売上高", "合計金額")},
    ),
    "customer_features": SemanticTable(
        dimensions={
            "customer_id": (),
            "plan_type": ("プラン", "契約プラン"),
            "region": (),
            "churned_next_30d": ("解約フラグ", "チャーン"),
        },
        time_dimension="snapshot_date",
        facts={
            "recency_days": ("直近性",),
            "frequency_90d": ("購入頻度",),
            "monetary_90d": ("購入金額", "消費額"),
            "avg_order_value": (),
            "tenure_days": (),
        },
        primary_key=("customer_id", "snapshot_date"),
    ),
    "daily_product_demand": SemanticTable(
        dimensions={"product_id": ()},
        time_dimension="order_date",
        facts={"quantity_sold": ("販売数", "需要")},
    ),
    "order_transaction_features": SemanticTable(
        dimensions={"order_id": (), "customer_id": ()},
        time_dimension="order_date",
        facts={
            "order_amount": (),
            "item_count": (),
            "discount_pct": (),
            "avg_unit_price": (),
            "hours_since_last_order": (),
        },
        primary_key=("order_id",),
    ),
}

GRAINS = ("day", "month", "quarter", "year")
AGGREGATES = {
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "distinct": F.count_distinct,
}
#: Stands for all rows where a fact is asked for, as in a count of rows.
ALL = "*"


@dataclass(frozen=True)
class Range:
    """Values from ``least`` to ``most``, both included; None leaves a side open."""

    least: object = None
    most: object = None


@dataclass(frozen=True)
class LastDays:
    """Days from ``days`` before the run date on."""

    days: int


@dataclass(frozen=True)
class Latest:
    """Rows of the column's newest value."""


def resolve(names: Mapping[str, tuple[str, ...]], asked: str) -> str:
    """Column for a name or one of its synonyms; KeyError when there is none."""
    for name, synonyms in names.items():
        if asked == name or asked in synonyms:
            return name
    raise KeyError(asked)


def column(model: SemanticTable, asked: str) -> str:
    """Column of a table for a dimension, the time dimension or a fact, or a synonym of one."""
    return resolve({**model.dimensions, model.time_dimension: (), **model.facts}, asked)


def condition(df: DataFrame, name: str, wanted: object, as_of: DateLike | None) -> Column:
    """A filter: a value, a collection of values, a :class:`Range`, :class:`LastDays` or :class:`Latest`."""
    c = F.col(name)
    if isinstance(wanted, Range):
        sides = []
        if wanted.least is not None:
            sides.append(c >= F.lit(wanted.least))
        if wanted.most is not None:
            sides.append(c <= F.lit(wanted.most))
        return reduce(lambda a, b: a & b, sides, F.lit(True))
    if isinstance(wanted, LastDays):
        if as_of is None:
            raise ValueError("LastDays needs as_of")
        return c >= F.date_sub(as_date(as_of), wanted.days)
    if isinstance(wanted, Latest):
        return c == df.agg(F.max(name)).scalar()
    if isinstance(wanted, (list, tuple, set, frozenset)):
        return c.isin(*wanted)
    return c.isNull() if wanted is None else c == F.lit(wanted)


@dataclass(frozen=True)
class Metric:
    """A question to one table: facts with their aggregates, by dimensions and a time grain.

    ``facts`` are (fact, aggregate) pairs; their columns are called ``<aggregate>_<fact>`` unless ``names`` renames
    them (likewise ``period``). ``order`` names result columns, a leading minus turns the order round.
    """

    table: str
    facts: tuple[tuple[str, str], ...]
    dimensions: tuple[str, ...] = ()
    grain: str | None = None
    filters: tuple[tuple[str, object], ...] = ()
    order: tuple[str, ...] = ()
    limit: int | None = None
    names: tuple[tuple[str, str], ...] = ()

    def columns(self) -> list[str]:
        """Names of the result's columns; raises for unknown columns, aggregates, grains and orders."""
        model = SEMANTIC_MODEL[self.table]
        if self.grain is not None and self.grain not in GRAINS:
            raise ValueError(f"grain must be one of {GRAINS}")
        for asked, _ in self.filters:
            column(model, asked)
        out = ["period"] if self.grain else []
        out += [resolve(model.dimensions, d) for d in self.dimensions]
        for fact, how in self.facts:
            if how not in AGGREGATES:
                raise ValueError(f"unknown aggregate {how}")
            out.append("count_all" if fact == ALL else f"{how}_{column(model, fact)}")
        renamed = dict(self.names)
        out = [renamed.get(c, c) for c in out]
        if len(set(out)) < len(out):
            raise ValueError(f"columns named twice: {out}")
        for o in self.order:
            if o.lstrip("-") not in out:
                raise KeyError(o)
        return out

    def plan(self, marts: Mapping[str, DataFrame], as_of: DateLike | None = None) -> DataFrame:
        columns, model, df = self.columns(), SEMANTIC_MODEL[self.table], marts[self.table]
        for asked, wanted in self.filters:
            df = df.where(condition(df, column(model, asked), wanted, as_of))
        keys = [F.col(resolve(model.dimensions, d)) for d in self.dimensions]
        if self.grain is not None:
            day = F.col(model.time_dimension)
            keys.insert(0, (day if self.grain == "day" else F.trunc(day, self.grain)).alias("period"))
        measures = [
            F.count(F.lit(1)) if fact == ALL else AGGREGATES[how](column(model, fact)) for fact, how in self.facts
        ]
        out = df.groupBy(*keys).agg(*[m.alias(f"m{i}") for i, m in enumerate(measures)]).toDF(*columns)
        if self.order:
            out = out.orderBy(*[F.desc(o[1:]) if o.startswith("-") else F.asc(o) for o in self.order])
        return out if self.limit is None else out.limit(self.limit)


@dataclass(frozen=True)
class VerifiedQuery:
    """A named question with its checked answer."""

    name: str
    question: str
    metric: Metric


# Names and questions of the verified queries.
VERIFIED_QUERIES = (
    VerifiedQuery(
        "monthly_revenue_by_channel",
        "チャネル別の月次売上を教えて",
        Metric(
            "daily_sales",
            (("売上", "sum"),),
            ("チャネル",),
            grain="month",
            order=("month", "channel"),
            names=(("period", "month"), ("sum_total_amount", "revenue")),
        ),
    ),
    VerifiedQuery(
        "high_risk_customer_count_by_region",
        "地域別の解約リスクが高い顧客数を教えて",
        Metric(
            "customer_features",
            ((ALL, "count"),),
            ("region",),
            filters=(("チャーン", True), ("snapshot_date", Latest())),
            order=("-high_risk_customers", "region"),
            names=(("count_all", "high_risk_customers"),),
        ),
    ),
    VerifiedQuery(
        "top_products_by_demand",
        "直近30日で最も需要が多い商品トップ5は？",
        Metric(
            "daily_product_demand",
            (("需要", "sum"),),
            ("product_id",),
            filters=(("order_date", LastDays(30)),),
            order=("-total_quantity", "product_id"),
            limit=5,
            names=(("sum_quantity_sold", "total_quantity"),),
        ),
    ),
)


def verified(asked: str) -> VerifiedQuery:
    """The verified query of a name or question; KeyError when there is none."""
    wanted = asked.strip()
    for q in VERIFIED_QUERIES:
        if wanted in (q.name, q.question):
            return q
    raise KeyError(asked)


def answer(marts: Mapping[str, DataFrame], asked: str, as_of: DateLike | None = None) -> DataFrame:
    """The result of a verified query, asked for by its name or question."""
    return verified(asked).metric.plan(marts, as_of)


def validate(
    model: Mapping[str, SemanticTable] | None = None,
    queries: Sequence[VerifiedQuery] | None = None,
    marts: Mapping[str, DataFrame] | None = None,
) -> list[str]:
    """What is wrong with a semantic model: missing parts, clashing synonyms, columns or queries that do not resolve."""
    model = SEMANTIC_MODEL if model is None else model
    queries = VERIFIED_QUERIES if queries is None else queries
    faults = []
    for name, table in model.items():
        if not table.facts:
            faults.append(f"{name}: no facts")
        if not table.dimensions and not table.time_dimension:
            faults.append(f"{name}: no dimensions")
        parts = {**table.dimensions, table.time_dimension: (), **table.facts}
        words = [w for n, synonyms in parts.items() for w in (n, *synonyms)]
        faults += [f"{name}: {w} means several columns" for w in sorted({w for w in words if words.count(w) > 1})]
        faults += [f"{name}: key column {k} is not described" for k in table.primary_key if k not in parts]
        if marts is not None:
            found = marts[name].columns if name in marts else []
            faults += [f"{name}: no column {c}" for c in parts if c not in found]
    names = [x for q in queries for x in (q.name, q.question)]
    faults += [f"{x}: asked for twice" for x in sorted({x for x in names if names.count(x) > 1})]
    for q in queries:
        if not q.question.strip():
            faults.append(f"{q.name}: no question")
        try:
            q.metric.columns()
        except (KeyError, ValueError) as e:
            faults.append(f"{q.name}: {e}")
    return faults


def metric_query(
    marts: Mapping[str, DataFrame],
    table: str,
    facts: Mapping[str, str],
    dimensions: list[str] | None = None,
    grain: str | None = None,
    filters: Mapping[str, object] | None = None,
    since: DateLike | None = None,
) -> DataFrame:
    """Aggregate facts by dimensions and an optional time grain; see :class:`Metric`.

    ``facts`` maps a fact (or synonym) to an aggregate name, ``since`` is a first day.
    """
    metric = Metric(table, tuple(facts.items()), tuple(dimensions or ()), grain, tuple((filters or {}).items()))
    if since is None:
        return metric.plan(marts)
    day = F.col(SEMANTIC_MODEL[table].time_dimension)
    return metric.plan({table: marts[table].where(day >= as_date(since))})


def monthly_revenue_by_channel(daily_sales: DataFrame) -> DataFrame:
    return (
        daily_sales.groupBy(F.trunc("order_date", "month").alias("month"), "channel")
        .agg(F.sum("total_amount").alias("revenue"))
        .orderBy("month", "channel")
    )


def high_risk_by_region(latest_features: DataFrame) -> DataFrame:
    """Customers labelled as churning, by region, in rows of one snapshot."""
    return (
        latest_features.where("churned_next_30d")
        .groupBy("region")
        .agg(F.count("*").alias("high_risk_customers"))
        .orderBy(F.desc("high_risk_customers"), "region")
    )


def top_products_by_demand(
    demand: DataFrame, as_of: DateLike, days: int = 30, n: int = 5
) -> DataFrame:
    return (
        demand.where(F.col("order_date") >= F.date_sub(as_date(as_of), days))
        .groupBy("product_id")
        .agg(F.sum("quantity_sold").alias("total_quantity"))
        .orderBy(F.desc("total_quantity"), "product_id")
        .limit(n)
    )


def total_revenue(daily_sales: DataFrame) -> DataFrame:
    return daily_sales.agg(F.sum("total_amount").alias("total_revenue"))


def churn_rate(features: DataFrame) -> DataFrame:
    return features.agg(F.try_divide(F.count_if("churned_next_30d"), F.count("*")).alias("churn_rate"))


def high_risk_customers(latest_features: DataFrame) -> DataFrame:
    return latest_features.where("churned_next_30d").agg(
        F.count_distinct("customer_id").alias("high_risk_customer_count")
    )


def anomaly_amount_total(detected: DataFrame, threshold: float = 0.0) -> DataFrame:
    return detected.where(F.col("score") > threshold).agg(
        F.sum("order_amount").alias("anomaly_amount_total")
    )


def demand_last_days(demand: DataFrame, days: int = 30) -> DataFrame:
    """Units sold in the ``days`` days that end at the newest day of the mart.

    The mart is summed by day first, so its newest day and the sum come from one small frame.
    """
    by_day = demand.groupBy("order_date").agg(F.sum("quantity_sold").alias("q"))
    return by_day.agg(
        F.max("order_date").alias("last"), F.collect_list(F.struct("order_date", "q")).alias("days")
    ).select(
        F.aggregate(
            F.filter("days", lambda d: d["order_date"] > F.date_sub("last", days)),
            F.lit(0).cast("bigint"),
            lambda acc, d: acc + d["q"],
        ).alias("demand_last_days")
    )
