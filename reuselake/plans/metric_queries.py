"""Queries over the metric layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from reuselake.operators import metrics as M
from reuselake.plans.business import RECOGNIZED, REV, _orders, ORDERS, events
from reuselake.plans.catalog import query
from reuselake.plans.fixtures import AS_OF, Lake
from reuselake.operators.revenue import recognize_revenue
from reuselake.session import new_path

ALWAYS = ("1900-01-01", "2999-12-31")

REVENUE = M.SemanticModel(
    "revenue_events", "revenue", "revenue_event", ("billable_event_id",), "recognition_date",
    dimensions=("event_type", "source_currency"),
    measures=(
        M.Measure("net_revenue", "sum", "recognized_revenue_usd"),
        M.Measure("event_count", "count", "billable_event_id"),
        M.Measure("paying_customers", "count_distinct", "customer_id"),
    ),
)
CUSTOMER = M.SemanticModel(
    "customer_activity", "activity", "customer", ("customer_id",), "event_date", dimensions=("event_type",)
)
CUSTOMER_PLUS = M.extend(CUSTOMER, "customer_activity_plus", "activity_plus", ("customer_segment", "region_code"))
ORDER = M.SemanticModel("orders", "orders", "order", ("order_id",), "order_date", dimensions=("status",))

NET_REVENUE = M.Metric(
    "net_recognized_revenue", "sum", REVENUE, expr="recognized_revenue_usd",
    filters=(M.Filter("recognition_date", "not_null"),), dimensions=("event_type", "source_currency"),
)
ACTIVE = M.Metric(
    "active_customers", "count_distinct", CUSTOMER, expr="customer_id", default_grain="week", dimensions=("event_type",)
)
ACTIVE_90 = M.Metric(
    "active_90", "count_distinct", CUSTOMER, expr="customer_id", filters=(M.Filter("event_date", "within_days", 90),)
)
ACTIVE_30 = M.Metric(
    "active_30", "count_distinct", CUSTOMER, expr="customer_id", filters=(M.Filter("event_date", "within_days", 30),),
    canonical="active_90",
)
ACTIVE_BY_SEGMENT = M.Metric(
    "active_customers", "count_distinct", CUSTOMER_PLUS, expr="customer_id", dimensions=("customer_segment", "region_code")
)
REVENUE_PER_ACTIVE = M.Metric("revenue_per_active", "ratio", numerator=NET_REVENUE, denominator=ACTIVE, default_grain="quarter")
EVENT_COUNT = M.Metric("event_count", "simple", REVENUE, measure="event_count", default_grain="year", dimensions=("event_type",))
COMPLETED = M.Metric(
    "completed_orders", "count_distinct", ORDER, expr="order_id", filters=(M.Filter("is_completed", "is_true"),)
)


def datasets(lake: Lake) -> dict:
    from reuselake.functions.predicates import orders_with_completion_flag

    commercial = lake.commercial_events
    return {
        "revenue": recognize_revenue(events(lake), lake.dim_exchange_rates, *ALWAYS),
        "activity": commercial,
        "activity_plus": M.extended_dataset(
            commercial, lake.dim_customers.select("customer_id", "customer_segment", "region_code"), CUSTOMER
        ),
        "orders": orders_with_completion_flag(_orders(lake)),
    }


def _period(grain: str, c: str) -> str:
    return f"cast(date_trunc('{grain}', {c}) AS date) AS period"


@query("metric_sum_month", f"""WITH {RECOGNIZED} SELECT {_period('month', 'recognition_date')}, event_type,
    sum(recognized_revenue_usd)::decimal(38,2) AS net_recognized_revenue FROM recognized GROUP BY ALL""", REV)
def _(lake):
    out = M.evaluate(NET_REVENUE, datasets(lake), "month", ("event_type",))
    return out.withColumn("net_recognized_revenue", F.col("net_recognized_revenue").cast("decimal(38,2)"))


@query("metric_sum_day", f"""WITH {RECOGNIZED} SELECT {_period('day', 'recognition_date')},
    sum(recognized_revenue_usd)::decimal(38,2) AS net_recognized_revenue FROM recognized GROUP BY ALL""", REV)
def _(lake):
    out = M.evaluate(NET_REVENUE, datasets(lake), "day")
    return out.withColumn("net_recognized_revenue", F.col("net_recognized_revenue").cast("decimal(38,2)"))


@query("metric_count_distinct_week", f"""SELECT {_period('week', 'event_date')}, event_type,
    count(DISTINCT customer_id) AS active_customers FROM commercial_events GROUP BY ALL""", "commercial_events")
def _(lake):
    return M.evaluate(ACTIVE, datasets(lake), dims=("event_type",))


@query("metric_ratio_quarter", f"""WITH {RECOGNIZED}, n AS (SELECT {_period('quarter', 'recognition_date')},
      sum(recognized_revenue_usd)::decimal(38,2) AS v FROM recognized GROUP BY 1),
    d AS (SELECT {_period('quarter', 'event_date')}, count(DISTINCT customer_id) AS c FROM commercial_events GROUP BY 1)
  SELECT coalesce(n.period, d.period) AS period, v AS net_recognized_revenue, c AS active_customers,
    cast(v AS double) / nullif(c, 0) AS revenue_per_active FROM n FULL JOIN d ON n.period = d.period""",
       f"{REV} commercial_events")
def _(lake):
    out = M.evaluate(REVENUE_PER_ACTIVE, datasets(lake))
    return out.withColumn("net_recognized_revenue", F.col("net_recognized_revenue").cast("decimal(38,2)"))


@query("metric_simple_year", f"""WITH {RECOGNIZED} SELECT {_period('year', 'recognition_date')}, event_type,
    count(billable_event_id) AS event_count FROM recognized GROUP BY ALL""", REV)
def _(lake):
    return M.evaluate(EVENT_COUNT, datasets(lake), dims=("event_type",))


@query("metric_extended_model", f"""SELECT {_period('month', 'event_date')}, customer_segment, region_code,
    count(DISTINCT e.customer_id) AS active_customers FROM commercial_events e
  LEFT JOIN dim_customers c ON c.customer_id = e.customer_id GROUP BY ALL""", "commercial_events dim_customers")
def _(lake):
    return M.evaluate(ACTIVE_BY_SEGMENT, datasets(lake), "month", ("customer_segment", "region_code"))


@query("metric_completed_orders", f"""WITH {ORDERS} SELECT {_period('month', 'order_date')},
    count(DISTINCT order_id) AS completed_orders FROM my_orders WHERE status IN ('shipped','delivered') GROUP BY ALL""")
def _(lake):
    return M.evaluate(COMPLETED, datasets(lake))


@query("metric_local_variant", f"""WITH a AS (SELECT {_period('month', 'event_date')}, count(DISTINCT customer_id) AS active_30
      FROM commercial_events WHERE event_date BETWEEN date'{AS_OF}' - 30 AND date'{AS_OF}' GROUP BY 1),
    b AS (SELECT {_period('month', 'event_date')}, count(DISTINCT customer_id) AS active_90
      FROM commercial_events WHERE event_date BETWEEN date'{AS_OF}' - 90 AND date'{AS_OF}' GROUP BY 1)
  SELECT period, active_30, active_90, active_30 - active_90 AS delta FROM b LEFT JOIN a USING (period)""", "commercial_events")
def _(lake):
    return M.compare_to_canonical(ACTIVE_30, ACTIVE_90, datasets(lake), "month", as_of=AS_OF)


@query("metric_materialized", f"""WITH {RECOGNIZED} SELECT {_period('month', 'recognition_date')},
    sum(recognized_revenue_usd)::decimal(38,2) AS net_recognized_revenue, '{NET_REVENUE.definition_hash()}' AS definition_hash
  FROM recognized GROUP BY ALL""", REV)
def _(lake):
    path = new_path(lake.spark, "metric")
    M.materialize(M.evaluate(NET_REVENUE, datasets(lake)), NET_REVENUE, path)
    out = M.read_materialized(lake.spark, NET_REVENUE, path)
    return out.withColumn("net_recognized_revenue", F.col("net_recognized_revenue").cast("decimal(38,2)"))
