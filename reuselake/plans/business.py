"""Queries over the governed revenue and activity datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reuselake.functions import predicates as P
from reuselake.functions import tvf
from reuselake.operators import arpac as A
from reuselake.operators import revenue as R
from reuselake.operators import status as S
from reuselake.plans.catalog import query
from reuselake.plans.fixtures import AS_OF, Lake

D = f"date'{AS_OF}'"

BILLABLE = """
  SELECT 'INVOICE:' || cast(invoice_id AS varchar) AS billable_event_id, customer_id, contract_id, product_id,
    invoice_date AS event_date, coalesce(posted_date, invoice_date) AS recognition_date, currency_code,
    invoice_amount AS net_amount, 'INVOICE' AS event_type, invoice_status AS event_status,
    coalesce(invoice_status = 'POSTED', false) AS is_recognizable, source_system, invoice_id AS source_record_id
  FROM fact_invoices
  UNION ALL
  SELECT 'REFUND:' || cast(refund_id AS varchar), customer_id, contract_id, product_id, refund_date,
    coalesce(approved_date, refund_date), currency_code, cast(-abs(refund_amount) AS decimal(18,2)),
    CASE WHEN refund_type = 'CREDIT_NOTE' THEN 'CREDIT_NOTE' ELSE 'REFUND' END, refund_status,
    coalesce(refund_status = 'APPROVED', false), source_system, refund_id
  FROM fact_refunds"""

RECOGNIZED = f"""billable AS ({BILLABLE}), recognized AS (
  SELECT customer_id, billable_event_id, recognition_date, event_type, currency_code AS source_currency,
    cast(round(net_amount * CASE WHEN currency_code = 'USD' THEN 1 ELSE exchange_rate END, 2) AS decimal(18,2)) AS recognized_revenue_usd
  FROM billable LEFT JOIN dim_exchange_rates ON from_currency = currency_code AND to_currency = 'USD' AND rate_date = recognition_date
  WHERE is_recognizable AND (currency_code = 'USD' OR exchange_rate IS NOT NULL))"""

INV_REV = """inv_rev AS (
  SELECT invoice_id, customer_id, invoice_date AS revenue_date, currency_code,
    cast(round(invoice_amount * exchange_rate, 2) AS decimal(18,2)) AS usd
  FROM fact_invoices JOIN dim_exchange_rates ON from_currency = currency_code AND to_currency = 'USD' AND rate_date = invoice_date
  WHERE invoice_status = 'POSTED')"""

WINDOW = f"BETWEEN {D} - 90 AND {D}"
ACTIVE = f"""active AS (SELECT DISTINCT customer_id FROM commercial_events
  WHERE event_type IN ('paid_invoice','active_subscription','committed_order') AND event_date {WINDOW})"""
FACTS = "fact_invoices fact_refunds"
REV = f"{FACTS} dim_exchange_rates"


def events(lake: Lake) -> DataFrame:
    return R.billable_events(lake.fact_invoices, lake.fact_refunds)


@query("billable_events", BILLABLE, FACTS)
def _(lake):
    return events(lake)


def _fx_sql(rate: str, keep: str, join: str = "LEFT JOIN", value: str | None = None) -> str:
    value = value or f"cast(round(invoice_amount * {rate}, 2) AS decimal(18,2))"
    return f"""SELECT invoice_id, currency_code, {value} AS amount_usd FROM fact_invoices
      {join} dim_exchange_rates ON from_currency = currency_code AND to_currency = 'USD' AND rate_date = invoice_date {keep}"""


def _fx(lake: Lake, **kw) -> DataFrame:
    out = R.normalize_currency(lake.fact_invoices, lake.dim_exchange_rates, amount="invoice_amount", on="invoice_date", **kw)
    return out.select("invoice_id", "currency_code", "amount_usd")


_RATE = "CASE WHEN currency_code = 'USD' THEN 1 ELSE exchange_rate END"


@query("fx_drop", _fx_sql(_RATE, "WHERE currency_code = 'USD' OR exchange_rate IS NOT NULL"), "fact_invoices dim_exchange_rates")
def _(lake):
    return _fx(lake)


@query("fx_null", _fx_sql("", "", value=f"cast(invoice_amount * {_RATE} AS double)"), "fact_invoices dim_exchange_rates")
def _(lake):
    return _fx(lake, missing="null", round_to=None).withColumn("amount_usd", F.col("amount_usd").cast("double"))


@query("fx_strict", _fx_sql("exchange_rate", "", "JOIN"), "fact_invoices dim_exchange_rates")
def _(lake):
    return _fx(lake, passthrough=False)


_RECOGNIZE = f"WITH {RECOGNIZED} SELECT * FROM recognized WHERE recognition_date BETWEEN date'2000-01-01' AND {D}"


@query("recognize_revenue", _RECOGNIZE, REV)
def _(lake):
    return R.recognize_revenue(events(lake), lake.dim_exchange_rates, "2000-01-01", AS_OF)


@query("recognize_revenue_tvf", _RECOGNIZE, REV)
def _(lake):
    tvf.register(lake.spark, events(lake), lake.dim_exchange_rates, lake.commercial_events)
    return lake.spark.sql(f"SELECT * FROM recognize_revenue(date'2000-01-01', {D})")


@query("normalize_currency_tvf", f"""SELECT invoice_id, cast(round(invoice_amount * {_RATE}, 2) AS decimal(18,2)) AS normalized_amount
  FROM fact_invoices LEFT JOIN dim_exchange_rates ON from_currency = currency_code AND to_currency = 'USD' AND rate_date = invoice_date
  WHERE currency_code = 'USD' OR exchange_rate IS NOT NULL""", "fact_invoices dim_exchange_rates")
def _(lake):
    tvf.register(lake.spark, events(lake), lake.dim_exchange_rates, lake.commercial_events)
    return lake.spark.sql(
        "SELECT i.invoice_id, n.normalized_amount FROM {inv} i, "
        "LATERAL normalize_currency(i.invoice_amount, i.currency_code, 'USD', i.invoice_date) n",
        inv=lake.fact_invoices,
    )


@query("invoice_revenue_retired", f"""SELECT invoice_id, customer_id, invoice_date AS revenue_date, currency_code,
    cast(round(invoice_amount * {_RATE}, 2) AS decimal(18,2)) AS invoice_revenue_usd FROM fact_invoices
  LEFT JOIN dim_exchange_rates ON from_currency = currency_code AND to_currency = 'USD' AND rate_date = invoice_date
  WHERE invoice_status = 'POSTED' AND (currency_code = 'USD' OR exchange_rate IS NOT NULL)""", "fact_invoices dim_exchange_rates")
def _(lake):
    return R.invoice_revenue(lake.fact_invoices, lake.dim_exchange_rates)


@query("commercial_status", """SELECT c.customer_id, r.reporting_date,
    coalesce(max(CASE WHEN e.customer_id IS NOT NULL THEN 1 ELSE 0 END), 0) = 1 AS is_active_commercial_90d
  FROM dim_customers c CROSS JOIN reporting_calendar r
  LEFT JOIN commercial_events e ON e.customer_id = c.customer_id AND e.event_date BETWEEN r.reporting_date - 90 AND r.reporting_date
    AND e.event_type IN ('paid_invoice','active_subscription','committed_order')
  GROUP BY c.customer_id, r.reporting_date""", "dim_customers reporting_calendar commercial_events")
def _(lake):
    return S.commercial_status(lake.dim_customers, lake.reporting_calendar, lake.commercial_events)


@query("billed_status", """WITH cal AS (SELECT DISTINCT invoice_date AS reporting_date FROM fact_invoices)
  SELECT r.reporting_date, count(DISTINCT i.customer_id) AS active, (SELECT count(*) FROM dim_customers) AS customers
  FROM cal r LEFT JOIN fact_invoices i ON i.invoice_status = 'POSTED' AND i.invoice_date BETWEEN r.reporting_date - 90 AND r.reporting_date
    AND i.customer_id IN (SELECT customer_id FROM dim_customers)
  GROUP BY r.reporting_date""", "dim_customers fact_invoices")
def _(lake):
    calendar = S.invoice_calendar(lake.fact_invoices)
    return S.active_counts(lake.dim_customers, calendar, S.billed_pairs(lake.fact_invoices, calendar))


_LOGIN = """SELECT DISTINCT customer_id FROM customer_logins WHERE application_name = 'Marketing Portal'
  AND {ts} >= date'2001-01-20' - 90 AND {ts} <= date'2001-01-20'"""


@query("login_active_midnight", _LOGIN.format(ts="login_timestamp"), "customer_logins")
def _(lake):
    return S.login_active(lake.customer_logins, "2001-01-20")


@query("login_active_cast", _LOGIN.format(ts="cast(login_timestamp AS date)"), "customer_logins")
def _(lake):
    return S.login_active(lake.customer_logins, "2001-01-20", cast_date=True)


def _orders(lake: Lake) -> DataFrame:
    return lake.orders.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("order_date"),
        F.when(F.col("o_orderstatus") == "F", "delivered").when(F.col("o_orderstatus") == "P", "shipped")
        .when(F.col("o_orderpriority") != "1-URGENT", "open").alias("status"),
    )


ORDERS = """my_orders AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date,
  CASE WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_orderstatus = 'P' THEN 'shipped'
       WHEN o_orderpriority <> '1-URGENT' THEN 'open' END AS status FROM orders)"""


@query("order_active_12m", f"""SELECT c_custkey AS customer_id, last_order_date,
    coalesce(last_order_date >= {D} - interval 12 month, false) AS is_active FROM customer
  LEFT JOIN (SELECT o_custkey, max(cast(o_orderdate AS date)) AS last_order_date FROM orders
             WHERE cast(o_orderdate AS date) <= {D} GROUP BY 1) o ON o_custkey = c_custkey""")
def _(lake):
    customers = lake.customer.select(F.col("c_custkey").alias("customer_id"))
    return S.order_active_12m(customers, _orders(lake), AS_OF)


@query("audience_30d", f"""SELECT customer_id, customer_segment, region_code, last_order_date AS last_activity_date,
    last_order_date >= {D} - 30 AS is_active_30d FROM dim_customers WHERE last_order_date IS NOT NULL""", "dim_customers")
def _(lake):
    c = lake.dim_customers.withColumnRenamed("last_order_date", "last_activity_date")
    return S.audience_30d(c, AS_OF).select(
        "customer_id", "customer_segment", "region_code", "last_activity_date", "is_active_30d"
    )


@query("orders_with_flag", f"WITH {ORDERS} SELECT *, coalesce(status IN ('shipped','delivered'), false) AS is_completed FROM my_orders")
def _(lake):
    return P.orders_with_completion_flag(_orders(lake))


@query("flag_null_kept", f"WITH {ORDERS} SELECT *, status IN ('shipped','delivered') AS is_completed FROM my_orders")
def _(lake):
    return P.with_boolean_flag(
        _orders(lake), "is_completed", F.col("status").isin(*P.COMPLETED_STATUSES), null_as_false=False
    )


@query("completed_orders", f"WITH {ORDERS} SELECT * FROM my_orders WHERE status IN ('shipped','delivered')")
def _(lake):
    return P.completed_orders(_orders(lake))


@query("contract_projection", """SELECT cast(customer_id AS varchar) AS customer_id, customer_segment, region_code AS region,
    last_order_date AS last_activity_date FROM dim_customers""", "dim_customers")
def _(lake):
    return P.select_contract(lake.dim_customers, [
        ("customer_id", "string", "customer_id"), ("customer_segment", "string", "customer_segment"),
        ("region_code", "string", "region"), ("last_order_date", "date", "last_activity_date"),
    ])


@query("window_bounds", f"""SELECT count(CASE WHEN invoice_date {WINDOW} THEN 1 END) AS closed,
    count(CASE WHEN invoice_date BETWEEN {D} - 89 AND {D} THEN 1 END) AS days,
    count(CASE WHEN invoice_date >= {D} - 90 AND invoice_date < {D} THEN 1 END) AS half_open,
    count(CASE WHEN invoice_date >= {D} - 90 AND invoice_date < {D} + 1 THEN 1 END) AS next_day,
    count(CASE WHEN invoice_date >= {D} - 90 THEN 1 END) AS lower_only FROM fact_invoices""", "fact_invoices")
def _(lake):
    day = F.col("invoice_date")
    return lake.fact_invoices.agg(*[F.count_if(P.trailing_window(day, AS_OF, 90, b)).alias(b) for b in P.BOUNDS])


# -- average revenue per active customer ----------------------------------------------------------

_RATIO = "cast(net_revenue_usd AS double) / nullif(active_customers, 0) AS arpac_usd"


@query("arpac_asof", f"""WITH {RECOGNIZED}, {ACTIVE}, c AS (
  SELECT (SELECT cast(coalesce(sum(recognized_revenue_usd), 0) AS decimal(38,2)) FROM recognized
          WHERE recognition_date {WINDOW} AND customer_id IN (SELECT customer_id FROM active)) AS net_revenue_usd,
         (SELECT count(*) FROM active) AS active_customers, {D} AS reporting_date)
  SELECT *, {_RATIO} FROM c""", f"{REV} commercial_events")
def arpac_asof(lake):
    return A.arpac(A.arpac_asof(lake.commercial_events, events(lake), lake.dim_exchange_rates, AS_OF))


_SERIES = f"""WITH {RECOGNIZED}, pairs AS (
    SELECT DISTINCT customer_id, reporting_date FROM commercial_events
    JOIN reporting_calendar ON event_date BETWEEN reporting_date - 90 AND reporting_date
    WHERE event_type IN ('paid_invoice','active_subscription','committed_order')),
  per AS (SELECT p.customer_id, p.reporting_date, coalesce(sum(recognized_revenue_usd), 0) AS net FROM pairs p
    LEFT JOIN recognized r ON r.customer_id = p.customer_id
      AND r.recognition_date BETWEEN p.reporting_date - {{lo}} AND p.reporting_date GROUP BY 1, 2),
  c AS (SELECT reporting_date, cast(sum(net) AS decimal(38,2)) AS net_revenue_usd, count(*) AS active_customers FROM per GROUP BY 1)"""
_SERIES_VIEWS = f"{REV} commercial_events reporting_calendar"


def _pairs(lake: Lake) -> DataFrame:
    return S.commercial_pairs(lake.commercial_events, lake.reporting_calendar)


@query("arpac_components", _SERIES.format(lo=90) + " SELECT * FROM c", _SERIES_VIEWS)
def _(lake):
    return A.arpac_components(_pairs(lake), events(lake), lake.dim_exchange_rates, calendar=lake.reporting_calendar)


@query("arpac_components_days", _SERIES.format(lo=89) + " SELECT * FROM c", _SERIES_VIEWS)
def _(lake):
    return A.arpac_components(_pairs(lake), events(lake), lake.dim_exchange_rates, calendar=lake.reporting_calendar, bounds="days")


@query("arpac_components_by_customer",
       _SERIES.format(lo=90) + " SELECT customer_id, reporting_date, cast(net AS decimal(38,2)) AS net_revenue_usd FROM per", _SERIES_VIEWS)
def _(lake):
    return A.arpac_components(_pairs(lake), events(lake), lake.dim_exchange_rates, calendar=lake.reporting_calendar, by_customer=True)


@query("arpac_series", _SERIES.format(lo=90) + f" SELECT *, {_RATIO} FROM c", _SERIES_VIEWS)
def _(lake):
    return A.arpac(A.arpac_components(_pairs(lake), events(lake), lake.dim_exchange_rates, calendar=lake.reporting_calendar))


@query("arpac_by_customer", f"""WITH {RECOGNIZED}, {ACTIVE} SELECT a.customer_id,
    cast(coalesce(sum(recognized_revenue_usd), 0) AS decimal(38,2)) AS net_revenue_usd
  FROM active a LEFT JOIN recognized r ON r.customer_id = a.customer_id AND recognition_date {WINDOW} GROUP BY 1""",
       f"{REV} commercial_events")
def _(lake):
    return A.arpac_by_customer(lake.commercial_events, events(lake), lake.dim_exchange_rates, AS_OF)


def _base_sql(day: str) -> str:
    return f"""SELECT cast((SELECT coalesce(sum(invoice_amount), 0) FROM fact_invoices WHERE invoice_status = 'POSTED'
        AND currency_code = 'USD' AND invoice_date >= {D} - 90 AND invoice_date < {D}
        AND customer_id IN (SELECT customer_id FROM dim_customers WHERE is_active))
      - (SELECT coalesce(sum(r.refund_amount), 0) FROM fact_refunds r JOIN fact_invoices i ON r.invoice_id = i.invoice_id
         WHERE r.refund_status = 'APPROVED' AND r.currency_code = 'USD' AND {day} >= {D} - 90 AND {day} < {D}
         AND i.customer_id IN (SELECT customer_id FROM dim_customers WHERE is_active)) AS decimal(38,2)) AS net_revenue_usd,
      (SELECT count(*) FROM dim_customers WHERE is_active) AS active_customers"""


@query("variant_base_tables", _base_sql("r.refund_date"), f"{FACTS} dim_customers")
def _(lake):
    return A.base_table_variant(lake.dim_customers, lake.fact_invoices, lake.fact_refunds, AS_OF)


@query("variant_base_tables_invoice_dated", _base_sql("i.invoice_date"), f"{FACTS} dim_customers")
def _(lake):
    return A.base_table_variant(lake.dim_customers, lake.fact_invoices, lake.fact_refunds, AS_OF, refund_date="invoice")


BACK = """back AS (SELECT invoice_id, customer_id, refund_date, cast(round(refund_amount * exchange_rate, 2) AS decimal(18,2)) AS usd
  FROM fact_refunds JOIN dim_exchange_rates ON from_currency = currency_code AND to_currency = 'USD' AND rate_date = refund_date
  WHERE refund_status = 'APPROVED')"""
_LOGINS = f"""act AS (SELECT DISTINCT customer_id FROM customer_logins WHERE application_name = 'Marketing Portal'
  AND login_timestamp >= {D} - 90 AND login_timestamp <= {D})"""
_BILLED = f"act AS (SELECT DISTINCT customer_id FROM fact_invoices WHERE invoice_status = 'POSTED' AND invoice_date {WINDOW})"


def _logins(lake: Lake) -> DataFrame:
    return S.login_active(lake.customer_logins, AS_OF)


def _domain(lake: Lake, active: DataFrame, **kw) -> DataFrame:
    return A.invoice_less_refunds_variant(
        lake.fact_invoices, lake.fact_refunds, lake.dim_exchange_rates, active, AS_OF, **kw
    )


def _domain_sql(act: str, inside: str = "") -> str:
    return f"""WITH {INV_REV}, {BACK}, {act} SELECT cast(
      (SELECT coalesce(sum(usd), 0) FROM inv_rev WHERE revenue_date {WINDOW} {inside})
      - (SELECT coalesce(sum(usd), 0) FROM back WHERE refund_date {WINDOW} {inside}) AS decimal(38,2)) AS net_revenue_usd,
      (SELECT count(*) FROM act) AS active_customers"""


_DOMAIN_VIEWS = f"{REV} customer_logins"
_IN = "AND customer_id IN (SELECT customer_id FROM act)"


@query("variant_domain_code", _domain_sql(_LOGINS), _DOMAIN_VIEWS)
def _(lake):
    return _domain(lake, _logins(lake))


@query("variant_domain_code_restricted", _domain_sql(_LOGINS, _IN), _DOMAIN_VIEWS)
def _(lake):
    return _domain(lake, _logins(lake), restrict=True)


@query("variant_domain_code_billed", _domain_sql(_BILLED, _IN), REV)
def _(lake):
    return _domain(lake, S.billed_asof(lake.fact_invoices, AS_OF), restrict=True)


@query("variant_domain_code_per_invoice", f"""WITH {INV_REV}, {BACK}, {_BILLED} SELECT cast(coalesce(sum(v.usd), 0)
    - coalesce(sum(b.usd), 0) AS decimal(38,2)) AS net_revenue_usd, (SELECT count(*) FROM act) AS active_customers
  FROM inv_rev v LEFT JOIN (SELECT invoice_id, sum(usd) AS usd FROM back GROUP BY 1) b ON b.invoice_id = v.invoice_id
  WHERE revenue_date {WINDOW} AND v.customer_id IN (SELECT customer_id FROM act)""", REV)
def _(lake):
    return _domain(lake, S.billed_asof(lake.fact_invoices, AS_OF), restrict=True, refunds_of="invoices")


_ALL_CODE = f"""WITH {RECOGNIZED}, {_BILLED} SELECT cast(coalesce(sum(recognized_revenue_usd), 0) AS decimal(38,2)) AS net_revenue_usd,
  (SELECT count(*) FROM act) AS active_customers FROM recognized
  WHERE recognition_date {WINDOW} AND customer_id IN (SELECT customer_id FROM act)"""


@query("variant_all_code", _ALL_CODE, REV)
def _(lake):
    return A.billed_proxy_variant(lake.dim_customers, lake.fact_invoices, events(lake), lake.dim_exchange_rates, AS_OF)


@query("variant_all_code_series", _SERIES.format(lo=90).replace("commercial_events", "fact_invoices")
       .replace("event_date", "invoice_date")
       .replace("event_type IN ('paid_invoice','active_subscription','committed_order')", "invoice_status = 'POSTED'")
       .replace(BILLABLE.replace("event_date", "invoice_date"), BILLABLE) + " SELECT * FROM c", f"{REV} reporting_calendar")
def _(lake):
    pairs = S.billed_pairs(lake.fact_invoices, lake.reporting_calendar)
    return A.arpac_components(pairs, events(lake), lake.dim_exchange_rates, calendar=lake.reporting_calendar)


_OVER = f"""WITH {RECOGNIZED}, {ACTIVE}, {_BILLED}, lo AS (SELECT DISTINCT customer_id FROM customer_logins
   WHERE application_name = 'Marketing Portal' AND login_timestamp >= {D} - 90 AND login_timestamp <= {D}),
  {INV_REV}, {BACK}, v AS (
  SELECT 'certified' AS definition, (SELECT coalesce(sum(recognized_revenue_usd), 0) FROM recognized WHERE recognition_date {WINDOW}
    AND customer_id IN (SELECT customer_id FROM active)) AS net, (SELECT count(*) FROM active) AS active_customers
  UNION ALL SELECT 'billed_proxy', (SELECT coalesce(sum(recognized_revenue_usd), 0) FROM recognized WHERE recognition_date {WINDOW}
    AND customer_id IN (SELECT customer_id FROM act)), (SELECT count(*) FROM act)
  UNION ALL SELECT 'login_proxy', (SELECT coalesce(sum(usd), 0) FROM inv_rev WHERE revenue_date {WINDOW})
    - (SELECT coalesce(sum(usd), 0) FROM back WHERE refund_date {WINDOW}), (SELECT count(*) FROM lo)
  UNION ALL SELECT 'order_flag', x.net_revenue_usd, x.active_customers FROM ({_base_sql('r.refund_date')}) x),
  r AS (SELECT definition, cast(net AS decimal(38,2)) AS net_revenue_usd, active_customers,
    cast(net AS double) / nullif(active_customers, 0) AS arpac_usd FROM v)
  SELECT *, arpac_usd - (SELECT arpac_usd FROM r WHERE definition = 'certified') AS delta_to_certified FROM r"""


@query("divergence", _OVER, f"{REV} commercial_events customer_logins dim_customers")
def _(lake):
    ev, fx = events(lake), lake.dim_exchange_rates
    return A.divergence({
        "certified": A.arpac_asof(lake.commercial_events, ev, fx, AS_OF),
        "billed_proxy": A.billed_proxy_variant(lake.dim_customers, lake.fact_invoices, ev, fx, AS_OF),
        "login_proxy": _domain(lake, _logins(lake)),
        "order_flag": A.base_table_variant(lake.dim_customers, lake.fact_invoices, lake.fact_refunds, AS_OF),
    }, certified="certified")


@query("active_overlap", f"""WITH {ACTIVE}, {_BILLED}, {_LOGINS.replace('act AS', 'lo AS')},
  u AS (SELECT customer_id FROM active UNION SELECT customer_id FROM act UNION SELECT customer_id FROM lo
        UNION SELECT customer_id FROM dim_customers WHERE is_active)
  SELECT customer_id IN (SELECT customer_id FROM active) AS certified, customer_id IN (SELECT customer_id FROM act) AS billed,
    customer_id IN (SELECT customer_id FROM lo) AS login,
    customer_id IN (SELECT customer_id FROM dim_customers WHERE is_active) AS order_flag, count(*) AS customers
  FROM u GROUP BY 1, 2, 3, 4""", "fact_invoices commercial_events customer_logins dim_customers")
def _(lake):
    return A.active_overlap({
        "certified": S.active_asof(lake.commercial_events, AS_OF), "billed": S.billed_asof(lake.fact_invoices, AS_OF),
        "login": _logins(lake), "order_flag": lake.dim_customers.filter("is_active"),
    })
