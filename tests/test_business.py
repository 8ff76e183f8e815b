from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from reuselake.functions import predicates as P
from reuselake.functions import tvf
from reuselake.operators import arpac as A
from reuselake.operators import metrics as M
from reuselake.operators import revenue as R
from reuselake.operators import status as S
from reuselake.plans.fixtures import Lake
from reuselake.session import new_path
from reuselake.sources.tables import KEYS, read_table

DAY = date(2001, 1, 31)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


@pytest.fixture(scope="module")
def fx(spark):
    return spark.createDataFrame(
        [("EUR", "USD", DAY, D("1.10000000"))], "from_currency string, to_currency string, rate_date date, exchange_rate decimal(18,8)"
    )


@pytest.fixture(scope="module")
def amounts(spark):
    return spark.createDataFrame(
        [(1, D("10.05"), "USD", DAY), (2, D("10.05"), "EUR", DAY), (3, D("10.05"), "GBP", DAY), (4, D("10.05"), "EUR", date(2001, 1, 30))],
        "id int, net_amount decimal(18,2), currency_code string, recognition_date date",
    )


def test_missing_rate_is_dropped_kept_or_needed(amounts, fx):
    pick = lambda **kw: rows(R.normalize_currency(amounts, fx, **kw).select("id", "amount_usd"))
    assert pick() == [(1, D("10.05")), (2, D("11.06"))]
    kept = pick(missing="null", round_to=None)
    assert [i for i, _ in kept] == [1, 2, 3, 4] and [v is None for _, v in kept] == [False, False, True, True]
    assert pick(passthrough=False) == [(2, D("11.06"))]
    with pytest.raises(ValueError):
        R.normalize_currency(amounts, fx, missing="guess")


def test_billable_events_keep_everything(spark):
    inv = spark.createDataFrame([(1, 7, 1, 1, DAY, None, "DRAFT", D("5.00"), "USD", "ERP")], (
        "invoice_id long, customer_id long, contract_id long, product_id long, invoice_date date, posted_date date, "
        "invoice_status string, invoice_amount decimal(18,2), currency_code string, source_system string"))
    ref = spark.createDataFrame([(2, 1, 7, 1, 1, DAY, None, None, D("-3.00"), "USD", None, "ERP")], (
        "refund_id long, invoice_id long, customer_id long, contract_id long, product_id long, refund_date date, approved_date date, "
        "refund_status string, refund_amount decimal(18,2), currency_code string, refund_type string, source_system string"))
    got = rows(R.billable_events(inv, ref).select("billable_event_id", "recognition_date", "net_amount", "event_type", "is_recognizable"))
    assert got == [("INVOICE:1", DAY, D("5.00"), "INVOICE", False), ("REFUND:2", DAY, D("-3.00"), "REFUND", False)]


def test_flag_forms_differ_on_null(spark):
    df = spark.createDataFrame([("shipped",), (None,), ("open",)], "status string")
    assert [r.is_completed for r in P.orders_with_completion_flag(df).collect()] == [True, False, False]
    raw = P.with_boolean_flag(df, "f", F.col("status") == "open", null_as_false=False)
    assert [r.f for r in raw.collect()] == [False, None, True]
    assert P.completed_orders(df).columns == ["status"]


def test_window_edges(spark):
    df = spark.createDataFrame([(i, d) for i, d in enumerate([date(2000, 11, 2), date(2000, 11, 1), date(2000, 11, 3), DAY, date(2001, 2, 1)])], "i int, d date")
    inside = lambda b: {r.i for r in df.filter(P.trailing_window(F.col("d"), DAY, 90, b)).collect()}
    assert inside("closed") == {0, 2, 3} and inside("days") == {2, 3}
    assert inside("half_open") == {0, 2} and inside("next_day") == {0, 2, 3} and inside("lower_only") == {0, 2, 3, 4}
    with pytest.raises(ValueError):
        P.trailing_window(F.col("d"), DAY, 90, "open")


def test_login_later_on_the_day(spark):
    df = spark.createDataFrame([(1, datetime(2001, 1, 31, 9)), (2, datetime(2001, 1, 31))], "customer_id long, login_timestamp timestamp_ntz")
    df = df.withColumn("application_name", F.lit("Marketing Portal"))
    assert rows(S.login_active(df, DAY)) == [(2,)]
    assert rows(S.login_active(df, DAY, cast_date=True)) == [(1,), (2,)]


def test_status_edges_and_idle_customers(spark):
    ev = spark.createDataFrame([(1, date(2000, 11, 2), "paid_invoice"), (2, date(2000, 11, 1), "paid_invoice"), (3, DAY, "quote"), (4, DAY, "committed_order")],
                               "customer_id long, event_date date, event_type string")
    cust = spark.createDataFrame([(i,) for i in range(1, 6)], "customer_id long")
    cal = spark.createDataFrame([(DAY,)], "reporting_date date")
    got = {r.customer_id: r.is_active_commercial_90d for r in S.commercial_status(cust, cal, ev).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False}
    with pytest.raises(ValueError):
        S.active_pairs(ev, cal, bounds="lower_only")


def test_no_active_customers_gives_null_or_zero(spark):
    c = spark.createDataFrame([(D("5.00"), 0)], "net_revenue_usd decimal(38,2), active_customers long")
    assert A.arpac(c).first().arpac_usd is None
    assert A.arpac(c, on_zero=0).first().arpac_usd == 0.0


@pytest.fixture(scope="module")
def lake(spark):
    return Lake(spark, "/root/testdata/sf0.001")


def test_customer_grain_sums_to_components(spark, lake):
    ev = R.billable_events(lake.fact_invoices, lake.fact_refunds)
    args = lake.commercial_events, ev, lake.dim_exchange_rates, "2001-01-31"
    whole, parts = A.arpac_asof(*args).first(), A.arpac_by_customer(*args)
    s = parts.agg(F.sum("net_revenue_usd"), F.count("*")).first()
    assert (whole.net_revenue_usd, whole.active_customers) == (s[0], s[1])
    cal = spark.createDataFrame([(DAY,)], "reporting_date date")
    series = A.arpac_components(S.commercial_pairs(lake.commercial_events, cal), ev, lake.dim_exchange_rates).first()
    assert (series.net_revenue_usd, series.active_customers) == (s[0], s[1])


def test_table_function_equals_dataframe_form(spark, lake):
    ev = R.billable_events(lake.fact_invoices, lake.fact_refunds)
    tvf.register(spark, ev, lake.dim_exchange_rates, lake.commercial_events)
    a = spark.sql("SELECT net_revenue_usd, active_customers, arpac_usd FROM arpac_trailing_90d(date'2001-01-31')").first()
    b = A.arpac(A.arpac_asof(lake.commercial_events, ev, lake.dim_exchange_rates, "2001-01-31")).select(*a.asDict()).first()
    assert tuple(a) == tuple(b)


def test_no_python_in_business_plans(lake):
    ev = R.billable_events(lake.fact_invoices, lake.fact_refunds)
    plan = A.arpac_components(S.commercial_pairs(lake.commercial_events, lake.reporting_calendar), ev, lake.dim_exchange_rates)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Cartesian" not in text


def test_read_table_defaults(spark, lake):
    path = new_path(spark, "t")
    lake.fact_refunds.withColumn("source_system", F.lit(None).cast("string")).write.parquet(path)
    df = read_table(spark, path, "fact_refunds")
    assert [r[0] for r in df.select("source_system").distinct().collect()] == ["ERP"]
    assert KEYS["fact_refunds"] == ["refund_id"]


def test_metric_requests_are_checked():
    m = M.SemanticModel("m", "d", "e", ("id",), "day", dimensions=("a",), measures=(M.Measure("n", "count", "id"),))
    metric = M.Metric("x", "simple", m, measure="n", grains=("month",), dimensions=("a",))
    for grain, dims in (("day", ()), ("month", ("b",))):
        with pytest.raises(ValueError):
            M.check_request(metric, grain, dims)
    with pytest.raises(ValueError):
        M.extend(m, "m2", "d2", ("a",))
    assert M.extend(m, "m2", "d2", ("b",)).dimensions == ("a", "b")


def test_materialized_values_follow_their_definition(spark):
    df = spark.createDataFrame([(1, DAY, "a")], "id int, day date, a string")
    m = M.SemanticModel("m", "d", "e", ("id",), "day", measures=(M.Measure("n", "count", "id"), M.Measure("k", "count_distinct", "id")))
    one, two = M.Metric("x", "simple", m, measure="n"), M.Metric("x", "simple", m, measure="k")
    path = new_path(spark, "metric")
    M.materialize(M.evaluate(one, {"d": df}), one, path)
    assert M.read_materialized(spark, one, path).count() == 1
    assert M.read_materialized(spark, two, path).count() == 0
