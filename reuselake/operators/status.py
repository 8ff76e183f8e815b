"""Customer activity: who is active on which date, by several definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reuselake.functions.predicates import as_date, flag, qualifying, reach, trailing_window

KEY, DAY = "customer_id", "reporting_date"


def calendar_days(calendar: DataFrame, day: str = DAY) -> DataFrame:
    """Distinct reporting dates. A date column has at most 3.7 million values, so this table is
    small whatever the size of the data, and may be broadcast."""
    return calendar.select(F.col(day).cast("date").alias(day)).filter(F.col(day).isNotNull()).distinct()


def on_calendar(df: DataFrame, low: str, high: str, calendar: DataFrame, day: str = DAY) -> DataFrame:
    """One row per row of ``df`` and reporting date in ``[low, high]``.

    A range join without a range operator: both sides meet on the month, an equality, and the
    exact bounds are checked afterwards.
    """
    months = calendar_days(calendar, day).withColumn("_month", F.trunc(day, "month"))
    spread = df.withColumn(
        "_month",
        F.explode(F.sequence(F.trunc(low, "month"), F.trunc(high, "month"), F.expr("interval 1 month"))),
    )
    return (
        spread.join(F.broadcast(months), "_month")
        .filter(F.col(day).between(F.col(low), F.col(high)))
        .drop("_month")
    )


def active_pairs(
    events: DataFrame, calendar: DataFrame, n: int = 90, bounds: str = "closed", date: str = "event_date"
) -> DataFrame:
    """Distinct (customer, reporting date) pairs with an event in the trailing window.

    Events are first reduced to one row per customer and date, so a customer with very many
    events weighs no more than one row per day. Each date then covers the reporting dates up to
    the point where the customer's next date takes over: every pair arises exactly once and needs
    no further ``distinct``.
    """
    lo, hi = reach(n, bounds)
    days = events.select(KEY, F.col(date).cast("date").alias("_d")).filter(
        F.col(KEY).isNotNull() & F.col("_d").isNotNull()
    ).distinct()
    following = F.lead("_d").over(Window.partitionBy(KEY).orderBy("_d"))
    spans = days.select(
        KEY,
        F.date_add("_d", lo).alias("_low"),
        F.least(F.date_add("_d", hi), F.date_add(following, lo - 1)).alias("_high"),
    ).filter("_low <= _high")
    return on_calendar(spans, "_low", "_high", calendar).select(KEY, DAY)


def dense_status(customers: DataFrame, calendar: DataFrame, pairs: DataFrame, out: str) -> DataFrame:
    """Every customer on every reporting date with a true/false flag.

    The pairs travel as one array per customer (never longer than the calendar); the dense rows
    are produced after the only join, so they are never shuffled.
    """
    active = pairs.groupBy(KEY).agg(F.collect_list(DAY).alias("_active"))
    dates = calendar_days(calendar).agg(F.sort_array(F.collect_list(DAY)).alias("_dates")).scalar()
    flagged = lambda days, value: F.transform(days, lambda d: F.struct(d.alias(DAY), F.lit(value).alias(out)))
    return (
        customers.select(KEY).distinct()
        .join(active, KEY, "left")
        .withColumn("_active", F.coalesce("_active", F.array().cast("array<date>")))
        .withColumn("_idle", F.array_except(dates, F.col("_active")))
        .select(KEY, F.inline(F.concat(flagged(F.col("_active"), True), flagged(F.col("_idle"), False))))
    )


def commercial_pairs(events: DataFrame, calendar: DataFrame, n: int = 90, bounds: str = "closed") -> DataFrame:
    return active_pairs(events.filter(qualifying(F.col("event_type"))), calendar, n, bounds)


def commercial_status(customers: DataFrame, calendar: DataFrame, events: DataFrame, n: int = 90) -> DataFrame:
    """Certified activity: a qualifying commercial event in the trailing days."""
    pairs = commercial_pairs(events, calendar, n)
    return dense_status(customers, calendar, pairs, "is_active_commercial_90d")


def billed_pairs(invoices: DataFrame, calendar: DataFrame, n: int = 90, bounds: str = "closed") -> DataFrame:
    posted = invoices.filter(F.col("invoice_status") == "POSTED")
    return active_pairs(posted, calendar, n, bounds, date="invoice_date")


def invoice_calendar(invoices: DataFrame) -> DataFrame:
    return invoices.select(F.col("invoice_date").alias(DAY)).distinct()


def billed_status(customers: DataFrame, invoices: DataFrame, n: int = 90, calendar: DataFrame | None = None) -> DataFrame:
    """Billing as a proxy for activity; reporting dates are the invoice dates unless given."""
    calendar = invoice_calendar(invoices) if calendar is None else calendar
    return dense_status(customers, calendar, billed_pairs(invoices, calendar, n), "is_active_90d")


def active_counts(customers: DataFrame, calendar: DataFrame, pairs: DataFrame) -> DataFrame:
    """Active customers and all customers per reporting date, without the dense grid of both."""
    known = pairs.join(customers.select(KEY).distinct(), KEY, "left_semi").groupBy(DAY).agg(F.count("*").alias("active"))
    everyone = customers.agg(F.count("*").alias("n")).scalar()
    return calendar.select(DAY).distinct().join(known, DAY, "left").select(
        DAY, F.coalesce("active", F.lit(0)).alias("active"), everyone.alias("customers")
    )


def login_active(
    logins: DataFrame, as_of, n: int = 90, cast_date: bool = False, application: str = "Marketing Portal"
) -> DataFrame:
    """Customers with a portal login in the trailing days (see ``trailing_window`` for midnight)."""
    return (
        logins.filter(F.col("application_name") == application)
        .filter(trailing_window(F.col("login_timestamp"), as_of, n, cast_date=cast_date))
        .select(KEY).distinct()
    )


def active_asof(events: DataFrame, as_of, n: int = 90, bounds: str = "closed", date: str = "event_date") -> DataFrame:
    """Distinct customers with a qualifying event in the window of one date."""
    return (
        events.filter(qualifying(F.col("event_type")) & trailing_window(F.col(date), as_of, n, bounds))
        .select(KEY).distinct()
    )


def billed_asof(invoices: DataFrame, as_of, n: int = 90, bounds: str = "closed") -> DataFrame:
    return (
        invoices.filter((F.col("invoice_status") == "POSTED") & trailing_window(F.col("invoice_date"), as_of, n, bounds))
        .select(KEY).distinct()
    )


def order_active_12m(customers: DataFrame, orders: DataFrame, as_of) -> DataFrame:
    """Operational flag: last order up to the as-of date is at most twelve months old."""
    last = (
        orders.filter(F.col("order_date") < F.date_add(as_date(as_of), 1))
        .groupBy(KEY).agg(F.max(F.col("order_date").cast("date")).alias("last_order_date"))
    )
    recent = F.col("last_order_date") >= F.add_months(as_date(as_of), -12)
    return customers.select(KEY).join(last, KEY, "left").withColumn("is_active", flag(recent))


def audience_30d(customers: DataFrame, as_of, n: int = 30, activity: str = "last_activity_date") -> DataFrame:
    """Audience mart: customers with known activity and a flag for the last ``n`` days.

    The test has no upper bound: an activity date after the as-of date counts as active."""
    return customers.filter(F.col(activity).isNotNull()).withColumn(
        "is_active_30d", flag(trailing_window(F.col(activity), as_of, n, "lower_only"))
    )
