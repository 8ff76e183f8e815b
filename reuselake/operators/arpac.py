"""Average revenue per active customer: components, ratio, and its divergent variants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reuselake.functions.predicates import as_date, reach, safe_div, trailing_window, usd_only
from reuselake.operators.revenue import invoice_revenue, normalize_currency, recognize_revenue
from reuselake.operators.status import DAY, KEY, active_asof, billed_asof

TOTAL = "decimal(38,2)"


def one_row(*parts: DataFrame) -> DataFrame:
    """Merge one-row aggregates into one row, without joining them."""
    tall = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return tall.agg(*[F.max(c).alias(c) for c in tall.columns])


def total(df: DataFrame, amount: str, out: str) -> DataFrame:
    return df.agg(F.coalesce(F.sum(amount), F.lit(0)).cast(TOTAL).alias(out))


def headcount(df: DataFrame, out: str = "active_customers") -> DataFrame:
    return df.agg(F.count(KEY).alias(out))


def recognized_window(events: DataFrame, fx: DataFrame, as_of, n: int, bounds: str) -> DataFrame:
    d = as_date(as_of)
    lo, hi = reach(n, bounds)
    return recognize_revenue(events, fx, F.date_sub(d, hi), F.date_sub(d, lo))


def arpac_components(
    pairs: DataFrame, events: DataFrame, fx: DataFrame, n: int = 90, bounds: str = "closed", by_customer: bool = False,
    calendar: DataFrame | None = None,
) -> DataFrame:
    """Net revenue of the active customers and their number, per reporting date.

    ``pairs`` holds the active (customer, reporting date) rows. The sum over a trailing window is
    the difference of two running totals, so each pair adds two probe rows to its customer's
    daily revenue, one running sum answers them all, and no row is copied per window day.
    Customers without revenue count in the denominator. ``calendar`` (the reporting dates) only
    spares revenue that no window can reach; the result is the same without it.
    """
    lo, hi = reach(n, bounds)
    reachable = ("0001-01-01", "9999-12-31")
    if calendar is not None:
        span = calendar.agg(F.struct(F.min(DAY).alias("lo"), F.max(DAY).alias("hi"))).scalar()
        reachable = (F.date_sub(span["lo"], hi), F.date_sub(span["hi"], lo))
    revenue = (
        recognize_revenue(events, fx, *reachable)
        .groupBy(KEY, F.col("recognition_date").alias("_day"))
        .agg(F.sum("recognized_revenue_usd").cast(TOTAL).alias("_amount"))
    )
    probes = pairs.select(
        KEY, DAY,
        F.inline(F.array(
            F.struct(F.date_sub(DAY, lo).alias("_day"), F.lit(1).alias("_sign")),
            F.struct(F.date_sub(DAY, hi + 1).alias("_day"), F.lit(-1).alias("_sign")),
        )),
    )
    running = Window.partitionBy(KEY).orderBy("_day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    answered = (
        revenue.unionByName(probes, allowMissingColumns=True)
        .withColumn("_total", F.coalesce(F.sum("_amount").over(running), F.lit(0)).cast(TOTAL))
        .filter(F.col("_sign").isNotNull())
    )
    net = F.sum(F.when(F.col("_sign") == 1, F.col("_total")).otherwise(-F.col("_total"))).cast(TOTAL)
    keys = [KEY, DAY] if by_customer else [DAY]
    aggs = [net.alias("net_revenue_usd")]
    if not by_customer:
        aggs.append(F.count_if(F.col("_sign") == 1).alias("active_customers"))
    return answered.groupBy(*keys).agg(*aggs)


def arpac_asof(
    commercial: DataFrame, events: DataFrame, fx: DataFrame, as_of, n: int = 90, bounds: str = "closed"
) -> DataFrame:
    """Components of one date: revenue of active customers only, and how many they are."""
    active = active_asof(commercial, as_of, n, bounds)
    revenue = recognized_window(events, fx, as_of, n, bounds).join(active, KEY, "left_semi")
    return one_row(total(revenue, "recognized_revenue_usd", "net_revenue_usd"), headcount(active)).withColumn(
        DAY, as_date(as_of)
    )


def arpac_by_customer(
    commercial: DataFrame, events: DataFrame, fx: DataFrame, as_of, n: int = 90, bounds: str = "closed"
) -> DataFrame:
    """One row per active customer, zero where nothing was recognised."""
    active = active_asof(commercial, as_of, n, bounds)
    revenue = recognized_window(events, fx, as_of, n, bounds).groupBy(KEY).agg(
        F.sum("recognized_revenue_usd").alias("_net")
    )
    return active.join(revenue, KEY, "left").select(
        KEY, F.coalesce("_net", F.lit(0)).cast(TOTAL).alias("net_revenue_usd")
    )


def arpac(components: DataFrame, on_zero=None) -> DataFrame:
    return components.withColumn("arpac_usd", safe_div(F.col("net_revenue_usd"), F.col("active_customers"), on_zero))


# -- variants seen for the same request ---------------------------------------------------------


def base_table_variant(
    customers: DataFrame, invoices: DataFrame, refunds: DataFrame, as_of, n: int = 90, bounds: str = "half_open",
    refund_date: str = "refund",
) -> DataFrame:
    """Raw invoices less refunds in USD for customers flagged active; no currency conversion.

    Refunds reach their customer through the invoice, and are dated by their own date or by the
    invoice's (``refund_date='invoice'``).
    """
    if refund_date not in ("refund", "invoice"):
        raise ValueError("refund_date must be 'refund' or 'invoice'")
    active = customers.filter("is_active").select(KEY).distinct()
    billed = usd_only(
        invoices.filter((F.col("invoice_status") == "POSTED") & trailing_window(F.col("invoice_date"), as_of, n, bounds))
    ).join(active, KEY, "left_semi")
    returned = (
        usd_only(refunds.filter(F.col("refund_status") == "APPROVED")).drop(KEY)
        .join(invoices.select("invoice_id", KEY, "invoice_date"), "invoice_id")
        .filter(trailing_window(F.col(f"{refund_date}_date"), as_of, n, bounds))
        .join(active, KEY, "left_semi")
    )
    return _net(total(billed, "invoice_amount", "gross_usd"), total(returned, "refund_amount", "refunds_usd"), headcount(active))


def _net(*parts: DataFrame) -> DataFrame:
    return one_row(*parts).select(
        (F.col("gross_usd") - F.col("refunds_usd")).cast(TOTAL).alias("net_revenue_usd"), "active_customers"
    )


def invoice_less_refunds_variant(
    invoices: DataFrame, refunds: DataFrame, fx: DataFrame, active: DataFrame, as_of, n: int = 90,
    bounds: str = "closed", restrict: bool = False, refunds_of: str = "window",
) -> DataFrame:
    """Retired invoice revenue minus converted refunds over a given set of active customers.

    ``restrict`` keeps revenue of active customers only. ``refunds_of='window'`` takes refunds by
    their own date; ``'invoices'`` takes all refunds of the window's invoices, summed per
    invoice before they meet it so that no invoice is counted twice.
    """
    if refunds_of not in ("window", "invoices"):
        raise ValueError("refunds_of must be 'window' or 'invoices'")
    gross = invoice_revenue(invoices, fx, strict_fx=True).filter(
        trailing_window(F.col("revenue_date"), as_of, n, bounds)
    )
    usd = normalize_currency(
        refunds.filter(F.col("refund_status") == "APPROVED"), fx, amount="refund_amount", on="refund_date",
        out="refund_usd", passthrough=False,
    )
    if restrict:
        gross = gross.join(active, KEY, "left_semi")
    if refunds_of == "window":
        back = usd.filter(trailing_window(F.col("refund_date"), as_of, n, bounds))
        if restrict:
            back = back.join(active, KEY, "left_semi")
        parts = total(gross, "invoice_revenue_usd", "gross_usd"), total(back, "refund_usd", "refunds_usd")
    else:
        per_invoice = usd.groupBy("invoice_id").agg(F.sum("refund_usd").alias("refund_usd"))
        both = gross.join(per_invoice, "invoice_id", "left").agg(
            F.coalesce(F.sum("invoice_revenue_usd"), F.lit(0)).cast(TOTAL).alias("gross_usd"),
            F.coalesce(F.sum("refund_usd"), F.lit(0)).cast(TOTAL).alias("refunds_usd"),
        )
        parts = (both,)
    return _net(*parts, headcount(active))


def billed_proxy_variant(
    customers: DataFrame, invoices: DataFrame, events: DataFrame, fx: DataFrame, as_of, n: int = 90, bounds: str = "closed"
) -> DataFrame:
    """Certified revenue over customers who were merely billed in the window."""
    active = billed_asof(invoices, as_of, n, bounds).join(customers.select(KEY), KEY, "left_semi")
    revenue = recognized_window(events, fx, as_of, n, bounds).join(active, KEY, "left_semi")
    return one_row(total(revenue, "recognized_revenue_usd", "net_revenue_usd"), headcount(active))


def divergence(variants: dict[str, DataFrame], certified: str) -> DataFrame:
    """One row per definition with its distance to the certified one."""
    rows = [
        arpac(df).select(
            F.lit(name).alias("definition"), F.col("net_revenue_usd").cast(TOTAL).alias("net_revenue_usd"),
            F.col("active_customers").cast("long").alias("active_customers"), "arpac_usd",
        )
        for name, df in variants.items()
    ]
    table = reduce(DataFrame.unionByName, rows)
    # one row per definition: the frame over all of them is tiny by construction
    ref = F.max(F.when(F.col("definition") == certified, F.col("arpac_usd"))).over(Window.partitionBy(F.lit(1)))
    return table.withColumn("delta_to_certified", F.col("arpac_usd") - ref)


def active_overlap(sets: dict[str, DataFrame]) -> DataFrame:
    """How many customers each combination of definitions calls active."""
    tall = reduce(
        DataFrame.unionByName, [df.select(KEY, F.lit(name).alias("_set")) for name, df in sets.items()]
    )
    member = tall.groupBy(KEY).agg(*[F.bool_or(F.col("_set") == n).alias(n) for n in sets])
    return member.groupBy(*sets).agg(F.count("*").alias("customers"))
