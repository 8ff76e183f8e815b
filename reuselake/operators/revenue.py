"""Canonical revenue datasets: billable events, currency normalisation, recognised revenue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reuselake.functions.predicates import as_date, flag

MONEY = "decimal(18,2)"


def billable_events(invoices: DataFrame, refunds: DataFrame) -> DataFrame:
    """Invoices and refunds as one signed event stream; nothing is filtered here.

    Works on static and on streaming inputs alike: two projections and a union.
    """

    def events(src, kind, key, planned, actual, status, recognised, amount, event_type):
        return src.select(
            F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("billable_event_id"),
            "customer_id",
            "contract_id",
            "product_id",
            F.col(planned).alias("event_date"),
            F.coalesce(actual, planned).alias("recognition_date"),
            "currency_code",
            amount.cast(MONEY).alias("net_amount"),
            event_type.alias("event_type"),
            F.col(status).alias("event_status"),
            flag(F.col(status) == recognised).alias("is_recognizable"),
            "source_system",
            F.col(key).alias("source_record_id"),
        )

    sales = events(
        invoices, "INVOICE", "invoice_id", "invoice_date", "posted_date", "invoice_status", "POSTED",
        F.col("invoice_amount"), F.lit("INVOICE"),
    )
    returns = events(
        refunds, "REFUND", "refund_id", "refund_date", "approved_date", "refund_status", "APPROVED",
        -F.abs("refund_amount"),
        F.when(F.col("refund_type") == "CREDIT_NOTE", "CREDIT_NOTE").otherwise("REFUND"),
    )
    return sales.unionByName(returns)


def normalize_currency(
    df: DataFrame,
    fx: DataFrame,
    amount: str = "net_amount",
    source: str = "currency_code",
    target: str = "USD",
    on: str = "recognition_date",
    out: str = "amount_usd",
    missing: str = "drop",
    passthrough: bool = True,
    round_to: int | None = 2,
) -> DataFrame:
    """Convert ``amount`` at the rate of its own date.

    ``missing='drop'`` loses rows without a rate, ``missing='null'`` keeps them with a null
    amount. With ``passthrough=False`` even same-currency rows need a row in the rate table.
    The rate table is broadcast by Spark only if its size is below the session's limit.
    """
    if missing not in ("drop", "null"):
        raise ValueError("missing must be 'drop' or 'null'")
    rates = fx.filter(F.col("to_currency") == target).select(
        F.col("from_currency").alias("_fx_from"), F.col("rate_date").alias("_fx_date"),
        F.col("exchange_rate").alias("_fx_rate"),
    )
    strict = missing == "drop" and not passthrough
    joined = df.join(
        rates, (F.col(source) == F.col("_fx_from")) & (F.col(on) == F.col("_fx_date")), "inner" if strict else "left"
    )
    rate: Column = F.col("_fx_rate")
    if passthrough:
        rate = F.when(F.col(source) == target, F.lit(1).cast("decimal(18,8)")).otherwise(rate)
    if missing == "drop":
        joined = joined.filter(rate.isNotNull())
    value = F.col(amount) * rate
    if round_to is not None:
        value = F.round(value, round_to).cast(f"decimal(18,{round_to})")
    return joined.withColumn(out, value).drop("_fx_from", "_fx_date", "_fx_rate")


def recognize_revenue(events: DataFrame, fx: DataFrame, start, end) -> DataFrame:
    """Recognised revenue in USD for recognition dates from ``start`` to ``end``, both included."""
    inside = events.filter(F.col("is_recognizable") & F.col("recognition_date").between(as_date(start), as_date(end)))
    return normalize_currency(inside, fx, out="recognized_revenue_usd").select(
        "customer_id", "billable_event_id", "recognition_date", "event_type",
        F.col("currency_code").alias("source_currency"), "recognized_revenue_usd",
    )


def invoice_revenue(invoices: DataFrame, fx: DataFrame, strict_fx: bool = False) -> DataFrame:
    """The retired invoice-only definition, kept to be compared and flagged."""
    posted = invoices.filter((F.col("invoice_status") == "POSTED") & F.col("invoice_amount").isNotNull())
    usd = normalize_currency(
        posted, fx, amount="invoice_amount", on="invoice_date", out="invoice_revenue_usd", passthrough=not strict_fx
    )
    return usd.select(
        "invoice_id", "customer_id", F.col("invoice_date").alias("revenue_date"), "currency_code", "invoice_revenue_usd"
    )
