"""SQL façade: the governed rules as table functions for users who write SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reuselake.functions.predicates import QUALIFYING_EVENTS


def register(spark: SparkSession, events: DataFrame, fx: DataFrame, commercial: DataFrame | None = None) -> None:
    """Create temporary table functions over the given datasets.

    ``normalize_currency(amount, source, target, on)`` · ``recognize_revenue(first, last)`` ·
    ``arpac_trailing_90d(as_of)`` (when ``commercial`` events are given).
    """
    events.createOrReplaceTempView("rl_billable_events")
    fx.createOrReplaceTempView("rl_exchange_rates")
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION normalize_currency(
            amount DECIMAL(18,2), source STRING, target STRING, conversion_date DATE)
        RETURNS TABLE (normalized_amount DECIMAL(18,2))
        RETURN SELECT CAST(amount AS DECIMAL(18,2)) WHERE source = target
          UNION ALL SELECT CAST(ROUND(amount * exchange_rate, 2) AS DECIMAL(18,2)) FROM rl_exchange_rates
          WHERE source <> target AND from_currency = source AND to_currency = target AND rate_date = conversion_date""")
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION recognize_revenue(first_day DATE, last_day DATE)
        RETURNS TABLE (customer_id BIGINT, billable_event_id STRING, recognition_date DATE, event_type STRING,
                       source_currency STRING, recognized_revenue_usd DECIMAL(18,2))
        RETURN SELECT customer_id, billable_event_id, recognition_date, event_type, currency_code,
                 CAST(ROUND(net_amount * IF(currency_code = 'USD', CAST(1 AS DECIMAL(18,8)), exchange_rate), 2) AS DECIMAL(18,2))
        FROM rl_billable_events LEFT JOIN (SELECT * FROM rl_exchange_rates WHERE to_currency = 'USD')
          ON from_currency = currency_code AND rate_date = recognition_date
        WHERE is_recognizable AND recognition_date BETWEEN first_day AND last_day
          AND (currency_code = 'USD' OR exchange_rate IS NOT NULL)""")
    if commercial is None:
        return
    commercial.createOrReplaceTempView("rl_commercial_events")
    kinds = ", ".join(f"'{k}'" for k in QUALIFYING_EVENTS)
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION arpac_trailing_90d(as_of DATE)
        RETURNS TABLE (reporting_date DATE, net_revenue_usd DECIMAL(38,2), active_customers BIGINT, arpac_usd DOUBLE)
        RETURN WITH active AS (
            SELECT DISTINCT customer_id FROM rl_commercial_events
            WHERE event_type IN ({kinds}) AND event_date BETWEEN date_sub(as_of, 90) AND as_of),
          parts AS (
            SELECT recognized_revenue_usd AS net, 0 AS head FROM recognize_revenue(date_sub(as_of, 90), as_of)
            WHERE customer_id IN (SELECT customer_id FROM active)
            UNION ALL SELECT 0, 1 FROM active)
        SELECT as_of, net, head, CAST(net AS DOUBLE) / nullif(head, 0) FROM (
          SELECT CAST(coalesce(sum(net), 0) AS DECIMAL(38,2)) AS net, coalesce(sum(head), 0) AS head FROM parts)""")
