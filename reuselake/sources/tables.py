"""Typed warehouse tables and activity feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: declared schemas and column defaults
SCHEMAS = {
    "dim_customers": "customer_id bigint not null, customer_name string, region_code string, last_order_date date, is_active boolean",
    "fact_invoices": (
        "invoice_id bigint not null, customer_id bigint not null, contract_id bigint, product_id bigint, "
        "invoice_date date not null, posted_date date, invoice_status string not null, invoice_amount decimal(18,2) not null, "
        "currency_code string not null, source_system string not null"
    ),
    "fact_refunds": (
        "refund_id bigint not null, invoice_id bigint, customer_id bigint not null, contract_id bigint, product_id bigint, "
        "refund_date date not null, approved_date date, refund_status string not null, refund_amount decimal(18,2) not null, "
        "currency_code string not null, refund_type string not null, source_system string not null"
    ),
    "dim_exchange_rates": (
        "from_currency string not null, to_currency string not null, rate_date date not null, "
        "exchange_rate decimal(18,8) not null, rate_source string"
    ),
    "observed": (
        "physical_ref string, owner_hint string, observed_type string, concept string, status string, "
        "related_canonical string, note string"
    ),
    "activity": (
        "event_id bigint, event_ts timestamp, source_system string, consumer_type string, tag string, "
        "session_user string, physical_ref string"
    ),
}
DEFAULTS = {
    "fact_invoices": {"source_system": "ERP"},
    "fact_refunds": {"source_system": "ERP", "refund_type": "REFUND"},
}
KEYS = {
    "dim_customers": ["customer_id"], "fact_invoices": ["invoice_id"], "fact_refunds": ["refund_id"],
    "dim_exchange_rates": ["from_currency", "to_currency", "rate_date"],
}


def read_table(spark: SparkSession, path: str, name: str, format: str = "parquet") -> DataFrame:
    """A declared table with its schema and defaults; the declared keys are checked by
    :func:`reuselake.operators.governance.grain_violations`, not on reading."""
    df = spark.read.format(format).schema(SCHEMAS[name]).load(path)
    return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.get(name, {}).items()})


def read_observed(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    return spark.read.format(format).schema(SCHEMAS["observed"]).load(path)


def read_activity(spark: SparkSession, path: str, streaming: bool = False, format: str = "parquet", **options) -> DataFrame:
    """Query log, dashboard and semantic-layer events, as a batch or as a stream of files."""
    reader = spark.readStream if streaming else spark.read
    return reader.format(format).schema(SCHEMAS["activity"]).options(**options).load(path)
