"""Column predicates and small column builders shared by all datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: order states that count as completed, event types that make a customer active
COMPLETED_STATUSES = ("shipped", "delivered")
QUALIFYING_EVENTS = ("paid_invoice", "active_subscription", "committed_order")

BOUNDS = ("closed", "days", "half_open", "next_day", "lower_only")


def as_date(value) -> Column:
    """A date column from a column, a ``date`` or an ISO text."""
    return value if isinstance(value, Column) else F.lit(value).cast("date")


def with_boolean_flag(
    df: DataFrame, name: str, cond: Column, true=True, false=False, null_as_false: bool = True
) -> DataFrame:
    """Flag column. The default maps an unknown condition to ``false``; with
    ``null_as_false=False`` the condition itself is kept, nulls included."""
    return df.withColumn(name, flag(cond, true, false) if null_as_false else cond)


def flag(cond: Column, true=True, false=False) -> Column:
    return F.when(cond, F.lit(true)).otherwise(F.lit(false))


def orders_with_completion_flag(
    orders: DataFrame, status: str = "status", completed=COMPLETED_STATUSES
) -> DataFrame:
    return with_boolean_flag(orders, "is_completed", F.col(status).isin(*completed))


def completed_orders(orders: DataFrame, status: str = "status", completed=COMPLETED_STATUSES) -> DataFrame:
    return orders_with_completion_flag(orders, status, completed).filter("is_completed").drop("is_completed")


def reach(n: int, bounds: str) -> tuple[int, int]:
    """Days after an event at which a reporting date starts and stops seeing it."""
    if bounds in ("closed", "next_day"):
        return 0, n
    if bounds == "days":
        return 0, n - 1
    if bounds == "half_open":
        return 1, n
    raise ValueError(f"bounds {bounds!r} has no upper limit or is unknown; choose from {BOUNDS}")


def trailing_window(c: Column, as_of, n: int, bounds: str = "closed", cast_date: bool = False) -> Column:
    """``c`` lies in the trailing ``n`` days of ``as_of``.

    A timestamp compared with a date means midnight, so hours of the as-of day fall outside
    unless ``cast_date`` drops the time of day first.
    """
    if cast_date:
        c = c.cast("date")
    d = as_date(as_of)
    low = F.date_sub(d, n)
    if bounds == "closed":
        return (c >= low) & (c <= d)
    if bounds == "days":
        return (c >= F.date_sub(d, n - 1)) & (c <= d)
    if bounds == "half_open":
        return (c >= low) & (c < d)
    if bounds == "next_day":
        return (c >= low) & (c < F.date_add(d, 1))
    if bounds == "lower_only":
        return c >= low
    raise ValueError(f"unknown bounds {bounds!r}; choose from {BOUNDS}")


def within_days(c: Column, as_of, n: int, bounds: str = "closed") -> Column:
    return trailing_window(c, as_of, n, bounds)


def not_null(c: Column) -> Column:
    return c.isNotNull()


def usd_only(df: DataFrame, currency: str = "currency_code") -> DataFrame:
    return df.filter(F.col(currency) == "USD")


def qualifying(c: Column) -> Column:
    return c.isin(*QUALIFYING_EVENTS)


def safe_div(num: Column, den: Column, on_zero=None) -> Column:
    """Quotient as double; a zero or missing denominator gives ``on_zero`` (null by default)."""
    q = num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))
    return q if on_zero is None else F.when(den == 0, F.lit(float(on_zero))).otherwise(q)


def select_contract(df: DataFrame, contract: list[tuple[str, str, str]]) -> DataFrame:
    """Project to a contract given as (source column, type, contract name)."""
    return df.select(*[F.col(src).cast(spark_type(t)).alias(name) for src, t, name in contract])


def spark_type(contract_type: str) -> str:
    """Contract type name to a Spark DDL type."""
    t = contract_type.strip().lower()
    # fixed values: contract type names that are not DDL types
    alias = {"number": "double", "varchar": "string", "text": "string", "integer": "int"}
    return alias.get(t, t)


def nullif_blank(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)
