"""Business-shaped views over the test tables.

One SQL text per view serves Spark and the DuckDB check alike; the few expressions the two
dialects spell differently are given per engine. ``Lake`` reads the views in Spark, and
``with_views`` prefixes a check query with the same definitions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2001-01-31"

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

_EDGES = """
        SELECT a.fqn AS from_fqn, b.fqn AS to_fqn, 'source_input' AS relationship
        FROM artifact a JOIN artifact b ON b.ord = cast(floor(a.ord / 2.0) AS bigint) WHERE a.ord > 0
        UNION ALL
        SELECT a.fqn, b.fqn, 'transformation_dependency'
        FROM artifact a JOIN artifact b ON b.ord = cast(floor(a.ord / 3.0) AS bigint) WHERE a.ord > 2 AND a.lifecycle NOT IN ('local', 'retired')"""

_REFUNDS = """
        SELECT l_orderkey * 10 + l_linenumber AS refund_id, l_orderkey AS invoice_id, customer_id, contract_id, product_id,
          max(cast(l_shipdate AS date)) AS refund_date,
          max(CASE WHEN l_linestatus = 'F' THEN cast(l_shipdate AS date) END) AS approved_date,
          CASE WHEN bool_and(coalesce(l_linestatus = 'F', false)) THEN 'APPROVED' ELSE 'PENDING' END AS refund_status,
          cast(round(sum(cast(l_extendedprice AS decimal(18,2)) * cast(l_discount AS decimal(4,2))), 2) AS decimal(18,2)) AS refund_amount,
          currency_code,
          CASE WHEN bool_or(l_returnflag = 'R') THEN 'REFUND' ELSE 'CREDIT_NOTE' END AS refund_type, 'ERP' AS source_system
        FROM lineitem JOIN fact_invoices ON invoice_id = l_orderkey
        WHERE l_returnflag IN ('R','A')
        GROUP BY l_orderkey, l_linenumber, customer_id, contract_id, product_id, currency_code"""

VIEWS: dict[str, str | dict[str, str]] = {
    "fact_invoices": """
        SELECT o_orderkey AS invoice_id, o_custkey AS customer_id, o_orderkey % 500 AS contract_id,
          o_orderkey % 200 AS product_id, cast(o_orderdate AS date) AS invoice_date,
          CASE WHEN o_orderstatus = 'F' THEN cast(o_orderdate AS date) + cast(o_orderkey % 5 AS int) END AS posted_date,
          CASE o_orderstatus WHEN 'F' THEN 'POSTED' WHEN 'O' THEN 'DRAFT' ELSE 'VOID' END AS invoice_status,
          cast(o_totalprice AS decimal(18,2)) AS invoice_amount,
          CASE c_nationkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' ELSE 'JPY' END AS currency_code,
          'ERP' AS source_system
        FROM orders JOIN customer ON c_custkey = o_custkey""",
    # customer, contract, product and currency follow from the order, so they join the key; only
    # numbers, dates and booleans are aggregated, which keeps Spark on hash aggregation
    "fact_refunds": {"spark": _REFUNDS.replace("FROM lineitem", "FROM (SELECT /* dealt by l_orderkey */ * FROM lineitem) l"), "duckdb": _REFUNDS},
    "dim_exchange_rates": {
        "spark": """
        SELECT ccy AS from_currency, 'USD' AS to_currency, rate_date,
          cast(cast(base * 1000 + datediff(rate_date, date'1995-01-01') % 100 AS decimal(18,8)) / 1000 AS decimal(18,8)) AS exchange_rate
        FROM VALUES ('EUR',1),('GBP',1),('JPY',0) c(ccy, base)
        LATERAL VIEW explode(sequence(date'1995-01-01', date'2001-12-31')) d AS rate_date
        WHERE NOT (ccy = 'GBP' AND day(rate_date) = 13)""",
        "duckdb": """
        SELECT ccy AS from_currency, 'USD' AS to_currency, rate_date,
          cast(cast(base * 1000 + datediff('day', date'1995-01-01', rate_date) % 100 AS decimal(18,8)) / 1000 AS decimal(18,8)) AS exchange_rate
        FROM (VALUES ('EUR',1),('GBP',1),('JPY',0)) c(ccy, base)
        CROSS JOIN (SELECT cast(unnest(generate_series(date'1995-01-01', date'2001-12-31', interval 1 day)) AS date) AS rate_date)
        WHERE NOT (ccy = 'GBP' AND day(rate_date) = 13)""",
    },
    "dim_customers": """
        SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS customer_segment, r_name AS region_code,
          last_order_date, coalesce(last_order_date >= date'2000-01-31', false) AS is_active
        FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
        LEFT JOIN (SELECT o_custkey, max(cast(o_orderdate AS date)) AS last_order_date FROM orders
                   WHERE o_orderdate <= date'2001-01-31' GROUP BY o_custkey) o ON o_custkey = c_custkey""",
    "commercial_events": """
        SELECT customer_id, invoice_date AS event_date,
          CASE invoice_status WHEN 'POSTED' THEN 'paid_invoice' WHEN 'VOID' THEN 'committed_order' ELSE 'quote' END AS event_type
        FROM fact_invoices
        UNION ALL
        SELECT user_id, cast(ts AS date) - 8400,
          CASE event_type WHEN 'purchase' THEN 'paid_invoice' WHEN 'signup' THEN 'active_subscription' ELSE event_type END
        FROM events""",
    "reporting_calendar": """
        SELECT DISTINCT cast(date_trunc('month', o_orderdate) AS date) - 1 AS reporting_date FROM orders
        WHERE o_orderdate >= date'2000-02-01' AND o_orderdate < date'2001-07-01'""",
    "customer_logins": """
        SELECT user_id AS customer_id, ts - interval 8400 days AS login_timestamp,
          CASE WHEN event_type = 'view' THEN 'Marketing Portal' ELSE 'Other' END AS application_name FROM events""",
    "artifact": """
        SELECT 'd' || cast((p_partkey - p_partkey % 2) % 7 AS string) || '.ns' || cast((p_partkey - p_partkey % 2) % 3 AS string)
            || '.a' || cast(p_partkey - p_partkey % 2 AS string) || '.v' || cast(1 + p_partkey % 2 AS string) AS fqn,
          p_partkey AS ord, p_name AS title, p_type || ' ' || p_brand || ' ' || p_name AS description,
          CASE p_partkey % 3 WHEN 0 THEN 'callable_logic' WHEN 1 THEN 'queryable_dataset' ELSE 'semantic_contract' END AS interface_type,
          CASE p_partkey % 5 WHEN 0 THEN 'certified' WHEN 1 THEN 'shared' WHEN 2 THEN 'local' WHEN 3 THEN 'deprecated' ELSE 'retired' END AS lifecycle,
          CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 'team-' || p_brand END AS owner,
          CASE p_partkey % 4 WHEN 0 THEN 'enterprise_canonical' WHEN 1 THEN 'domain_canonical' ELSE 'shared_utility' END AS reuse_intent
        FROM part""",
    # an artifact nobody owns has no binding; the others have one to three
    "binding": {
        "spark": """
        SELECT fqn, ord, n AS ordinal, CASE n WHEN 0 THEN 'warehouse' WHEN 1 THEN 'databricks' ELSE 'dbt' END AS system,
          CASE WHEN (ord + n) % 3 = 0 THEN 'uat' ELSE 'prod' END AS env, CASE n WHEN 2 THEN 'macro' ELSE 'view' END AS object_type,
          'ref.' || cast(ord AS string) || '.' || cast(n AS string) AS physical_ref
        FROM artifact LATERAL VIEW explode(array(0, 1, 2)) t AS n
        WHERE owner IS NOT NULL AND n <= ord % 4""",
        "duckdb": """
        SELECT fqn, ord, n AS ordinal, CASE n WHEN 0 THEN 'warehouse' WHEN 1 THEN 'databricks' ELSE 'dbt' END AS system,
          CASE WHEN (ord + n) % 3 = 0 THEN 'uat' ELSE 'prod' END AS env, CASE n WHEN 2 THEN 'macro' ELSE 'view' END AS object_type,
          'ref.' || cast(ord AS string) || '.' || cast(n AS string) AS physical_ref
        FROM artifact CROSS JOIN (SELECT cast(unnest([0, 1, 2]) AS int) AS n) t
        WHERE owner IS NOT NULL AND n <= ord % 4""",
    },
    # both sides are the whole registry: Spark is told to shuffle them
    "dependency_edge": {"spark": _EDGES.replace("SELECT a.fqn", "SELECT /*+ MERGE(b) */ a.fqn"), "duckdb": _EDGES},
    "sql_snippet": """
        SELECT p_partkey AS id, 'sql' AS language, CASE WHEN p_partkey % 2 = 0 THEN 'snowflake' ELSE 'spark' END AS dialect,
          CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '-- copy of revenue rule' || chr(10) ELSE '/* owner ' || p_brand || ' */ ' END ||
          CASE WHEN p_partkey % 3 = 0 THEN upper(body) ELSE body END AS text
        FROM (SELECT p_partkey, p_brand, 'SELECT customer_id, ' ||
            CASE p_size % 3 WHEN 0 THEN 'SUM(amount)' WHEN 1 THEN 'COUNT(invoice_id)' ELSE 'AVG(price)' END ||
            ' AS ' || lower(p_type) || '_value FROM shared.fact_' || lower(p_type) ||
            CASE WHEN p_size % 2 = 0 THEN ' AS f JOIN finance.dim_rates AS r ON r.code = f.code' ELSE ' AS f' END ||
            ' WHERE f.status = ''S' || cast(p_size % 5 AS string) || ''' GROUP BY customer_id' AS body FROM part) x""",
    "py_snippet": """
        SELECT -1 - p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '# owner ' || p_brand || chr(10) ELSE '' END ||
          'def build_' || lower(p_type) || '(df, rates, start_date):' || chr(10) ||
          CASE WHEN p_partkey % 2 = 0 THEN '    \"\"\"Value per customer. # of rows stays.\"\"\"' || chr(10) ELSE '' END ||
          '    tag = "S#' || cast(p_size % 5 AS string) || '"  # filter tag' || chr(10) ||
          '    return ' || CASE WHEN p_size % 2 = 0 THEN 'df.join(rates, "code")' ELSE 'df' END ||
          '.groupBy("customer_id").agg(F.' || CASE p_size % 3 WHEN 0 THEN 'sum("amount")' WHEN 1 THEN 'count("invoice_id")' ELSE 'mean("price")' END ||
          '.alias("' || lower(p_type) || '_value"))' AS text
        FROM part""",
    "code_snippet": """
        SELECT id, text FROM sql_snippet UNION ALL SELECT id, text FROM py_snippet""",
    # a registered candidate is any artifact with at least one binding; all three are the whole registry, so Spark is told to shuffle them
    "candidate": {
        "spark": """
        SELECT /*+ MERGE(s) */ s.id, s.language, s.dialect, s.text, a.fqn, a.title, a.lifecycle, a.owner, a.reuse_intent
        FROM (SELECT /* dealt by id */ * FROM sql_snippet) s JOIN artifact a ON a.ord = s.id
        WHERE EXISTS (SELECT /*+ MERGE(b) */ 1 FROM (SELECT /* dealt by fqn */ fqn FROM binding) b WHERE b.fqn = a.fqn)""",
        "duckdb": """
        SELECT s.id, s.language, s.dialect, s.text, a.fqn, a.title, a.lifecycle, a.owner, a.reuse_intent
        FROM sql_snippet s JOIN artifact a ON a.ord = s.id
        WHERE a.fqn IN (SELECT fqn FROM binding)""",
    },
    # two versions of every dataset; some columns exist in one of them only
    "contract": {
        "spark": """
        SELECT 'ds.' || p_brand AS dataset, v AS version, column_name,
          CASE WHEN v = 2 AND k % 13 = 0 THEN 'string' WHEN k % 3 = 0 THEN 'date' ELSE 'decimal(18,2)' END AS type,
          CASE WHEN (k + v) % 4 = 0 THEN 0 ELSE 1 END AS nullable
        FROM (SELECT p_brand, lower(p_type) || '_' || cast(p_size % 4 AS string) AS column_name, min(p_partkey) AS k
              FROM part GROUP BY p_brand, lower(p_type) || '_' || cast(p_size % 4 AS string)) c
        LATERAL VIEW explode(array(1, 2)) t AS v
        WHERE NOT (v = 2 AND k % 7 = 0) AND NOT (v = 1 AND k % 11 = 0)""",
        "duckdb": """
        SELECT 'ds.' || p_brand AS dataset, v AS version, column_name,
          CASE WHEN v = 2 AND k % 13 = 0 THEN 'string' WHEN k % 3 = 0 THEN 'date' ELSE 'decimal(18,2)' END AS type,
          CASE WHEN (k + v) % 4 = 0 THEN 0 ELSE 1 END AS nullable
        FROM (SELECT p_brand, lower(p_type) || '_' || cast(p_size % 4 AS string) AS column_name, min(p_partkey) AS k
              FROM part GROUP BY p_brand, lower(p_type) || '_' || cast(p_size % 4 AS string)) c
        CROSS JOIN (SELECT cast(unnest([1, 2]) AS int) AS v) t
        WHERE NOT (v = 2 AND k % 7 = 0) AND NOT (v = 1 AND k % 11 = 0)""",
    },
    "intent": """
        SELECT DISTINCT lower(p_type) || ' ' || split_part(p_name, ' ', 1) AS query FROM part""",
    # a feed for each hundred customers; every third one skips a page number, every third one ends before its last page
    "landed_page": """
        SELECT 'feed' || cast(feed AS string) AS source, 1 + rest + CASE WHEN feed % 3 = 1 AND rest >= 70 THEN 1 ELSE 0 END AS page,
          '{"accounts":[{"id":' || cast(c_custkey AS string) || '},{"id":' || cast(-1 - c_custkey AS string) || '}],"next_page":' ||
          CASE WHEN feed % 3 = 2 AND rest = 80 THEN 'null' ELSE '1' END || '}' AS body
        FROM (SELECT c_custkey, cast(floor((c_custkey - low) / 100.0) AS int) AS feed, cast((c_custkey - low) % 100 AS int) AS rest
              FROM customer, (SELECT min(c_custkey) AS low FROM customer) m) c""",
    "activity": """
        SELECT event_id, ts AS event_ts,
          CASE user_id % 4 WHEN 0 THEN 'tableau' WHEN 1 THEN 'databricks' WHEN 2 THEN 'snowflake' ELSE 'semantic' END AS source_system,
          CASE WHEN event_id % 10 = 0 THEN NULL ELSE props END AS tag,
          CASE user_id % 3 WHEN 0 THEN 'dashboard' WHEN 1 THEN 'notebook' ELSE 'service' END AS consumer_type,
          'REF.' || cast(event_id % 120 AS string) || '.' || cast(event_id % 3 AS string) AS physical_ref FROM events""",
    # Spark sends the list of NOT IN through the driver, so its form says the same with an anti join of counted names
    "observed": {
        "spark": """
        SELECT physical_ref, hits, CASE WHEN first_id % 4 = 0 THEN 'accepted_local_variant' ELSE 'suspected_bypass' END AS status,
          'concept_' || cast(first_id % 8 AS string) AS concept, source_system
        FROM (SELECT physical_ref, count(*) AS hits, min(event_id) AS first_id, min(source_system) AS source_system
              FROM activity GROUP BY physical_ref) u
          CROSS JOIN (SELECT count(*) AS names, count_if(physical_ref IS NULL) AS nulls FROM binding) n
        WHERE (names = 0 OR (nulls = 0 AND u.physical_ref IS NOT NULL))
          AND NOT EXISTS (SELECT /*+ MERGE(b) */ 1 FROM binding b WHERE b.physical_ref = lower(u.physical_ref))""",
        "duckdb": """
        SELECT physical_ref, count(*) AS hits,
          CASE WHEN min(event_id) % 4 = 0 THEN 'accepted_local_variant' ELSE 'suspected_bypass' END AS status,
          'concept_' || cast(min(event_id) % 8 AS string) AS concept, min(source_system) AS source_system
        FROM activity WHERE lower(physical_ref) NOT IN (SELECT physical_ref FROM binding) GROUP BY physical_ref""",
    },
    "exception_grant": """
        SELECT doc_id AS ord, quality = 1 AS justified, toxic = 0 AS owner_approved,
          date'2001-01-01' + cast(doc_id % 60 AS int) AS expiry_date FROM labels""",
}


def _text(name: str, engine: str) -> str:
    v = VIEWS[name]
    return v if isinstance(v, str) else v[engine]


def _words(sql: str) -> set[str]:
    return set(re.findall(r"\w+", sql))


def _closure(names, engine: str) -> list[str]:
    """Views needed for ``names`` in definition order."""
    need: set[str] = set()
    stack = list(names)
    while stack:
        n = stack.pop()
        if n in need:
            continue
        need.add(n)
        stack += [m for m in VIEWS if m != n and m in _words(_text(n, engine))]
    return [n for n in VIEWS if n in need]


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    """DuckDB text: ``sql`` (which may start with its own ``WITH``) over the named views."""
    parts = [f"{n} AS ({_text(n, 'duckdb')})" for n in _closure(names, "duckdb")]
    body = sql.strip()
    head = "WITH RECURSIVE " if recursive else "WITH "
    if body[:5].upper() == "WITH ":
        return head + ",\n".join(parts) + ",\n" + body[5:]
    return head + ",\n".join(parts) + "\n" + body


#: Views whose big inputs are dealt by rows, as table that they grow with and its rows of a task. Left to itself Spark gives a task 64 MB of compressed rows, which its sorts and hash tables blow up.
DEALT = {"fact_refunds": ("lineitem", 1_000_000), "candidate": ("part", 100_000)}


class Lake:
    """The views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _dealt(self, text: str, table: str, rows: int) -> str:
        """``text`` with hints by which a task holds what ``rows`` rows of ``table`` give, so that tasks grow in number; what one task may hold is left to Spark."""
        parts = -(-self.base(table).count() // rows)
        usual = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return re.sub(r"/\* dealt by (\w+) \*/", rf"/*+ REPARTITION({max(parts, usual)}, \1) */" if parts > 1 else "", text)

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.base(name)
        if name not in VIEWS:
            raise AttributeError(name)
        views = _closure([name], "spark")
        text = {v: _text(v, "spark") for v in views}
        for view, (table, rows) in DEALT.items():
            if view in text:
                text[view] = self._dealt(text[view], table, rows)
        body = " ".join(text.values())
        parts = [
            f"{t} AS (SELECT * FROM parquet.`{self.path}/{t}.parquet`)" for t in BASE if t in _words(body)
        ] + [f"{v} AS ({text[v]})" for v in views]
        return self.spark.sql("WITH " + ",\n".join(parts) + f"\nSELECT * FROM {name}")
