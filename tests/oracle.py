"""Side-by-side comparison of a query with its check SQL."""

from __future__ import annotations

import decimal
import math
import time

import duckdb

from reuselake.plans.fixtures import BASE


TIMES: dict[str, float] = {}


def connect(path: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        return f"{v:f}"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


_KIND = {
    "HUGEINT": "bigint", "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
    "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp", "FLOAT": "float",
}


def compare(df, con, sql) -> list[str]:
    """Differences as text; an empty list means equal."""
    t0 = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    t1 = time.time()
    got = df.collect()
    TIMES["rows"] = len(got)
    TIMES["sql"], TIMES["spark"] = t1 - t0, time.time() - t1
    out = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    for f in df.schema.fields:
        a, b = f.dataType.simpleString().replace("timestamp_ntz", "timestamp"), kinds[f.name]
        b = _KIND.get(b, b.lower())
        if a != b:
            out.append(f"type {f.name}: {a} != {b}")
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    a, b = _rows(df.columns, [tuple(r) for r in got]), _rows(names, want)
    if a != b:
        sa, sb = set(a), set(b)
        out.append(f"values: only spark {sorted(sa - sb)[:3]} only sql {sorted(sb - sa)[:3]}")
    return out
