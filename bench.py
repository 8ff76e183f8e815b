"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Beside it stands DuckDB's time for the same rows by the check SQL on the same files (null: no SQL, or
more than ``$BENCH_DUCKDB_S`` seconds). Each query is run to its last row into Spark's no-op sink. The first run of a query warms up
code generation and is not counted; the value is the median of the others.
"""

import json
import os
import statistics
import sys
import tempfile
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import duckdb  # noqa: E402

from reuselake.plans import all_oracles, all_queries  # noqa: E402
from reuselake.plans.fixtures import BASE  # noqa: E402
from reuselake.session import local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
DUCKDB_S = float(os.environ.get("BENCH_DUCKDB_S", "8"))
HEADLINE = [
    "billable_events", "recognize_revenue", "commercial_status", "billed_status", "arpac_asof", "arpac_components",
    "variant_domain_code", "divergence", "metric_ratio_quarter", "metric_extended_model", "fingerprint_groups",
    "feature_jaccard", "structural_pairs", "structural_pairs_prose", "compare_top5", "near_duplicates_lsh", "embedding_top5", "clusters", "search_top5", "resolve_concepts", "composition_plan",
    "resolve_bindings", "impact_closure", "usage_edges_30d", "adoption_rate", "stream_usage_edges", "gate_breaking",
    "gate_duplication", "contract_check",
]


def run(spark, fn) -> float:
    start = time.perf_counter()
    fn(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def duckdb_seconds(name: str, folder: str) -> float | None:
    """Time of the check SQL with its result fetched; null without SQL or beyond the limit."""
    sql = all_oracles().get(name)
    if sql is None:
        return None
    con = duckdb.connect(config={"threads": int(CPUS) if CPUS.isdigit() else 8, "memory_limit": "6GB", "temp_directory": folder})
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    limit = threading.Timer(DUCKDB_S, con.interrupt)
    limit.start()
    start = time.perf_counter()
    try:
        con.execute(sql).fetchall()
        return round(time.perf_counter() - start, 3)
    except duckdb.Error:
        return None
    finally:
        limit.cancel()
        con.close()


def main() -> None:
    wanted = sys.argv[1:] or HEADLINE
    shared = tempfile.mkdtemp(prefix="bench-")
    spark = local_session(CPUS, app="bench", **{"spark.checkpoint.dir": f"file://{shared}"})
    queries, seconds, beside = all_queries(), {}, {}
    for name in wanted:
        times = [run(spark, queries[name]) for _ in range(1 + RUNS)]
        seconds[name] = round(statistics.median(times[1:]), 3)
        beside[name] = duckdb_seconds(name, shared)
        print(name, [round(t, 2) for t in times], "duckdb", beside[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, median seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "duckdb": beside, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
