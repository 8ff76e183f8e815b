"""Run named queries against their check SQL: ``python tests/run_oracle.py SF [NAME_PREFIX ...]``."""

import sys
import time

sys.path.insert(0, ".")

from reuselake.plans import all_oracles, all_queries  # noqa: E402
from reuselake.session import local_session  # noqa: E402
from tests.oracle import TIMES, compare, connect  # noqa: E402

sf, wanted = sys.argv[1], sys.argv[2:]
path = f"/root/testdata/sf{sf}"
spark, con = local_session(8), connect(path)
bad = []
for name, fn in all_queries().items():
    if wanted and not any(name.startswith(w) for w in wanted):
        continue
    t0 = time.time()
    try:
        df = fn(spark, path)
        if name in all_oracles():
            diff = compare(df, con, all_oracles()[name])
            n = f"rows {TIMES.get('rows', 0)} sql {TIMES.get('sql', 0):.2f}s collect {TIMES.get('spark', 0):.2f}s"
        else:
            diff, n = [], f"rows={df.count()} (no SQL)"
    except Exception as e:  # noqa: BLE001
        diff, n = [f"{type(e).__name__}: {str(e)[:700]}"], ""
    print(f"{'ok  ' if not diff else 'FAIL'} {name:40s} {time.time() - t0:6.2f}s {n}", flush=True)
    for d in diff:
        print("      ", d, flush=True)
    if diff:
        bad.append(name)
print("failed:", bad)
