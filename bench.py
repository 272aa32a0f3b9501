"""Benchmark: run every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS] and print ONE JSON line.

Each query is executed end to end with the ``noop`` sink (the whole plan runs, nothing is collected
to the driver).  ``value`` is the sum of per-query seconds after one warm-up query; a query that
fails still contributes its time and is listed under ``failed``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarry.plans.registry import QUERIES  # noqa: E402
from quarry.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    # two shuffle partitions per core: smooths stragglers from long texts; AQE merges tiny ones
    spark = build_session(master=f"local[{cpus}]", app="quarry-bench", shuffle_partitions=2 * int(cpus))

    # warm-up (JVM, codegen caches, Python workers); not timed
    QUERIES["exact_match"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        t0 = time.perf_counter()
        try:
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as e:  # report, keep going; its time still counts
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": sf, "cpus": int(cpus)}
    out["failed"] = sorted(errors)
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
