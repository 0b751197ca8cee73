"""Benchmark the headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 3).

The headline sequence runs BENCH_REPEAT times; each pass starts from a fresh
GovernanceCatalog whose shared views (edges, closure, ACL, trustee names) are
built and timed first, as ``shared_views``; the keys after it show their own
cost. Per-query medians are reported (the first pass also pays JVM/JIT
warm-up). Each query is fully materialised with the ``noop``
sink: every row and column computed, nothing collected to the driver.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from grantlens import build_session  # noqa: E402
from grantlens.plans.registry import QUERIES  # noqa: E402
from grantlens.sources.catalog import GovernanceCatalog  # noqa: E402

HEADLINE = [
    "membership_closure", "sensitive_data", "open_shares", "trustee_access", "permission_source",
    "resource_access", "resource_access_all_shares", "unused_access", "unused_access_all_shares", "effective_access",
    "permission_entries", "trustee_access_local_batch", "trustee_share_access",
    "effective_membership", "ad_users_filtered", "ad_permissions", "lookup_diagnosis", "column_profile",
    "primary_key_check", "foreign_key_check", "query_fingerprints",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    keys = [k for k in (sys.argv[1:] or HEADLINE) if k in QUERIES]
    spark = build_session(f"local[{cpus}]", cpus, extra={"spark.ui.showConsoleProgress": "false"})
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM/codegen warm-up, not timed
    runs: dict[str, list[float]] = {k: [] for k in ["shared_views", *keys]}
    for _ in range(repeat):
        GovernanceCatalog.forget(spark, sf_dir)
        t = time.perf_counter()
        GovernanceCatalog.for_dir(spark, sf_dir).build_shared()
        runs["shared_views"].append(time.perf_counter() - t)
        for k in keys:
            t = time.perf_counter()
            QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs[k].append(time.perf_counter() - t)
    times = {k: round(statistics.median(v), 3) for k, v in runs.items()}
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
