"""Benchmark the headline product queries.

Runs each query of ``HEADLINE`` on ``$BENCH_SF_DIR`` (default sf0.1) with
``local[$BENCH_CPUS]`` and prints one JSON line.  Each query is executed in
full through Spark's ``noop`` sink (every row produced, nothing collected
to the driver), like the reference timing its save call.  Every headline
query first runs once on the smallest tables (sf0.001) and that run is not
counted: it only warms the JVM, code generation caches and Python workers,
costs that vanish next to execution time on large inputs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessella import catalog  # noqa: E402
from tessella.session import build_session  # noqa: E402

HEADLINE = [
    "mm_outer",
    "mm_outer_gram",
    "mm_inner_broadcast",
    "mm_inner_cartesian",
    "mm_replicate",
    "mm_cogroup",
    "mm_block",
    "mm_block_fixed_k",
    "mm_row_dense",
    "mm_matvec",
    "mm_column_groups",
    "msbfs_hop",
    "relabel_edges",
    "dense_ids",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(cpus * 2, 8),
                          local_memory="10g")
    # warm-up, not counted: JIT, codegen and Python workers on the smallest tables
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        for q in names:
            try:
                catalog.QUERIES[q](spark, warm).write.format("noop").mode("overwrite").save()
            except Exception as exc:  # the measured run decides; say it anyway
                print(f"warm-up of {q}: {type(exc).__name__}: {str(exc)[:200]}", file=sys.stderr)
    times, errors = {}, {}
    for name in names:
        t0 = time.perf_counter()
        try:
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as exc:  # keep measuring the others; report the failure
            errors[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    rec = {"metric": "headline_total", "value": round(sum(times.values()), 3),
           "unit": "sec", "queries": times, "sf": float(sf) if sf else None}
    if errors:
        rec["errors"] = errors
    print(json.dumps(rec))


if __name__ == "__main__":
    main()
