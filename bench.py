"""Benchmark: every registered query over a parquet ledger store.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_ONLY (comma-separated query names, optional).

Step 1 builds the stand-in ledger from the TPC-H-like tables once and writes
it as a parquet store (``sales`` range-sorted by ``created_at``), as a real
ledger would be stored; its time is reported as ``store_build``. Step 2 runs
each query over that store four times (cold, then the median of three warm runs)
and forces full execution with the ``noop`` sink (no rows are collected); the
warm times are the result. Prints one JSON line on stdout.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def log(msg):
    print(msg, file=sys.stderr, flush=True)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [x for x in os.environ.get("BENCH_ONLY", "").split(",") if x]

    from ledgerleaf.plans.catalog import REGISTRY
    from ledgerleaf.session import build_session
    from ledgerleaf.sources.fixtures import FixtureTables
    from ledgerleaf.sources.tables import StoredTables, materialize

    scratch = tempfile.mkdtemp(prefix="ledgerleaf-bench-")
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus,
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
                                 "spark.checkpoint.dir": f"{scratch}/ckpt",
                                 "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024)})
    fixtures = FixtureTables(spark, sf_dir)

    t0 = time.perf_counter()
    store = f"{scratch}/store"
    materialize(fixtures, store, sales_files=cpus)
    store_build = time.perf_counter() - t0
    log(f"store_build {store_build:.2f}s")
    tables = StoredTables(spark, store, feeds=fixtures)

    names = only or list(REGISTRY)
    # Warm the JVM (class loading, codegen) on one query; not timed.
    REGISTRY["sales_page_totals"].build(tables).write.format("noop").mode("overwrite").save()

    def run(name):
        t1 = time.perf_counter()
        REGISTRY[name].build(tables).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t1

    # Each query runs four times: the first (cold: first-time codegen of its
    # expressions) is reported as cold_total; the median of the next three is the
    # query's time (local-mode job start-up jitters by tenths of a second).
    cold, warm = {}, {}
    for name in names:
        cold[name] = round(run(name), 3)
        warm[name] = round(statistics.median(run(name) for _ in range(3)), 3)
        log(f"{name:32s} cold {cold[name]:.3f}s  warm {warm[name]:.3f}s")
    total = round(sum(warm.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": warm,
                      "cold_total": round(sum(cold.values()), 3), "store_build": round(store_build, 3),
                      "total_with_store_build": round(total + store_build, 3),
                      "sf": os.path.basename(sf_dir).replace("sf", ""), "cpus": cpus, "n_queries": len(warm)}))
    spark.stop()


if __name__ == "__main__":
    main()
