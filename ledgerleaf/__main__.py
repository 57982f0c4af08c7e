"""Command line: list, run or explain registered queries; build a parquet store.

    python -m ledgerleaf list
    python -m ledgerleaf store --sf-dir /root/testdata/sf0.1 --out /data/ledger
    python -m ledgerleaf run category_ranking --sf-dir /root/testdata/sf0.01 [--store /data/ledger] [--out path]
    python -m ledgerleaf explain dashboard_kpis --store /data/ledger --sf-dir /root/testdata/sf0.1

``run`` writes the result as parquet when ``--out`` is given (executors write;
nothing is collected), else shows the first rows.
"""

from __future__ import annotations

import argparse
import sys


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="ledgerleaf")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    st = sub.add_parser("store")
    st.add_argument("--sf-dir", required=True)
    st.add_argument("--out", required=True)
    st.add_argument("--files", type=int, default=None)
    for name in ("run", "explain"):
        p = sub.add_parser(name)
        p.add_argument("query")
        p.add_argument("--sf-dir", required=True)
        p.add_argument("--store", default=None)
        p.add_argument("--out", default=None)
    ap.add_argument("--master", default=None)
    ap.add_argument("--partitions", type=int, default=8)
    args = ap.parse_args(argv)

    from .plans.catalog import REGISTRY
    if args.cmd == "list":
        for name, spec in REGISTRY.items():
            print(f"{name:34s} {spec.survey_id:14s} {'oracle' if spec.sql else ''}")
        return 0

    from .session import build_session
    from .sources.fixtures import FixtureTables
    from .sources.tables import StoredTables, materialize
    spark = build_session(args.master, shuffle_partitions=args.partitions)
    fixtures = FixtureTables(spark, args.sf_dir)
    if args.cmd == "store":
        materialize(fixtures, args.out, sales_files=args.files)
        return 0
    tables = StoredTables(spark, args.store, feeds=fixtures) if args.store else fixtures
    df = REGISTRY[args.query].build(tables)
    if args.cmd == "explain":
        df.explain("formatted")
    elif args.out:
        df.write.mode("overwrite").parquet(args.out)
    else:
        df.show(20, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
