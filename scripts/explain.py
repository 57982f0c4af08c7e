"""Print the formatted physical plan of registered queries over a parquet store.

Usage: python scripts/explain.py STORE_DIR SF_DIR name [name ...]
Builds the store first if STORE_DIR does not exist.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerleaf.plans.catalog import REGISTRY  # noqa: E402
from ledgerleaf.session import build_session  # noqa: E402
from ledgerleaf.sources.fixtures import FixtureTables  # noqa: E402
from ledgerleaf.sources.tables import StoredTables, materialize  # noqa: E402


def main():
    store, sf_dir, names = sys.argv[1], sys.argv[2], sys.argv[3:]
    spark = build_session("local[8]")
    fx = FixtureTables(spark, sf_dir)
    if not os.path.exists(store):
        materialize(fx, store, sales_files=8)
    t = StoredTables(spark, store, feeds=fx)
    for n in names:
        print(f"==================== {n}")
        REGISTRY[n].build(t).explain("formatted")


if __name__ == "__main__":
    main()
