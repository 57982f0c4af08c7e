from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from ledgerleaf.session import build_session
    s = build_session("local[4]", shuffle_partitions=4, extra={"spark.driver.memory": "4g"})
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ll-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def seed(spark):
    import seed as S

    class Seed:
        products = S.products_df(spark)
        sales = S.sales_df(spark)
        addons = S.addons_df(spark)
        sale_addons = S.sale_addons_df(spark)
        ingredients = S.ingredients_df(spark)
    return Seed
