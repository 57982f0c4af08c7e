"""Whitening by bit-sliced scatter against plain integer arithmetic."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import whitening
from ledgerleaf.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("n,low,high", [(1, 0, 5), (63, -9, 9), (200, 1_000_000 - 40, 1_000_000 + 40),
                                        (65, -2**31 + 1, 2**31 - 1), (130, 7, 8)])
def test_scatter_equals_integer_products(n, low, high):
    x = np.random.default_rng(n).integers(low, high, (n, 5))
    sums, cross = whitening.scatter(x)
    wide = x.astype(object)
    assert (sums == wide.sum(axis=0)).all() and (cross == wide.T @ wide).all()


def brute(vectors, components=16):
    x = np.floor(64 * vectors.astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * fit - s).astype(object)
    v = ((centred.T @ centred) / n**3).astype(float)
    value, axes = np.linalg.eigh(v)
    value, axes = value[::-1][:components], axes[:, ::-1][:, :components]
    deviation = ((n * x - s).astype(object) ** 2).sum(axis=1)
    return n, deviation, ((n * x - s) / n) @ axes / np.sqrt(value), value / np.trace(v)


def matches(got, ids, vectors):
    n, deviation, whitened, explained = brute(vectors)
    k = whitened.shape[1]
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    assert wide.shape == (len(ids), k) and (got.n == n).all()
    sign = np.sign((wide * whitened).sum(axis=0))
    assert np.abs(wide * sign - whitened).max() < 1e-9
    first = got[got.component == 1].set_index("vec_id").loc[ids]
    assert [int(d) for d in first.deviation] == [int(d) for d in deviation]
    assert np.allclose(got[got.vec_id == ids[0]].sort_values("component").explained, explained, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_query_equals_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    got = QUERIES["op13_whitening"](spark, SF).toPandas()
    matches(got, table.vec_id.tolist(), np.array(table.embedding.tolist()))


def test_copies_count_once_and_chunks_and_models_join(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(90, 6))
    vectors = np.concatenate([base, np.repeat(base[:1], 60, axis=0)])  # one vector holds two fifths of the rows
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    for options in ({}, {"chunk": 60}, {"model_bytes": 0}):
        matches(whitening.whiten(df, **options).toPandas(), list(range(150)), vectors)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.5, 0.5]), (4, None), (5, []), (6, [None, 1.0]), (7, [nan, 1.0]),
            (8, [inf, 0.0]), (9, [1e30, 0.0]), (3, [0.5, 0.5]), (None, [1.0, 0.0]), (10, [2.0]), (11, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for c in ("dim", "x", "n", "component", "model", "a.b"):
        df = df.withColumn(c, F.lit(c))
    got = whitening.whiten(df).toPandas()
    assert len(got) == 2 * 5 + 2
    pair = got[got.n == 3]
    # x, y and their sum are fixed by one another up to rounding down, so the second component has no variance.
    assert pair[pair.component == 1].whitened.notna().all() and pair[pair.component == 2].whitened.isna().all()
    assert pair.identity_error.max() < 1e-9 and set(pair.vec_id.dropna()) == {1, 2, 3}
    assert sorted(got[got.n == 2].whitened.round(9)) == [-1.0, 1.0]
    one = whitening.whiten(df.where("vec_id = 1")).toPandas()
    assert len(one) == 2 and one.whitened.isna().all() and one.explained.isna().all() and one.identity_error.isna().all()
    assert [int(d) for d in one.deviation] == [0, 0]
    assert whitening.whiten(df.where("vec_id = 4")).count() == 0 and whitening.whiten(df.limit(0)).count() == 0
