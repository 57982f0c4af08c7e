"""Hard negatives against a plain search over all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import hard_negatives as hn
from ledgerleaf.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute(rows, is_anchor, shift=lambda i, label: label, k=5, m=10):
    """Rows (id, vector, label), all of one length; plain Python integers."""
    x = {(i, shift(i, label), tuple(int(np.floor(256 * float(c))) for c in v)) for i, v, label in rows}
    out, anchors = [], {}
    for i, label, v in sorted(x):
        if is_anchor(i):
            anchors.setdefault(i, (label, v))
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(p * q for p, q in zip(v, o, strict=True)), i, own) for i, own, o in x)
        for s, p in [(-s, i) for s, i, own in scored if own == label and i != a][:k]:
            hard = [(-t, i) for t, i, own in scored if own != label and i != a and 30 * s <= -100 * t <= 90 * s][:m]
            out += [(a, p, r + 1, i, s, t) for r, (t, i) in enumerate(hard)]
    return sorted(out)


def collected(df):
    return sorted(map(tuple, df.collect()))


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute(rows, lambda i: i % 100 == 0, lambda i, label: (label + 1) % 10 if i % 7 == 0 else label)
    assert collected(QUERIES["op11_hard_negatives"](spark, SF)) == want and want


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    keys = [k.tobytes() for k in hn.hilbert(cells, bits)]
    assert len(set(keys)) == len(cells)
    path = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("reach", [5, 1 << 29])
def test_bounds_hold(reach):
    rng = np.random.default_rng(2)
    a, x = rng.integers(-reach, reach, (20, 6)), rng.integers(-reach, reach, (40, 6))
    least, most = hn.bounds(a, x.min(axis=0)[None], x.max(axis=0)[None])
    exact = a.astype(object) @ x.T.astype(object)
    assert (exact >= least).all() and (exact <= most).all()
    assert (hn.products(a, x) == exact).all()


def clustered(n, dims, spread, seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(8, dims))
    return [(i, (centre[i % 8] + spread * rng.normal(size=dims)).round(3).tolist(), int(rng.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize("spread,block,group", [(0.02, 8, 64), (0.3, 16, 1000), (1.0, 4, 32)])
def test_any_block_size_gives_the_same(spark, spread, block, group):
    rows = clustered(500, 5, spread, 3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = hn.mine(df, "vec_id % 20 = 0", block_rows=block, group_rows=group)
    assert collected(got) == brute(rows, lambda i: i % 20 == 0)


def test_zone_maps_leave_blocks_out(spark, monkeypatch):
    """On tight clusters most blocks are never read for an anchor."""
    rows = clustered(2000, 5, 0.02, 5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    seen = {}
    table = hn.Stage.table

    def spy(self, frame, key):
        seen[key] = table(self, frame, key)
        return seen[key]

    monkeypatch.setattr(hn.Stage, "table", spy)
    got = collected(hn.mine(df, "vec_id % 100 = 0", block_rows=16))
    assert got == brute(rows, lambda i: i % 100 == 0)
    blocks = seen["blocks"].count()
    for search in ("positives", "negatives"):
        read = seen[f"{search}-chosen"].where("not whole").select(F.sum(F.size("places"))).first()[0]
        assert read < 0.4 * 20 * blocks, (search, read, blocks)


def test_copies_hold_a_third_of_the_rows(spark):
    rows = clustered(300, 4, 0.3, 7)
    rows += [(1000 + i, [0.5, 0.5, 0.25, 0.0], i % 2) for i in range(150)]
    df = spark.createDataFrame(rows + rows[:40], "vec_id long, embedding array<double>, label int")
    got = hn.mine(df, "vec_id % 25 = 0", block_rows=8)
    assert collected(got) == brute(rows, lambda i: i % 25 == 0)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = clustered(60, 3, 1.0, 9)
    odd = [(100, None, 1), (101, [], 1), (102, [None, 1.0, 1.0], 1), (103, [nan, 1.0, 1.0], 1), (104, [inf, 1.0, 1.0], 1),
           (None, [1.0, 1.0, 1.0], 1), (105, [1.0, 1.0, 1.0], None), (106, [1e30, 1.0, 1.0], 1), (107, [1.0, 1.0], 1),
           (108, [2.0], 2)]
    twice = [(0, [0.1, 0.2, 0.3], 0), (0, [0.3, 0.2, 0.1], 1), (7, [0.9, 0.9, 0.9], 2)]
    df = spark.createDataFrame(rows + odd + twice, "vec_id long, embedding array<double>, label int")
    for c in ("dim", "x", "key", "group", "place", "w", "score", "windows", "part", "a.b"):
        df = df.withColumn(c, F.lit(c))
    assert collected(hn.mine(df, "vec_id % 5 = 0", block_rows=4)) == brute(rows + twice, lambda i: i % 5 == 0)
    text = df.withColumn("label", F.concat(F.lit("class "), F.col("label")))  # labels of any type
    assert collected(hn.mine(text, "vec_id % 5 = 0")) == brute(rows + twice, lambda i: i % 5 == 0)
    assert hn.mine(df.limit(0), "vec_id % 5 = 0").count() == 0
    assert hn.mine(df.where("vec_id = 10"), "vec_id % 5 = 0").count() == 0
    large = [(i, [float(v) * 1e5 for v in vector], label) for i, vector, label in rows]
    big = spark.createDataFrame(large, "vec_id long, embedding array<double>, label int")
    assert collected(hn.mine(big, "vec_id % 5 = 0", block_rows=4)) == brute(large, lambda i: i % 5 == 0)
