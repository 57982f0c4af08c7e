"""Embedding whitening by bit-sliced scatter.

Entries become integers. The distinct vectors are the fit list; a task shifts a chunk of them to start at zero
in every dimension, packs each dimension's bit planes across the rows into 64-bit words, and sums the popcounts
of the planes' pairwise ANDs, weighted by their powers of two: exact cross-products without a multiplication.
Shifts are undone and cross-products centred as integers (n * sum(x y) - sum(x) * sum(y)); only then they become
doubles for the eigenvectors. Vectors of another length have a fit of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, finite_vectors, narrow, packed_rows, unpacked_rows

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
CHUNK = 1 << 22          # entries whose bit planes a task holds at once
LARGEST = 1 << 31        # integers from here on do not fit the packed form
MODEL_BYTES = 32 << 20   # models up to this size together go to the tasks by themselves


def planes(values):
    """(d, bits, words) uint64: the bit planes of non-negative integers (n, d), packed across the rows."""
    import numpy as np

    n, d = values.shape
    bits = max(1, int(values.max(initial=0)).bit_length())
    rows = np.zeros((-(-n // 64) * 64, d), dtype=np.uint64)
    rows[:n] = values
    out = np.empty((d, bits, len(rows) // 64), dtype=np.uint64)
    for b in range(bits):
        plane = np.ascontiguousarray(((rows >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T)
        out[:, b] = np.packbits(plane, axis=1, bitorder="little").view(np.uint64)
    return out


def scatter(x):
    """(sums, cross) of integers (n, d) as exact integers in object arrays, by weighted AND-popcounts."""
    import numpy as np

    n, d = x.shape
    low = x.min(axis=0)
    packed = planes((x - low).astype(np.uint64))
    bits = packed.shape[1]
    kind = np.int64 if 2 * bits + int(n).bit_length() < 62 else object
    weight = np.array([1 << b for b in range(bits)], dtype=kind)
    own = np.bitwise_count(packed).sum(axis=2, dtype=np.int64).astype(kind) @ weight  # sum of y
    cross = np.zeros((d, d), dtype=kind)                                              # sum of y y'
    for i in range(d):
        for b in range(bits):
            both = np.bitwise_count(packed[i:] & packed[i, b]).sum(axis=2, dtype=np.int64)
            cross[i, i:] += (both.astype(kind) @ weight) << b
    cross = (np.triu(cross) + np.triu(cross, 1).T).astype(object)
    own, low = own.astype(object), low.astype(object)
    across = low[:, None] * own[None, :]
    return own + n * low, cross + across + across.T + n * low[:, None] * low[None, :]


def _integers(scale: int, offset: int):
    def pack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at, c in finite_vectors(batch.column(1)):
                x = np.floor(scale * c) + offset
                small = (np.abs(x) < LARGEST).all(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at[small])), pa.array(np.full(small.sum(), c.shape[1]), pa.int32()),
                     packed_rows(x[small])], names=["vec_id", "dim", "x"])
    return pack


def _by_dim(batch, column: int = 1):
    """(dim, row numbers, integers) of a batch with a dim and an x column."""
    import numpy as np
    import pyarrow as pa

    dims = batch.column(column).to_numpy(zero_copy_only=False)
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield int(dim), at, unpacked_rows(batch.column(column + 1).take(pa.array(at)).to_pylist(), dim).astype(np.int64)


def _scatters(chunk: int):
    """(dim, x) to the exact sums of each chunk: (dim, i, j, total); j is -1 for the sum of dimension i, and the row
    (-1, -1) is the count."""
    def sums(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held: dict[int, list] = {}

        def flushed(dim):
            x = np.concatenate(held.pop(dim))
            own, cross = scatter(x)
            i, j = np.triu_indices(dim)
            head = np.concatenate([[-1], np.arange(dim), i])
            tail = np.concatenate([np.full(dim + 1, -1), j])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(head), dim), pa.int32()), pa.array(head, pa.int32()), pa.array(tail, pa.int32()),
                 pa.array([str(v) for v in (len(x), *own, *cross[i, j])], pa.string())], names=["dim", "i", "j", "total"])

        for batch in batches:
            for dim, _, x in _by_dim(batch, 0):
                held.setdefault(dim, []).append(x)
                if sum(map(len, held[dim])) * dim >= chunk:
                    yield flushed(dim)
        for dim in list(held):
            yield flushed(dim)
    return sums


def _eigen(components: int):
    """The exact sums of one vector length to its model."""
    def fit(key, rows):
        import numpy as np
        import pandas as pd

        d = int(key[0])
        n, s = 0, [0] * d
        for i, j, total in zip(rows["i"].tolist(), rows["j"].tolist(), rows["total"], strict=True):
            if i < 0:
                n = int(total)
            elif j < 0:
                s[i] = int(total)
        v = np.zeros((d, d))
        for i, j, total in zip(rows["i"].tolist(), rows["j"].tolist(), rows["total"], strict=True):
            if j >= 0:
                v[i, j] = v[j, i] = (n * int(total) - s[i] * s[j]) / (n * n)  # integers to the last step
        value, vector = np.linalg.eigh(v)
        value, vector = value[::-1][:components], vector[:, ::-1][:, :components]
        trace = float(np.trace(v))
        held = value > d * np.finfo(float).eps * max(value[0], 0.0)
        scaled = np.where(held, vector / np.sqrt(np.where(held, value, 1.0)), np.nan)
        share = value / trace if trace > 0 else np.full(len(value), np.nan)
        return pd.DataFrame({"dim": [d], "n": [n], "sums": [[str(t) for t in s]],
                             "axes": [np.ascontiguousarray(scaled).astype("<f8").tobytes()],
                             "explained": [share.astype("<f8").tobytes()]})
    return fit


def centred(x, n: int, sums):
    """n * x - sums as exact integers: int64 where that holds them, else Python integers."""
    import numpy as np

    reach = n * max(1, int(np.abs(x).max(initial=0))) + max(map(abs, sums))
    kind = np.int64 if reach < 1 << 62 else object
    return x.astype(kind) * n - np.array(sums, dtype=kind)


def _project(x, model):
    import numpy as np

    c = centred(x, model["n"], model["sums"])
    return c, (c.astype(np.float64) / model["n"]) @ model["axes"]


def _model(row: dict) -> dict:
    import numpy as np

    return {**row, "sums": [int(s) for s in row["sums"]], "axes": np.frombuffer(row["axes"], "<f8").reshape(row["dim"], -1),
            "explained": np.frombuffer(row["explained"], "<f8")}


def _modelled(held, batch, first: int):
    """(model, row numbers, integers) by vector length; a model comes from ``held`` or from the batch's last column."""
    for dim, at, x in _by_dim(batch, first):
        yield _model(held[dim] if held is not None else batch.column(first + 2)[int(at[0])].as_py()), at, x


def _grams(held):
    """Rows (dim, x) to the summed products of their whitened values and a one: (dim, i, j, total)."""
    def gram(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total: dict = {}
        for batch in batches:
            for m, _, x in _modelled(held, batch, 0):
                w = np.column_stack([np.nan_to_num(_project(x, m)[1]), np.ones(len(x))])
                total[m["dim"]] = total.get(m["dim"], 0) + w.T @ w
        for dim, g in total.items():
            i, j = np.indices(g.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(g.size, dim), pa.int32()), pa.array(i.ravel(), pa.int32()),
                 pa.array(j.ravel(), pa.int32()), pa.array(g.ravel())], names=["dim", "i", "j", "total"])
    return gram


def _identity_error(key, rows):
    """The largest entry of the whitened covariance minus the identity, over the components that have variance."""
    import numpy as np
    import pandas as pd

    k = int(rows["i"].max())
    g = np.zeros((k + 1, k + 1))
    g[rows["i"], rows["j"]] = rows["total"]
    mean = g[:k, k] / g[k, k]
    v = g[:k, :k] / g[k, k] - mean[:, None] * mean
    has = np.flatnonzero(np.diag(g)[:k])
    error = np.abs(v[np.ix_(has, has)] - np.eye(len(has))).max() if len(has) else None
    return pd.DataFrame({"dim": [int(key[0])], "identity_error": np.array([error], dtype=float)})


def _whitener(held):
    """Rows (vec_id, dim, x) to one row per component."""
    def whiten(batches: Iterator) -> Iterator:
        from decimal import Decimal

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for m, at, x in _modelled(held, batch, 1):
                c, w = _project(x, m)
                rows, k = w.shape
                wide = c.dtype == object or m["dim"] * float(np.abs(c).max(initial=0)) ** 2 >= 2.0 ** 62
                square = ((c.astype(object) if wide else c) ** 2).sum(axis=1)
                deviation = pa.array([Decimal(int(s)) for s in square], pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.repeat(at, k))),
                     pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, m["n"]), pa.int64()),
                     deviation.take(each), pa.array(w.ravel(), from_pandas=True),
                     pa.array(np.tile(m["explained"], rows), from_pandas=True),
                     pa.array(np.full(rows * k, m["identity_error"], dtype=float), from_pandas=True)],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return whiten


def _with_models(rows: DataFrame, models: DataFrame, limit: int) -> tuple[DataFrame, dict | None]:
    """The models of all vector lengths for the tasks, or, where they are larger than ``limit``, each row with its own."""
    size = models.agg(F.sum(F.octet_length("axes") + 40 * F.size("sums"))).first()[0] or 0
    if size <= limit:
        return rows, {r["dim"]: r.asDict() for r in models.collect()}
    return rows.join(models.select("dim", F.struct(*models.columns).alias("model")), "dim").select(*rows.columns, "model"), None


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, components: int = COMPONENTS,
           scale: int = SCALE, offset: int = OFFSET, chunk: int = CHUNK, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or empty, or holds null or non-finite entries or entries whose integer has 32 bits or
    more, are dropped. Repeated vectors are one vector of the fit and rows of their own in the result; ids may repeat
    or be null. Vectors of each length are whitened by themselves, with as many components as they have dimensions
    at most. A component without variance has a null ``whitened`` value and stays out of ``identity_error``; where no
    dimension varies, ``explained`` and ``identity_error`` are null. ``deviation`` is a decimal, as it outgrows 64 bits
    on large tables. Other columns are ignored. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    stage = Stage(spark, "whitening")
    id_type = vectors.schema[id_col].dataType.simpleString()
    rows = stage.table(narrow(vectors, vec_id=id_col, vector=vector_col).where("vector is not null").mapInArrow(
        _integers(scale, offset), f"vec_id {id_type}, dim int, x binary"), "rows")
    distinct = stage.table(rows.select("dim", "x").distinct(), "distinct")
    sums = (distinct.mapInArrow(_scatters(chunk), "dim int, i int, j int, total string")
            .groupBy("dim", "i", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total")))
    models = stage.table(sums.groupBy("dim").applyInPandas(
        _eigen(components), "dim int, n long, sums array<string>, axes binary, explained binary"), "models")
    # The covariance of the whitened values, measured over the fit list.
    fitted, held = _with_models(distinct, models, model_bytes)
    gram = (fitted.mapInArrow(_grams(held), "dim int, i int, j int, total double")
            .groupBy("dim", "i", "j").agg(F.sum("total").alias("total")))
    error = gram.groupBy("dim").applyInPandas(_identity_error, "dim int, identity_error double")
    full, held = _with_models(rows, stage.table(models.join(error, "dim"), "full"), model_bytes)
    stage.drop("distinct", "models")
    return full.mapInArrow(_whitener(held), f"vec_id {id_type}, component int, n long, deviation decimal(38,0), "
                                            "whitened double, explained double, identity_error double")
