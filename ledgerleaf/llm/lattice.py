"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected to eight dimensions by several random matrices and decoded to the nearest
point of the E8 lattice. In each table a vector also probes the neighbouring lattice points nearest to
it. Two vectors of one label meet where one's own cell is the other's own or probed cell, and their
cosine (double precision, original components) decides.

Only cells in which vectors can meet get the vectors themselves. A pair is counted in the first table
and cell in which it meets, so no pair is ever written out: a cell is cut into blocks of bounded size,
each task holds two blocks, counts the links of their members, and hands on a spanning forest of them.
Equal vectors of one label are one class, which meets others once.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, narrow
from .components import connected_components

COSINE = 0.93
TABLES, PROBES, WIDTH, SEED = 7, 8, 1.0, 17
BLOCK = 512  # members of a cell that one side of a comparison holds


def roots():
    """The 240 shortest vectors of E8."""
    import itertools

    import numpy as np

    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    for signs in itertools.product((0.5, -0.5), repeat=8):
        if sum(s < 0 for s in signs) % 2 == 0:
            out.append(np.array(signs))
    return np.array(out)


def decode(x):
    """The nearest point of E8 to each row: the better one of D8 and D8 shifted by a half."""
    import numpy as np

    def d8(v):
        near = np.rint(v)
        odd = np.flatnonzero(near.sum(axis=1) % 2)
        gap = v[odd] - near[odd]
        worst = np.abs(gap).argmax(axis=1)
        near[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
        return near

    a, b = d8(x), d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


def cells(unit, tables: int, probes: int, width: float, seed: int):
    """(n, tables, 1 + probes) 64-bit keys: each vector's own cell, then the probed ones, nearest first."""
    import numpy as np

    shortest = roots()
    mix = np.random.default_rng(seed + 1).integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(unit), tables, 1 + probes), dtype=np.int64)
    for t in range(tables):
        rng = np.random.default_rng([seed, t, unit.shape[1]])
        x = unit @ (rng.standard_normal((unit.shape[1], 8)) / width) + rng.random(8) * 2
        own = decode(x)
        near = np.argsort(-((x - own) @ shortest.T), axis=1, kind="stable")[:, :probes]
        points = np.concatenate([own[:, None, :], own[:, None, :] + shortest[near]], axis=1)
        key = ((points * 2).astype(np.int64).view(np.uint64) * mix).sum(axis=2, dtype=np.uint64) + np.uint64(t + 1)
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out[:, t] = (key ^ (key >> np.uint64(29))).view(np.int64)
    return out


def units(vectors):
    """Rows divided by their norms; scaled first, so that tiny and huge components keep their direction."""
    import numpy as np

    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _hasher(tables: int, probes: int, width: float, seed: int):
    """(label, rep, dim, vector) to one row per table, cell and role (0 own, 1 probed)."""
    def hashed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                vectors = np.array([np.frombuffer(batch.column(3)[int(i)].as_buffer(), "<f8") for i in at])
                key = cells(units(vectors), tables, probes, width, seed)
                n, each = len(at), tables * (1 + probes)
                role = np.tile(np.arange(1 + probes) > 0, n * tables).astype(np.int32)
                take = pa.array(np.repeat(at, each))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take),
                     pa.array(key.ravel()), pa.array(role)], names=["label", "rep", "dim", "cell", "role"])
    return hashed


def _counter(cosine: float, tables: int, probes: int, width: float, seed: int):
    """Over rows (task, cell, side, role, rep, copies, vector) sorted by task: (kind, rep, other, links)."""
    def compare(rows, out):
        import numpy as np

        cell = rows[0][1]
        sides = {}
        for _, _, side, role, rep, copies, vector in rows:
            sides.setdefault(side, {})[rep] = (role, copies, vector)
        left = sides.get(0, {})
        right = sides.get(1, left)
        same = 1 not in sides
        if len(left) < 1 or (same and len(left) < 2):
            return
        ids_l, ids_r = np.array(list(left)), np.array(list(right))
        role_l, role_r = (np.array([v[0] for v in s.values()]) for s in (left, right))
        copies_l, copies_r = (np.array([v[1] for v in s.values()]) for s in (left, right))
        u_l, u_r = (units(np.array([np.frombuffer(v[2], "<f8") for v in s.values()])) for s in (left, right))
        close = (u_l @ u_r.T >= cosine) & ((role_l[:, None] == 0) | (role_r[None, :] == 0))
        close &= ids_l[:, None] != ids_r[None, :]
        if same:
            close = np.triu(close, 1)
        i, j = close.nonzero()
        if not len(i):
            return
        # The first table in which the pair meets, and in it the smaller of the cells where it does.
        used_l, used_r = np.unique(i), np.unique(j)
        keys_l, keys_r = (cells(u[k], tables, probes, width, seed) for u, k in ((u_l, used_l), (u_r, used_r)))
        first = np.ones(len(i), bool)
        for lo in range(0, len(i), 4096):
            s = slice(lo, lo + 4096)
            a, b = keys_l[np.searchsorted(used_l, i[s])], keys_r[np.searchsorted(used_r, j[s])]
            meets_a = (a[:, :, :1] == b).any(axis=2)  # at a's own cell
            meets_b = (b[:, :, :1] == a).any(axis=2)
            table = (meets_a | meets_b).argmax(axis=1)
            k = np.arange(len(table))
            own_a, own_b = a[k, table, 0], b[k, table, 0]
            at_a, at_b = meets_a[k, table], meets_b[k, table]
            first[s] = np.where(at_a & at_b, np.minimum(own_a, own_b), np.where(at_a, own_a, own_b)) == cell
        i, j = i[first], j[first]
        for ids, links in ((ids_l, np.bincount(i, weights=copies_r[j], minlength=len(ids_l))),
                           (ids_r, np.bincount(j, weights=copies_l[i], minlength=len(ids_r)))):
            out.extend((0, int(ids[k]), None, int(links[k])) for k in links.nonzero()[0])
        root = {}

        def find(x):
            while root.get(x, x) != x:
                root[x] = x = root.get(root[x], root[x])
            return x

        for x, y in zip(ids_l[i].tolist(), ids_r[j].tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((1, x, y, None))

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        task, rows, out = None, [], []

        def batch_of(found):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()),
                                                strict=True)], names=["kind", "rep", "other", "links"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != task:
                    if rows:
                        compare(rows, out)
                    task, rows = row[0], []
                rows.append(row)
            if out:
                yield batch_of(out)
                out = []
        if rows:
            compare(rows, out)
        if out:
            yield batch_of(out)
    return count


def _packed(batches: Iterator) -> Iterator:
    """Vectors as bytes of doubles; rows that cannot link go."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        ids, labels, out = [], [], []
        for vec_id, vector, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            v = np.array([np.nan if x is None else x for x in vector or ()], dtype=np.float64)
            if len(v) and np.isfinite(v).all() and v.any():
                ids.append(vec_id)
                labels.append(label)
                out.append((v + 0.0).astype("<f8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int32()),
                                          pa.array([len(x) // 8 for x in out], pa.int32()), pa.array(out, pa.binary())],
                                         names=["vec_id", "label", "dim", "vector"])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    *, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH,
                    seed: int = SEED) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and their cosine is at least ``cosine``; of unequal lengths, never.
    A vector that is null, empty, zero or holds null or non-finite components, or whose label is null, links
    with nothing, and so does one without an id, which is kept with a null component. Rows that repeat an id
    are one node: each returned row has the links of all of them, counted by rows. Other columns are ignored.
    An empty table gives no rows.
    """
    spark = vectors.sparkSession
    stage = Stage(spark, "lattice")
    rows = narrow(vectors, vec_id=id_col, vector=vector_col, label=label_col)
    usable = stage.table(
        rows.where("vec_id is not null and label is not null and vector is not null")
        .select("vec_id", "vector", F.col("label").cast("int").alias("label"))
        .mapInArrow(_packed, "vec_id long, label int, dim int, vector binary"), "usable")
    classes = stage.table(usable.groupBy("label", "dim", "vector").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
        .withColumn("class", F.xxhash64("label", "rep", "vector")), "classes")

    entries = stage.table(classes.select("label", F.col("class").alias("rep"), "dim", "vector").mapInArrow(
        _hasher(tables, probes, width, seed), "label int, rep long, dim int, cell long, role int"), "entries")
    met = (entries.groupBy("label", "dim", "cell").agg(F.count("*").alias("n"), F.min("role").alias("own"))
           .where("n > 1 and own = 0").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")))
    inside = entries.join(met.select("label", "dim", "cell", "blocks"), ["label", "dim", "cell"])
    # Block b is compared with itself and every other block; a task (b, c) has b as its left side, c as its right.
    block = F.when(F.col("blocks") == 1, 0).otherwise(F.pmod(F.xxhash64("rep", "cell"), F.col("blocks"))).cast("int")
    dealt = inside.withColumn("b", block).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        F.xxhash64("label", "dim", "cell", F.least("b", "with"), F.greatest("b", "with")).alias("task"), "cell",
        (F.col("b") > F.col("with")).cast("int").alias("side"), "role", "rep")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    filled = dealt.join(classes.select(F.col("class").alias("rep"), "copies", "vector"), "rep").select(
        "task", "cell", "side", "role", "rep", "copies", "vector")
    found = stage.table(filled.repartition(n, "task").sortWithinPartitions("task")
                        .mapInArrow(_counter(cosine, tables, probes, width, seed),
                                    "kind int, rep long, other long, links long"), "found")
    links = found.where("kind = 0").groupBy("rep").agg(F.sum("links").alias("links"))
    own = stage.table(usable.join(classes.drop("rep"), ["label", "dim", "vector"])
                      .join(links.withColumnRenamed("rep", "class"), "class", "left")
                      .select("vec_id", "class", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")), "own")
    names = classes.select("class", "rep")
    pairs = (found.where("kind = 1").select(F.col("rep").alias("class"), "other").join(names, "class")
             .select("other", F.col("rep").alias("u"))
             .join(names.select(F.col("class").alias("other"), F.col("rep").alias("v")), "other").select("u", "v"))
    copies = own.join(names, "class").where("vec_id <> rep").select(F.col("vec_id").alias("u"), F.col("rep").alias("v"))
    parts = stage.table(connected_components(pairs.union(copies), stage), "parts")
    linked = own.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    stage.drop("entries", "found", "usable", "classes")
    return (rows.select("vec_id").join(linked, "vec_id", "left")
            .join(parts.withColumnRenamed("node", "vec_id"), "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
