"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Vectors become integers, rows are ordered by label and by their place on a Hilbert curve, and are written to
Parquet in blocks of one label, one row per block, with the least and largest value of every dimension (the zone
map). For an anchor, interval arithmetic on a zone map bounds every score in the block from both sides. A window
(score range, number wanted) needs a block only if the bounds meet its range and reach its worst score so far.

Two searches run: the anchor's positives (its best rows of the same label), then, per positive, the best rows of
other labels inside the window that its score opens. Each has two rounds: the most promising block of every anchor
first, whose results raise the worst score to beat, then all other blocks that the bounds leave. Chosen
blocks alone are read and multiplied, group by group, with all anchors that need them. Results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, finite_vectors, narrow, packed_rows, unpacked_rows

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOWEST, HIGHEST = 30, 90   # a negative scores from 30 to 90 hundredths of its positive
BLOCK_ROWS = 512
GROUP_ROWS, GROUPS = 1 << 17, 64  # rows of a group of blocks, at most; groups that small tables are cut into
PART_ANCHORS = 1 << 14     # anchors that meet a group at a time
BITS = 4                   # of a coordinate on the curve
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def hilbert(cells, bits: int):
    """(n, bytes) uint8 keys that order non-negative integer points (n, d) of ``bits`` bits along a Hilbert curve."""
    import numpy as np

    x = np.ascontiguousarray(cells.T).astype(np.uint32)
    d = len(x)
    # Undo the excess work of the curve's rotations from the highest bit down, then apply the Gray code.
    q = 1 << (bits - 1)
    while q > 1:
        p = np.uint32(q - 1)
        for i in range(d):
            high = (x[i] & np.uint32(q)) != 0
            swap = np.where(high, np.uint32(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[d - 1] & np.uint32(q)) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= flip
    planes = np.stack([(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)])  # bits, d, n
    return np.packbits(planes.reshape(bits * d, -1).astype(np.uint8), axis=0).T


def bounds(anchors, low, high):
    """(least, largest) score that any vector between ``low`` and ``high`` can have, (anchors, blocks), as doubles that
    are widened where they are not exact."""
    import numpy as np

    a, lo, hi = (v.astype(np.float64) for v in (anchors, low, high))
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    most, least = up @ hi.T + down @ lo.T, up @ lo.T + down @ hi.T
    reach = np.abs(a) @ np.maximum(np.abs(lo), np.abs(hi)).T
    slack = np.where(reach < 2.0 ** 52, 0.0, reach * 1e-12)
    return least - slack, most + slack


def products(anchors, vectors):
    """Exact integer inner products (anchors, vectors): by doubles while these hold them, else by 64-bit integers."""
    import numpy as np

    reach = float(np.abs(anchors).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, anchors.shape[1])
    if reach < 2.0 ** 53:
        return anchors.astype(np.float64) @ vectors.T.astype(np.float64)
    return anchors.astype(np.int64) @ vectors.T.astype(np.int64)


class Best:
    """The best ``k`` (score, smaller id first) of many groups, with the worst of a full group as its floor."""

    def __init__(self, k: int, floor, floor_id):
        import numpy as np

        self.k, self.floor, self.floor_id = k, floor.copy(), floor_id.copy()
        self.kept = tuple(np.empty(0, np.int64) for _ in range(3))
        self.waiting, self.size = [], 0

    def add(self, group, ids, score):
        self.waiting.append((group, ids, score))
        self.size += len(group)
        if self.size > 200_000:
            self.trim()

    def trim(self):
        import numpy as np

        if not self.waiting:
            return
        group, ids, score = (np.concatenate(c) for c in zip(self.kept, *self.waiting, strict=True))
        order = np.lexsort((ids, -score, group))
        group, ids, score = group[order], ids[order], score[order]
        _, at, count = np.unique(group, return_index=True, return_counts=True)
        nth = np.arange(len(group)) - np.repeat(at, count)
        keep = nth < self.k
        last = np.flatnonzero(nth == self.k - 1)
        better = last[(score[last] > self.floor[group[last]])
                      | ((score[last] == self.floor[group[last]]) & (ids[last] < self.floor_id[group[last]]))]
        self.floor[group[better]], self.floor_id[group[better]] = score[better], ids[better]
        self.kept = group[keep], ids[keep], score[keep]
        self.waiting, self.size = [], 0


def _packed(scale: int):
    """(vec_id, label, vector) to integer rows; those that take no part go."""
    def pack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at, c in finite_vectors(batch.column(2)):
                x, d = np.floor(scale * c), c.shape[1]
                small = (np.abs(x) <= min(2.0 ** 31 - 1, (2.0 ** 62 / d) ** 0.5)).all(axis=1)
                take = pa.array(at[small])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(np.full(len(take), d), pa.int32()),
                     packed_rows(x[small])], names=["vec_id", "label", "dim", "x"])
    return pack


def _moments(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    n, s, ss = 0, 0.0, 0.0
    for batch in batches:
        for x in batch.column(0):
            v = np.frombuffer(x.as_buffer(), "<i4").astype(np.float64)
            n, s, ss = n + len(v), s + float(v.sum()), ss + float((v * v).sum())
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s]), pa.array([ss])], names=["n", "s", "ss"])


def _placer(mean: float, sd: float):
    """Adds a row's place on the curve; coordinates are cut into cells from two deviations below the mean to two above."""
    def place(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            dims, keys = batch.column(2).to_numpy(), np.empty(batch.num_rows, dtype=object)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = unpacked_rows(batch.column(3).take(pa.array(at)).to_pylist(), int(dim))
                cells = np.clip((x - (mean - 2 * sd)) / (4 * sd) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint32)
                keys[at] = [k.tobytes() for k in hilbert(cells, BITS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.tolist(), pa.binary())],
                                             names=[*batch.schema.names, "key"])
    return place


def _blocks(block_rows: int):
    """Rows in curve order to blocks of one label and length; equal rows are one."""
    def build(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        names = ["group", "place", "label", "dim", "others", "first_id", "low", "high", "ids", "x"]
        types = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
        group, place, kind, rows = TaskContext.get().partitionId(), 0, None, []

        def block():
            ids, x = np.array([r[0] for r in rows], "<i8"), unpacked_rows([r[1] for r in rows], kind[1])
            others = len(ids) - np.unique(ids, return_counts=True)[1].max()  # rows of other ids than any one
            return (group, place, *kind, int(others), int(ids.min()), x.min(axis=0).tobytes(), x.max(axis=0).tobytes(),
                    ids.tobytes(), x.tobytes())

        for batch in batches:
            out = []
            for vec_id, label, dim, x in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                if rows and (kind != (label, dim) or len(rows) >= block_rows):
                    if kind == (label, dim) and rows[-1] == (vec_id, x):
                        continue
                    out.append(block())
                    place, rows = place + 1, []
                kind = (label, dim)
                if not rows or rows[-1] != (vec_id, x):
                    rows.append((vec_id, x))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                                                 names=names)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[block()], strict=True), types, strict=True)],
                                             names=names)
    return build


def _windows(column):
    """(row, number in it, lowest, highest, floor, floor_id) of all windows of the rows, as flat arrays."""
    import numpy as np

    flat = [np.asarray(w, dtype=np.int64).reshape(-1, 4) for w in column]
    count = np.array([len(w) for w in flat])
    row = np.repeat(np.arange(len(flat)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    every = np.concatenate(flat) if flat else np.empty((0, 4), np.int64)
    return row, nth, *every.T


def _chooser(same: bool, k: int, seed: bool):
    """Anchors and zone maps to the blocks needed: a row per anchor and group of blocks with its ``places`` in the group,
    and one (``whole``) with the places that any of the anchors needs. ``seed``: only the best block of each window."""
    def choose(anchors, zones):
        import numpy as np
        import pandas as pd

        out = []
        for dim in (sorted(set(anchors["dim"]) & set(zones["dim"])) if len(anchors) and len(zones) else ()):
            z, of_dim = zones[zones["dim"] == dim], anchors[anchors["dim"] == dim]
            low, high = unpacked_rows(z["low"], dim), unpacked_rows(z["high"], dim)
            others, first, group, place = (z[c].to_numpy() for c in ("others", "first_id", "group", "place"))
            label = pd.factorize(np.concatenate([z["label"].to_numpy(), of_dim["label"].to_numpy()]))[0]
            step = max(1, (1 << 21) // len(z))
            for lo in range(0, len(of_dim), step):
                a = of_dim.iloc[lo:lo + step]
                least, most = bounds(unpacked_rows(a["x"], dim), low, high)
                fits = (label[len(z) + lo:len(z) + lo + len(a), None] == label[None, :len(z)]) == same
                row, _, bottom, top, floor, floor_id = _windows(a["windows"])
                ids, need = a["vec_id"].to_numpy(), np.zeros(least.shape, dtype=bool)
                for w in range(0, len(row), step):
                    r = row[w:w + step]
                    b, t, f, f_id = (v[w:w + step, None] for v in (bottom, top, floor, floor_id))
                    ok = fits[r] & (least[r] <= t) & (most[r] >= b)
                    if seed:
                        best = np.where(ok, most[r], -np.inf).argmax(axis=1)
                        hit = ok[np.arange(len(r)), best]
                        need[r[hit], best[hit]] = True
                        continue
                    # A block that lies in the window and has k rows of other ids vouches for its least score.
                    sure = ok & (least[r] >= b) & (most[r] <= t) & (others >= k)
                    vouched = np.where(sure, np.floor(least[r]), -np.inf).max(axis=1, keepdims=True)
                    beats = (most[r] > f) | ((most[r] == f) & (first <= f_id))
                    np.logical_or.at(need, r, ok & beats & (most[r] >= vouched))
                for g in np.unique(group):
                    at = np.flatnonzero(group == g)
                    some = need[:, at]
                    asking = np.flatnonzero(some.any(axis=1))
                    out += [(int(g), int(ids[i]), False, place[at[some[i]]]) for i in asking]
                    if len(asking):
                        out.append((int(g), 0, True, place[at[some.any(axis=0)]]))
        found = pd.DataFrame(out, columns=["group", "vec_id", "whole", "places"])
        found["part"] = int(anchors["part"].iloc[0]) if out else 0
        return found
    return choose


def _reader(k: int):
    """Anchors with the places they need and the chosen blocks of a group to the best rows of each window."""
    def read(anchors, blocks):
        import numpy as np
        import pandas as pd

        row, nth, bottom, top, floor, floor_id = _windows(anchors["windows"])
        best, ids_a = Best(k, floor, floor_id), anchors["vec_id"].to_numpy()
        places = np.concatenate([*anchors["places"], np.empty(0, np.int64)]).astype(np.int64)
        owner = np.repeat(np.arange(len(anchors)), [len(p) for p in anchors["places"]])
        order = np.argsort(places, kind="stable")
        places, owner = places[order], owner[order]
        window_of = np.searchsorted(row, np.arange(len(anchors) + 1))
        for b in blocks.itertuples():
            asking = owner[slice(*np.searchsorted(places, (b.place, b.place + 1)))]
            ids, x = np.frombuffer(b.ids, "<i8"), unpacked_rows([b.x], b.dim)
            kk = min(k, len(ids))
            for lo in range(0, len(asking), 256):
                who = asking[lo:lo + 256]
                score = products(unpacked_rows(anchors["x"].iloc[who], b.dim), x)
                other = ids_a[who][:, None] != ids[None, :]
                win = np.concatenate([np.arange(window_of[i], window_of[i + 1]) for i in who])
                mine = np.searchsorted(who, row[win])
                s = score[mine]
                ok = other[mine] & (s >= np.maximum(bottom[win], best.floor[win])[:, None]) & (s <= top[win][:, None])
                if ok.sum() > 4 * k * len(win):  # only the best k of the block, and what ties with the last
                    inside = np.where(ok, s, LEAST)
                    ok &= s >= np.partition(inside, -kk, axis=1)[:, -kk, None]
                i, j = ok.nonzero()
                best.add(win[i], ids[j], s[i, j].astype(np.int64))
        best.trim()
        window, ids, score = best.kept
        return pd.DataFrame({"anchor_id": ids_a[row[window]], "w": nth[window].astype(np.int32), "vec_id": ids, "score": score})
    return read


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each window, with their rank."""
    order = Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Index:
    """A table's blocks in the order of the curve, their zone maps, and exact window searches over them."""

    def __init__(self, usable: DataFrame, stage: Stage, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS):
        self.stage = stage
        n, s, ss = usable.select("x").mapInArrow(_moments, "n long, s double, ss double").agg(
            F.sum("n"), F.sum("s"), F.sum("ss")).first()
        mean = s / n if n else 0.0
        sd = max(ss / n - mean * mean, 1.0) ** 0.5 if n else 1.0
        rows = usable.count()
        groups = max(1, -(-rows // group_rows), min(GROUPS, -(-rows // (4 * block_rows))))
        order = ("label", "dim", "key", "vec_id", "x")
        keyed = stage.table(usable.mapInArrow(
            _placer(mean, sd), "vec_id long, label string, dim int, x binary, key binary"), "keyed")
        self.blocks = stage.table(
            keyed.repartitionByRange(groups, *order).sortWithinPartitions(*order).mapInArrow(
                _blocks(block_rows), "group int, place int, label string, dim int, others int, first_id long, low binary, "
                                     "high binary, ids binary, x binary"), "blocks")
        stage.drop("keyed")
        self.zones = self.blocks.select("group", "place", "label", "dim", "others", "first_id", "low", "high")
        self.zone_parts = max(1, -(-self.zones.count() // (1 << 14)))

    def _round(self, asked: DataFrame, parts: int, name: str, same: bool, k: int, seed: bool) -> DataFrame:
        """The best rows of each window in the blocks that the bounds choose."""
        zone = F.pmod(F.hash("group"), F.lit(self.zone_parts))
        zones = (self.zones.withColumn("zone", zone)
                 .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))))
        anchors = asked.withColumn("zone", F.explode(F.sequence(F.lit(0), F.lit(self.zone_parts - 1))))
        chosen = self.stage.table(anchors.groupBy("zone", "part").cogroup(zones.groupBy("zone", "part")).applyInPandas(
            _chooser(same, k, seed), "group int, part int, vec_id long, whole boolean, places array<int>"), f"{name}-chosen")
        wanted = chosen.where("whole").select("group", "part", F.explode("places").alias("place")).distinct()
        blocks = self.blocks.select("group", "place", "dim", "ids", "x").join(wanted, ["group", "place"])
        asking = chosen.where("not whole").drop("whole", "part").join(asked, "vec_id")
        return self.stage.table(asking.groupBy("group", "part").cogroup(blocks.groupBy("group", "part")).applyInPandas(
            _reader(k), "anchor_id long, w int, vec_id long, score long"), f"{name}-found")

    def search(self, anchors: DataFrame, windows: DataFrame, name: str, same: bool, k: int) -> DataFrame:
        """(anchor_id, w, rank, vec_id, score): the first k rows, of the anchor's label or of others, whose score is
        from ``bottom`` to ``top``; ``windows`` has rows (vec_id, w, bottom, top) with w from 0 for each anchor."""
        parts = max(1, -(-anchors.count() // PART_ANCHORS))
        dealt = anchors.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))

        def asked(of: DataFrame) -> DataFrame:
            each = F.struct("w", F.array("bottom", "top", "floor", "floor_id").alias("v"))
            lists = of.groupBy("vec_id").agg(F.sort_array(F.collect_list(each)).alias("l"))
            return dealt.join(lists.select("vec_id", F.flatten(F.transform("l", lambda x: x["v"])).alias("windows")), "vec_id")

        opened = windows.withColumns({"floor": F.lit(LEAST), "floor_id": F.lit(MOST)})
        first = self._round(asked(opened), parts, f"{name}-seed", same, k, True)
        floors = _ranked(first, k).where(F.col("rank") == k).select(
            F.col("anchor_id").alias("vec_id"), "w", F.col("score").alias("floor"), F.col("vec_id").alias("floor_id"))
        raised = windows.join(floors, ["vec_id", "w"], "left").withColumns({
            "floor": F.coalesce("floor", F.lit(LEAST)), "floor_id": F.coalesce("floor_id", F.lit(MOST))})
        return _ranked(self._round(asked(raised), parts, name, same, k, False), k)


def mine(vectors: DataFrame, is_anchor: Column | str, id_col: str = "vec_id", vector_col: str = "embedding",
         label_col: str = "label", *, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST,
         highest: int = HIGHEST, scale: int = SCALE, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on vec_id. An anchor's positives are the ``positives`` best other rows of its label; the
    negatives of a positive are the ``negatives`` best rows of other labels that score from ``lowest`` to ``highest``
    hundredths of it. Higher scores come first, ties by smaller id. A positive without negatives has no rows.

    Rows without an id or label, and vectors that are null or empty or hold null or non-finite components, take no
    part, nor do vectors whose integers are so large that scores would not fit a long. Vectors of unequal lengths do
    not meet. Equal rows are one; rows that share an id but not their vector or label are rows of their own, of which
    the first by label and vector is the anchor. Other columns are ignored. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    stage = Stage(spark, "negatives")
    rows = narrow(vectors, vec_id=id_col, label=label_col, vector=vector_col)
    usable = stage.table(
        rows.where("vec_id is not null and label is not null and vector is not null")
        .select("vec_id", F.col("label").cast("string").alias("label"), "vector")
        .mapInArrow(_packed(scale), "vec_id long, label string, dim int, x binary"), "usable")
    anchors = stage.table(usable.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "dim", "x")).alias("r"))
                          .select("vec_id", "r.*"), "anchors")
    index = Index(usable, stage, block_rows, group_rows)
    everything = anchors.select("vec_id", F.lit(0).alias("w"), F.lit(LEAST).alias("bottom"), F.lit(MOST).alias("top"))
    near = stage.table(index.search(anchors, everything, "positives", True, positives).select(
        "anchor_id", (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score")), "near")
    score = F.col("positive_score").cast("decimal(20,0)")
    windows = near.select(F.col("anchor_id").alias("vec_id"), "w", F.ceil(score * lowest / 100).cast("long").alias("bottom"),
                          F.floor(score * highest / 100).cast("long").alias("top"))
    hard = index.search(anchors, windows, "negatives", False, negatives)
    return hard.join(near, ["anchor_id", "w"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
