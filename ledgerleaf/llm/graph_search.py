"""Nearest neighbours by largest inner product on a robust-pruned directed graph per shard.

Rows are dealt to shards of bounded size by a hash. A shard's graph takes its vectors in growing batches:
a greedy beam search proposes neighbours, and pruning with a relaxed distance drops a candidate that a
nearer kept neighbour already leads to, so that near and far edges stay. An extra component that makes all
norms equal turns largest inner product into smallest distance. Queries meet every shard in blocks; a
beam search proposes candidates, their inner products are computed in double precision on the original
components, and the shards' best are merged. Equal vectors of a shard are one node with all their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, narrow

NEAREST, SHARD_ROWS, QUERY_ROWS = 20, 8192, 4096
DEGREE, ALPHA, BUILD_BEAM, SEARCH_BEAM, ENTRIES, SEED = 32, 1.2, 64, 128, 32, 5


def beam_search(queries, points, graph, entries, beam: int):
    """(ids, scores) of the beam of each query, best first; -1 where it is not full. All queries advance together,
    each by its best node not yet expanded."""
    import numpy as np

    q, n = len(queries), len(points)
    seen = np.zeros((q, n), dtype=bool)
    first = np.broadcast_to(entries, (q, len(entries)))
    seen[:, entries] = True
    ids = np.full((q, beam + graph.shape[1]), -1, dtype=np.int64)
    score = np.full(ids.shape, -np.inf, dtype=np.float32)
    opened = np.ones(ids.shape, dtype=bool)
    k = min(beam, len(entries))
    value = queries @ points[entries].T
    top = np.argsort(-value, axis=1, kind="stable")[:, :k]
    ids[:, :k], score[:, :k], opened[:, :k] = np.take_along_axis(first, top, 1), np.take_along_axis(value, top, 1), False
    active = np.arange(q)
    while len(active):
        waiting = np.where(opened[active, :beam], -np.inf, score[active, :beam])
        best = waiting.argmax(axis=1)
        go = waiting[np.arange(len(active)), best] > -np.inf
        active, best = active[go], best[go]
        if not len(active):
            break
        opened[active, best] = True
        near = graph[ids[active, best]]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        seen[active[:, None], np.where(near >= 0, near, ids[active, best][:, None])] = True
        value = np.einsum("qd,qkd->qk", queries[active], points[near])
        ids[active, beam:] = np.where(fresh, near, -1)
        score[active, beam:] = np.where(fresh, value, -np.inf)
        opened[active, beam:] = ~fresh
        order = np.argsort(-score[active], axis=1, kind="stable")
        for table in (ids, score, opened):
            table[active] = np.take_along_axis(table[active], order, 1)
    return ids[:, :beam], score[:, :beam]


def prune(of, candidates, points, degree: int, alpha: float):
    """(n, degree) kept neighbours of each node, nearest first, -1 where there are no more. ``points`` have equal
    norms, so 2 (m - x.y) is the squared distance."""
    import numpy as np

    m = float((points[0] ** 2).sum()) if len(points) else 0.0
    own, at = points[of], points[candidates]
    far = 2 * (m - np.einsum("nd,nkd->nk", own, at))
    out = (candidates < 0) | (candidates == of[:, None])
    order = np.argsort(np.where(out, np.inf, far), axis=1, kind="stable")
    candidates, far, out = (np.take_along_axis(x, order, 1) for x in (candidates, far, out))
    at = points[candidates]
    kept = np.full((len(of), degree), -1, dtype=np.int64)
    for k in range(degree):
        pick = (~out).argmax(axis=1)
        row = np.flatnonzero(~out[np.arange(len(of)), pick])
        if not len(row):
            break
        chosen = candidates[row, pick[row]]
        kept[row, k] = chosen
        between = 2 * (m - np.einsum("nd,nkd->nk", points[chosen], at[row]))
        out[row] |= alpha * alpha * between <= far[row]
        out[row] |= candidates[row] == chosen[:, None]
    return kept


def build(vectors, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BUILD_BEAM):
    """(order, points, graph): the graph over equal-norm points in insertion order; entry nodes come first."""
    import numpy as np

    norms = np.linalg.norm(vectors, axis=1)
    scale = norms.max()
    x = vectors / scale
    extra = np.sqrt(np.maximum(0.0, 1.0 - (x ** 2).sum(axis=1)))
    order = np.random.default_rng(SEED).permutation(len(x))
    points = np.column_stack([x, extra])[order].astype(np.float32)
    n = len(points)
    graph = np.full((n, degree), -1, dtype=np.int64)
    done = min(n, 2 * degree)
    start = np.arange(done)
    graph[:done] = prune(start, np.tile(start, (done, 1)), points, degree, alpha)
    while done < n:
        new = np.arange(done, min(n, done + min(done, 512)))
        found, _ = beam_search(points[new], points, graph, np.arange(min(ENTRIES, done)), beam)
        graph[new] = prune(new, found, points, degree, alpha)
        # Backward edges; a node with too many prunes its nearest ones.
        tail, head = np.repeat(new, degree), graph[new].ravel()
        tail, head = tail[head >= 0], head[head >= 0]
        by = np.lexsort((-np.einsum("nd,nd->n", points[tail], points[head]), head))
        tail, head = tail[by], head[by]
        target, at, count = np.unique(head, return_index=True, return_counts=True)
        nth = np.arange(len(head)) - np.repeat(at, count)
        few = nth < 3 * degree
        more = np.full((len(target), 3 * degree), -1, dtype=np.int64)
        more[np.repeat(np.arange(len(target)), count)[few], nth[few]] = tail[few]
        more = more[:, :max(1, min(3 * degree, int(count.max(initial=0))))]
        joined = np.column_stack([graph[target], more])
        room = (joined >= 0).sum(axis=1) <= degree
        packed = np.take_along_axis(joined[room], np.argsort(joined[room] < 0, axis=1, kind="stable"), 1)[:, :degree]
        graph[target[room]] = packed
        if not room.all():
            graph[target[~room]] = prune(target[~room], joined[~room], points, degree, alpha)
        done = new[-1] + 1
    return order, points, graph


def _indexer(degree: int, alpha: float, beam: int):
    def index(rows):
        import numpy as np
        import pandas as pd

        rows = rows.sort_values("vec_id", kind="stable")
        members: dict[bytes, list[int]] = {}
        for vec_id, vector in zip(rows["vec_id"], rows["vector"], strict=True):
            own = members.setdefault(bytes(vector), [])
            if own[-1:] != [vec_id]:
                own.append(int(vec_id))
        keys = sorted(members)
        vectors = np.array([np.frombuffer(k, "<f8") for k in keys])
        order, _, graph = build(vectors, degree, alpha, beam)
        return pd.DataFrame({
            "dim": rows["dim"].iloc[0], "shard": rows["shard"].iloc[0], "node": np.arange(len(keys)),
            "ids": [members[keys[i]] for i in order], "vector": [keys[i] for i in order],
            "neighbours": [g.astype("<i4").tobytes() for g in graph]})
    return index


def _searcher(nearest: int, beam: int):
    def search(queries, nodes):
        import numpy as np
        import pandas as pd

        empty = pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        if not len(queries) or not len(nodes):
            return empty
        nodes = nodes.sort_values("node")
        vectors = np.array([np.frombuffer(v, "<f8") for v in nodes["vector"]])
        graph = np.array([np.frombuffer(g, "<i4") for g in nodes["neighbours"]], dtype=np.int64)
        members = nodes["ids"].tolist()
        points = (vectors / np.linalg.norm(vectors, axis=1).max()).astype(np.float32)
        asked = np.array([np.frombuffer(v, "<f8") for v in queries["vector"]])
        norm = np.linalg.norm(asked, axis=1, keepdims=True)
        out = []
        for lo in range(0, len(asked), 256):
            found, _ = beam_search((asked[lo:lo + 256] / norm[lo:lo + 256]).astype(np.float32), points, graph,
                                   np.arange(min(ENTRIES, len(points))), beam)
            exact = np.einsum("qd,qkd->qk", asked[lo:lo + 256], vectors[found])
            for query_id, near, score in zip(queries["vec_id"].iloc[lo:lo + 256].tolist(), found, exact, strict=True):
                order = np.argsort(np.where(near < 0, np.inf, -score), kind="stable")
                best, worst = {}, None
                for k in order:
                    # All nodes that tie with the last wanted one come along, as the smaller ids win.
                    if near[k] < 0 or (worst is not None and score[k] < worst):
                        break
                    for i in members[near[k]][:nearest + 1]:
                        if i != query_id:
                            best.setdefault(i, score[k])
                    if len(best) >= nearest and worst is None:
                        worst = score[k]
                out += [(query_id, i, -s) for s, i in sorted((-s, i) for i, s in best.items())[:nearest]]
        if not out:
            return empty
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
    return search


def _usable(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        ids, out = [], []
        for vec_id, vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            v = np.array([np.nan if x is None else x for x in vector or ()], dtype=np.float64)
            if len(v) and np.isfinite(v).all() and v.any():
                ids.append(vec_id)
                out.append((v + 0.0).astype("<f8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x) // 8 for x in out], pa.int32()),
                                          pa.array(out, pa.binary())], names=["vec_id", "dim", "vector"])


def search(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", *,
           nearest: int = NEAREST, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, degree: int = DEGREE,
           alpha: float = ALPHA, build_beam: int = BUILD_BEAM, search_beam: int = SEARCH_BEAM) -> DataFrame:
    """For each query: query_id, rank (from 1), vec_id, score; nearest first, ties to the smaller vec_id.

    ``is_query`` is a condition on vec_id. A query's own id is no candidate; a query has fewer rows where there
    are fewer candidates. Vectors that are null, empty, zero or hold null or non-finite components, rows without
    an id, and candidates of another length take no part. Rows that repeat an id are one query (the smallest
    vector of them) and one candidate, with its best score. Other columns are ignored. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    stage = Stage(spark, "graph")
    usable = stage.table(narrow(vectors, vec_id=id_col, vector=vector_col).where("vec_id is not null and vector is not null")
                         .mapInArrow(_usable, "vec_id long, dim int, vector binary"), "usable")
    total = usable.count()
    shards = max(1, -(-total // shard_rows))
    dealt = usable.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int"))
    nodes = stage.table(dealt.groupBy("dim", "shard").applyInPandas(
        _indexer(degree, alpha, build_beam),
        "dim int, shard int, node int, ids array<long>, vector binary, neighbours binary"), "nodes")
    queries = stage.table(usable.where(is_query).groupBy("vec_id", "dim").agg(F.min("vector").alias("vector")), "queries")
    parts = max(1, -(-queries.count() // query_rows))
    asked = (queries.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(parts)).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    index = nodes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    keys = ("dim", "shard", "part")
    found = asked.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInPandas(
        _searcher(nearest, search_beam), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest)
            .select("query_id", "rank", "vec_id", "score"))
