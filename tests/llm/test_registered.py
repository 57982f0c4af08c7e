"""The registered embedding queries, on their own tables, against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from ledgerleaf.llm import queries

SF = ("/root/testdata/sf0.001", "/root/testdata/sf0.1")


def vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ok = [r for r in rows if r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding)
          and any(r.embedding)]
    ids = np.array([r.vec_id for r in ok])
    return ids, np.array([r.embedding for r in ok], dtype=np.float64), [r.label for r in ok], [r.vec_id for r in rows]


@pytest.mark.parametrize("sf_dir", SF)
def test_op8_finds_every_link(spark, sf_dir):
    ids, x, labels, every = vectors(spark, sf_dir)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links, parent = dict.fromkeys(every, 0), {i: i for i in every}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for label in {v for v in labels if v is not None}:
        at = np.flatnonzero([v == label for v in labels])
        near = unit[at] @ unit[at].T >= 0.93
        np.fill_diagonal(near, False)
        for a, b in zip(*np.nonzero(near)):
            links[ids[at[a]]] += 1
            ra, rb = root(ids[at[a]]), root(ids[at[b]])
            parent[max(ra, rb)] = min(ra, rb)
    got = {r.vec_id: r for r in queries.op8_lattice_near_dedup(spark, sf_dir).collect()}
    assert sorted(got) == sorted(every)
    assert sum(r.n_links for r in got.values()) == sum(links.values())
    assert {i: r.n_links for i, r in got.items()} == links
    assert {i: r.component_id for i, r in got.items()} == {i: root(i) for i in every}
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


@pytest.mark.parametrize("sf_dir", SF)
def test_op9_recall_and_scores(spark, sf_dir):
    ids, x, _, _ = vectors(spark, sf_dir)
    got: dict[int, list] = {}
    for r in queries.op9_graph_search(spark, sf_dir).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    wanted = np.flatnonzero(ids % 20 == 0)
    assert sorted(got) == sorted(ids[wanted])
    found = total = 0
    place = {int(v): n for n, v in enumerate(ids)}
    for q in wanted:
        scores = x @ x[q]
        order = [n for n in np.lexsort((ids, -scores)) if n != q][:20]
        rows = sorted(got[ids[q]])
        assert [rank for rank, _, _ in rows] == list(range(1, len(order) + 1))
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        assert np.allclose([s for _, _, s in rows], [scores[place[v]] for _, v, _ in rows], rtol=1e-12, atol=1e-12)
        found += len({v for _, v, _ in rows} & {int(ids[n]) for n in order})
        total += len(order)
    assert found >= 0.9 * total
