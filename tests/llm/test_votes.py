"""The quality query against a naive vote: every labelled vector is compared and sorted, document by document."""

from __future__ import annotations

import math
import zlib

import numpy as np

from ledgerleaf.llm import quality, queries

SF = "/root/testdata/sf0.001"


def test_op6_equals_a_naive_vote(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    idf, axes, vectors, votes, prior = quality.fit(docs, labels, "quality", modulus=5, held_out=0).value
    taught = {r.doc_id for r in labels.collect() if r.quality is not None and r.doc_id is not None
              and zlib.crc32(str(r.doc_id).encode()) % 5 != 0}
    assert len(votes) <= len(taught) and 0 < prior < 1
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in queries.op6_quality_neighbours(spark, SF).collect()}
    assert sorted(got) == sorted(texts)
    compared = 0
    for doc_id, text in texts.items():
        assert got[doc_id].held_out == (zlib.crc32(str(doc_id).encode()) % 5 == 0)
        assert got[doc_id].predicted == int(got[doc_id].score >= 0.3)
        z = (np.log1p(quality.term_counts([(text or "").encode()])[0]) * idf) @ axes
        norm = math.sqrt(float((z.astype(np.float64) ** 2).sum()))
        if norm <= 1e-9:
            assert got[doc_id].score == prior
            continue
        cosines = sorted(((float((z / norm).astype(np.float64) @ v.astype(np.float64)), y)
                          for v, y in zip(vectors, votes, strict=True)), reverse=True)
        near = cosines[:quality.NEAREST]
        if len(cosines) > len(near) and near[-1][0] - cosines[len(near)][0] < 1e-5:
            continue                # a tie at the border: either neighbour may vote
        weights = [math.exp(quality.SHARPNESS * c) for c, _ in near]
        want = sum(w * y for w, (_, y) in zip(weights, near, strict=True)) / sum(weights)
        assert abs(got[doc_id].score - want) < 1e-3
        compared += 1
    assert compared > len(texts) / 4
