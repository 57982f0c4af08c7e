"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its bytes, its hashed byte triples, and bins of two shape figures (the share of
distinct words, and of words that repeat the word before). Log counts times inverse document
frequency are projected on the leading singular vectors of a labelled sample. The labelled vectors
are broadcast (at most ``NEIGHBOURS_OF`` rows of ``RANK`` floats); every document's cosine with all
of them is computed in blocks, and its nearest ones vote, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside_row, blocks, fold, narrow, utf8

FIT_ROWS = 2000         # labelled rows that fit idf and singular vectors
NEIGHBOURS_OF = 6000    # labelled rows that vote
RANK, TRIPLES, BINS = 64, 4096, 16
NEAREST, SHARPNESS = 31, 8.0
TERMS = 256 + TRIPLES + 2 * BINS


def term_counts(texts: list[bytes]):
    """Term counts of each text (float32 matrix)."""
    import numpy as np

    out = np.zeros((len(texts), TERMS), dtype=np.float32)
    for i, text in enumerate(texts):
        b = np.frombuffer(text, dtype=np.uint8)
        out[i, :256] = np.bincount(b, minlength=256)
        if len(b) > 2:
            w = b.astype(np.uint32)
            triple = (w[:-2] * np.uint32(0x9E3779B1) + w[1:-1] * np.uint32(0x85EBCA6B) + w[2:] * np.uint32(0xC2B2AE35))
            out[i, 256:256 + TRIPLES] = np.bincount((triple >> np.uint32(15)) & np.uint32(TRIPLES - 1), minlength=TRIPLES)
        words = text.split()
        if words:
            n = len(words)
            distinct = len(set(words)) / n
            again = sum(map(bytes.__eq__, words[1:], words)) / n
            # as many as there are words, so that these terms weigh as the others do
            out[i, 256 + TRIPLES + min(BINS - 1, int(distinct * BINS))] = n
            out[i, 256 + TRIPLES + BINS + min(BINS - 1, int(again * BINS))] = n
    return out


def _counter(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        texts = utf8(batch.column(1))
        for lo, hi in blocks(texts):
            rows = [x.astype("<f4") for x in term_counts(texts[lo:hi])]
            index = [x.nonzero()[0].astype("<u2") for x in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array([k.tobytes() for k in index], pa.binary()),
                 pa.array([x[k].tobytes() for x, k in zip(rows, index, strict=True)], pa.binary())],
                names=["label", "terms", "counts"])


def latent_vectors(counts, idf, axes):
    """Unit vectors (float32) of count rows; a text without terms, or outside all axes, has a zero one."""
    import numpy as np

    z = (np.log1p(counts) * idf) @ axes
    norm = np.linalg.norm(z, axis=1, keepdims=True)
    return np.divide(z, norm, out=np.zeros_like(z), where=norm > 1e-9)


def _projector(idf, axes):
    def project(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = utf8(batch.column(1))
            for lo, hi in blocks(texts):
                z = latent_vectors(term_counts(texts[lo:hi]), idf, axes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([x.tobytes() for x in z], pa.binary())],
                    names=["label", "vector"])
    return project


def vote(z, vectors, labels, prior: float):
    """Share of label 1 among the NEAREST labelled vectors, weighted by similarity; the prior for zero vectors."""
    import numpy as np

    if not len(labels):
        return np.full(len(z), prior)
    k = min(NEAREST, len(labels))
    score = np.empty(len(z))
    for lo in range(0, len(z), 256):
        cosine = z[lo:lo + 256] @ vectors.T
        near = np.argpartition(cosine, -k, axis=1)[:, -k:]
        weight = np.exp(SHARPNESS * np.take_along_axis(cosine, near, axis=1).astype(np.float64))
        score[lo:lo + 256] = (weight * labels[near]).sum(axis=1) / weight.sum(axis=1)
    return np.where(np.abs(z).sum(axis=1) > 0, score, prior)


def _scorer(model):
    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        idf, axes, vectors, labels, prior = model.value
        for batch in batches:
            texts = utf8(batch.column(0))
            for lo, hi in blocks(texts):
                s = vote(latent_vectors(term_counts(texts[lo:hi]), idf, axes), vectors, labels, prior)
                yield pa.RecordBatch.from_arrays([pa.array(s.clip(0, 1)), batch.column(1).slice(lo, hi - lo)],
                                                 names=["score", "row"])
    return score


def fit(docs: DataFrame, labels: DataFrame, label_col: str, *, id_col: str = "doc_id", text_col: str = "text",
        modulus: int = 5, held_out: int = 0, fit_rows: int = FIT_ROWS, neighbours: int = NEIGHBOURS_OF):
    """The broadcast model (idf, axes, vectors, labels, prior) from labelled rows outside the held-out fold.

    Of the labelled ids the ``neighbours`` with the smallest hash are used, and of these the first ``fit_rows``
    for the axes: a bounded sample at any size. An id with several labels has the largest of them.
    """
    import numpy as np

    spark = docs.sparkSession
    own = narrow(labels, doc_id=id_col, label=label_col).where("doc_id is not null and label is not null")
    chosen = (own.where(fold("doc_id", modulus) != held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
              .select("*", F.xxhash64("doc_id").alias("h")).orderBy("h").limit(neighbours).collect())
    schema = "doc_id long, label int"
    texts = narrow(docs, doc_id=id_col, text=text_col)

    def of(rows):
        few = spark.createDataFrame([(r.doc_id, int(r.label)) for r in rows], schema)
        return texts.join(F.broadcast(few), "doc_id").select("label", "text")

    rows = of(chosen[:fit_rows]).mapInArrow(_counter, "label int, terms binary, counts binary").collect()
    x = np.zeros((len(rows), TERMS), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r.terms, "<u2")] = np.frombuffer(r.counts, "<f4")
    idf = (np.log((1 + len(rows)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    np.log1p(x, out=x)  # in place: the sample is the driver's largest table
    x *= idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, norm, out=x, where=norm > 0)
    _, axes = np.linalg.eigh(unit @ unit.T) if len(rows) else (None, np.zeros((0, 0), np.float32))
    left = axes[:, ::-1][:, :RANK]
    axes = unit.T @ left
    size = np.linalg.norm(axes, axis=0)
    axes = np.ascontiguousarray(axes[:, size > 1e-4] / size[size > 1e-4], dtype=np.float32)
    found = of(chosen).mapInArrow(_projector(idf, axes), "label int, vector binary").collect()
    vectors = np.array([np.frombuffer(r.vector, "<f4") for r in found], dtype=np.float32).reshape(len(found), axes.shape[1])
    votes = np.array([r.label for r in found], dtype=np.float64)
    prior = float(votes.mean()) if len(votes) else 0.5
    return spark.sparkContext.broadcast((idf, axes, vectors, votes, prior))


def scores(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """score (0 to 1, higher: label 1 likelier) beside every row of ``docs`` as the struct ``row``.

    A null or empty text has the labelled rows' share of label 1 as score; rows may repeat, ids may be null,
    and other columns may have any name. Without labelled rows every score is 0.5.
    """
    rows = docs.select(docs[text_col].alias("text"), F.struct("*").alias("row"))
    return rows.mapInArrow(_scorer(model), beside_row("score double", docs))
