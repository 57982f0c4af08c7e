"""MinHash near-duplicates: universal hash minima, banding, verification, connected components.

A document's set holds its distinct five-word shingles. Sixty-four minima are cut into sixteen
bands of four; documents that share a band are candidates, and a candidate pair is a link when its
full sets reach the similarity. Inside a band bucket pairs are proposed in two passes, so that a
bucket of n like documents costs n pairs and not their square:

1. every member against the bucket's smallest id (its hub); components of the verified links;
2. in buckets that still hold several components, the members of different components whose sets can
   reach the similarity by prefix and position: in one order of all shingles, those of one component
   first and then the rare ones, two such sets share a shingle among the first 15 % of both, and what
   follows their first common one is long enough. Copies with too many edits of their own leave a
   large group by this before any pair is made.

A link between two documents of one component cannot change any component, so none that matters
is lost. Documents with equal sets are one class with its smallest id as representative.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, blocks, narrow, utf8
from .components import connected_components

WORDS, BANDS, ROWS, SIMILARITY = 5, 16, 4, 85
SIGNATURE = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"


class WordHash(dict):
    """64-bit hashes of words, kept while a task runs."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_sets(texts: list[bytes], cache: WordHash, width: int = WORDS) -> list:
    """The sorted distinct shingle hashes (uint64) of each text; empty without words."""
    import numpy as np

    if len(cache) > 1_000_000:
        cache.clear()
    words, counts = [], []
    for text in texts:
        own = text.lower().split()  # bytes: A-Z and the six ASCII white spaces only
        words += own
        counts.append(len(own))
    v = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
    base = np.uint64(0x9E3779B97F4A7C15)

    def mixed(acc):
        acc = (acc ^ (acc >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return acc ^ (acc >> np.uint64(29))

    windows = max(0, len(v) - width + 1)
    acc = np.zeros(windows, dtype=np.uint64)
    for k in range(width):
        acc = acc * base + v[k:k + windows]
    acc = mixed(acc)
    out, at = [], 0
    for n in counts:
        if n >= width:
            out.append(np.unique(acc[at:at + n - width + 1]))
        elif n:
            short = np.array([n], dtype=np.uint64)
            for x in v[at:at + n]:
                short = short * base + x
            out.append(mixed(short))
        else:
            out.append(np.empty(0, dtype=np.uint64))
        at += n
    return out


def _signer(width: int, bands: int, rows: int):
    def sign(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        rng = np.random.default_rng(2024)
        a = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
        base = np.uint64(0xD6E8FEB86659FD93)
        cache = WordHash()
        for batch in batches:
            texts, ids = utf8(batch.column(1)), batch.column(0)
            for lo, hi in blocks(texts):
                sets = shingle_sets(texts[lo:hi], cache, width)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                keys = np.zeros((hi - lo, bands), dtype=np.uint64)
                d1, d2 = np.zeros(hi - lo, dtype=np.int64), np.zeros(hi - lo, dtype=np.int64)
                full = np.flatnonzero(sizes)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    for k in range(bands):
                        key = np.full(len(full), k + 1, dtype=np.uint64)
                        for r in range(k * rows, (k + 1) * rows):
                            key = key * base + np.minimum.reduceat(flat * a[r] + b[r], starts)
                        keys[full, k] = key ^ (key >> np.uint64(32))
                    for i in full:
                        d1[i], d2[i] = np.frombuffer(
                            hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), dtype=np.int64)
                empty = sizes == 0
                flat_keys = pa.array(keys.view(np.int64).ravel())
                offsets = pa.array(np.arange(hi - lo + 1, dtype=np.int32) * bands)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(sizes), pa.array(d1, mask=empty), pa.array(d2, mask=empty),
                     pa.ListArray.from_arrays(offsets, flat_keys)],
                    names=["doc_id", "n_shingles", "d1", "d2", "bands"])
    return sign


def _setter(width: int):
    def sets(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        cache = WordHash()
        for batch in batches:
            texts, ids = utf8(batch.column(1)), batch.column(0)
            for lo, hi in blocks(texts):
                found = shingle_sets(texts[lo:hi], cache, width)
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
                flat = np.concatenate(found).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    names=["doc_id", "shingles"])
    return sets


def _verify(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity. Each set moves once per pair of its b and once as a."""
    mine = (pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
            .join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a"))
    common = F.size(F.array_intersect("sa", "sb"))
    return (mine.select("a", "b", common.alias("both"), (F.size("sa") + F.size("sb")).alias("total"))
            .where(F.expr(f"100 * both >= {similarity} * (total - both)")).select("a", "b").distinct())


def _several_parts(member: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one component."""
    split = member.groupBy("band").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi")
    return member.join(split.select("band"), "band", "left_semi")


def _across(sets: DataFrame, similarity: int, stage: Stage) -> DataFrame:
    """Pairs (a, b) of documents of different parts that can reach the similarity; sets: doc_id, part, shingles.

    With ``t`` for the similarity, sets of n and m shingles need a common part of o >= t / (100 + t) * (n + m), and
    so at least t % of either. The last of their shingles in any common order that can be their first common one
    therefore lies in the first n - t % * n + 1, with o or more from there on.
    """
    rows = sets.select("doc_id", "part", F.xxhash64("shingles").alias("h"), F.size("shingles").cast("long").alias("n"),
                       "shingles")
    each = rows.select("doc_id", "part", "h", "n", F.explode("shingles").alias("s"))
    found = each.groupBy("s").agg(F.count("*").alias("f"), (F.min("part") != F.max("part")).alias("across"))
    ordered = (each.join(found, "s").groupBy("doc_id", "part", "h", "n")
               .agg(F.sort_array(F.collect_list(F.struct("across", "f", "s"))).alias("all")))
    prefix = F.expr(f"slice(all, 1, cast(n - ceil({similarity} * n / 100) + 1 as int))")
    entries = stage.table(
        ordered.select("doc_id", "part", "n", F.posexplode(prefix).alias("pos", "e")).where("e.across")
        .select(F.col("e.s").alias("s"), "doc_id", "part", "n", (F.col("n") - F.col("pos")).alias("left")), "entries")
    # What the best set of another part leaves an entry of each list: its part's or, for the best part, the next one's.
    lists = entries.groupBy("s", "part").agg(F.max("left").alias("left"), F.min("n").alias("n"))
    best = lists.groupBy("s").agg(F.max(F.struct("left", "part")).alias("best"), F.min("n").alias("least"))
    after = (lists.join(best, "s").where("part <> best.part").groupBy("s", "best", "least")
             .agg(F.max("left").alias("next")))
    other = F.when(F.col("part") == F.col("best.part"), F.col("next")).otherwise(F.col("best.left"))
    able = stage.table(
        entries.join(after, "s").withColumn("o", F.least("left", other))
        .where(f"{100 + similarity} * o >= {similarity} * (n + least)").select("s", "doc_id", "part", "n", "left"), "able")
    a, b = able.alias("a"), able.alias("b")
    return (a.join(b, F.expr(f"a.s = b.s and a.part < b.part and {100 + similarity} * least(a.left, b.left) >= "
                             f"{similarity} * (a.n + b.n)"))
            .select(F.least("a.doc_id", "b.doc_id").alias("a"), F.greatest("a.doc_id", "b.doc_id").alias("b"))
            .distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = WORDS,
                    bands: int = BANDS, rows: int = ROWS, similarity: int = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    Links need ``100 * intersection >= similarity * union`` on full sets. A text without words (null, empty,
    white space) has an empty set and is linked with nothing; with fewer than ``width`` words the whole
    sequence is one shingle. Rows that repeat an id are one node: their links all count, each row is returned,
    and two rows of one id are never each other's duplicate. A null id is linked with nothing; its component
    is null and it is kept. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "minhash")
    texts = narrow(docs, doc_id=id_col, text=text_col)
    signed = stage.table(texts.mapInArrow(_signer(width, bands, rows), SIGNATURE), "signed")
    usable = signed.where("doc_id is not null and n_shingles > 0")

    classes = stage.table(usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")
    entries = (usable.join(classes, (usable.d1 == classes.d1) & (usable.d2 == classes.d2)
                           & (usable.doc_id == classes.rep), "left_semi")
               .select("doc_id", "n_shingles", F.explode("bands").alias("band")))
    shared = entries.groupBy("band").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("top")).where("hub <> top")
    crowded = stage.table(entries.join(shared.select("band", "hub"), "band"), "crowded")

    # Texts are dealt by id: the ids grow with the data, so they are never broadcast.
    ids = crowded.select("doc_id").distinct().hint("merge")
    sets = stage.table(texts.join(ids, "doc_id", "left_semi")
                       .mapInArrow(_setter(width), "doc_id long, shingles array<long>"), "sets")

    fits = F.expr(f"100 * least(na, n_shingles) >= {similarity} * greatest(na, n_shingles)")
    sized = signed.select(F.col("doc_id").alias("hub"), F.col("n_shingles").alias("na"))
    proposed = crowded.where("doc_id <> hub").groupBy("hub", "doc_id").agg(F.min("n_shingles").alias("n_shingles"))
    pairs = stage.table(proposed.join(sized, "hub").where(fits)
                        .select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs1")
    first = stage.table(_verify(pairs, sets, similarity), "links1")
    edges = first.select(F.col("a").alias("u"), F.col("b").alias("v"))
    # Rows of one id with different texts join the classes of those texts.
    reps = signed.join(classes, ["d1", "d2"]).select("doc_id", "rep")
    mixed = reps.groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("w")).where("v <> w")
    own = reps.join(mixed.select("doc_id"), "doc_id").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    edges = stage.table(edges.union(own), "edges")
    parts = stage.table(connected_components(edges, stage), "parts1")

    member = (crowded.join(parts, crowded.doc_id == parts.node, "left")
              .select("band", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("part")))
    rest = _several_parts(member).select("doc_id", "part").distinct()
    across = _across(sets.join(rest, "doc_id"), similarity, stage)
    pairs2 = stage.table(across.join(pairs, ["a", "b"], "left_anti"), "pairs2")
    second = stage.table(_verify(pairs2, sets, similarity), "links2")
    linked = second.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        parts.select(F.col("node").alias("u"), F.col("component").alias("v")))
    whole = stage.table(connected_components(linked, stage), "parts2")
    final = stage.table(classes.join(whole, classes.rep == whole.node, "left")
                        .select("d1", "d2", F.coalesce("component", "rep").alias("component_id")), "final")
    stage.drop("crowded", "sets", "entries", "able", "pairs1", "links1", "edges", "parts1", "pairs2", "links2", "parts2", "classes")
    return (signed.drop("bands").join(final, ["d1", "d2"], "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNull(), None)
                    .otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
