"""Best-fit packing of documents into fixed-length sequences, certified by lower bounds.

Documents become token ids and then pieces of at most ``CAPACITY`` tokens. Pieces are dealt to
partitions of a bounded number of rows; each partition runs best-fit decreasing and certifies its
number of bins with dual feasible functions. Partitions with a gap between bins and bound hand the
documents of their unfilled bins over, every other partition those of its loosest bin (its bound is
rounded up); what was handed over is dealt anew and packed again, as long as this saves bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, narrow, utf8

CAPACITY, END_ID = 1024, 2
GROUP_ROWS = 20_000  # pieces that one task packs at a time
ROUNDS = 6
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECE + ", sequence_id long, offset long, fill long, bins long, bound long, loosest long"


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The ids are those of the ``vocabulary`` file; ``ranks`` holds the same vocabulary for the faster
    library, which takes texts of well-known scripts without the vocabulary's special tokens.
    """

    SPECIAL = "<|endoftext|>"

    def __init__(self, vocabulary: str, ranks: str):
        import base64
        import re

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.vocabulary, self.exact = vocabulary, None
        self.rare = re.compile("[^\x00-\u024f\u0370-\u052f\u2000-\u206f\u20a0-\u20bf"
                               "\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]").search

    def encode(self, text: str) -> bytes:
        import numpy as np

        if self.SPECIAL in text or (not text.isascii() and self.rare(text)):
            if self.exact is None:
                from tokenizers import Tokenizer

                self.exact = Tokenizer.from_file(self.vocabulary)
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: a longer document's first piece takes the remainder."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def _tokeniser(vocabulary: str, ranks: str, capacity: int, end_id: int):
    def pieces(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        encoder, end = Encoder(vocabulary, ranks), end_id.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                ids = encoder.encode(text.decode("utf-8", "replace")) + end
                rows += [(doc_id, k, s, n, zlib.crc32(ids[4 * s:4 * (s + n)]))
                         for k, (s, n) in enumerate(cuts(len(ids) // 4, capacity))]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()),
                                                     strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return pieces


def best_fit_decreasing(lengths, capacity: int = CAPACITY):
    """(order, bin, offset): items in the order placed (longest first), each in the fullest bin it fits."""
    import numpy as np

    order = np.argsort(-lengths, kind="stable")
    room = [[] for _ in range(capacity + 1)]  # room[r]: bins with r free places
    free, used, mask = [], 0, 0               # mask: bit r is set while room[r] has bins
    bins, offsets = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    for i, n in enumerate(lengths[order].tolist()):
        fitting = mask >> n
        if fitting:
            left = n + (fitting & -fitting).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                mask ^= 1 << left
        else:
            left, b, used = capacity, used, used + 1
            free.append(capacity)
        bins[i], offsets[i] = b, capacity - left
        left -= n
        free[b] = left
        if left:
            room[left].append(b)
            mask |= 1 << left
    return order, bins, offsets


def lower_bound(histogram, capacity: int = CAPACITY) -> int:
    """Bins that items need at least; histogram[n] counts the items of length n.

    The largest of the bounds by the dual feasible functions that drop items under e and round those
    above capacity - e up, for every e up to half, and by those that round to multiples of 1 / k.
    """
    import numpy as np

    n = np.arange(capacity + 1, dtype=np.int64)
    h = np.asarray(histogram, dtype=np.int64)
    total = np.concatenate([[0], np.cumsum(h * n)])
    count = np.concatenate([[0], np.cumsum(h)])
    e = np.arange(1, capacity // 2 + 1)
    # items over capacity - e count as whole bins, items from e to capacity - e by length
    kept = (count[-1] - count[capacity - e + 1]) * capacity + total[capacity - e + 1] - total[e]
    best = -(-max(int(kept.max()), int(total[-1])) // capacity)
    for k in range(1, 101):
        scaled = np.where((k + 1) * n % capacity == 0, k * n, (k + 1) * n // capacity * capacity)
        best = max(best, -(-int((h * scaled).sum()) // (k * capacity)))
    return best


def _packer(capacity: int, turn: int):
    def pack(key, rows):
        import numpy as np

        lengths = rows["length"].to_numpy()
        order, bins, offsets = best_fit_decreasing(lengths, capacity)
        out = rows.iloc[order].drop(columns="part")
        fill = np.bincount(bins, weights=lengths[order]).astype(np.int64)
        out["sequence_id"] = (turn << 56) + (int(key[0]) << 24) + bins
        out["offset"], out["fill"] = offsets, fill[bins]
        out["bins"] = len(fill)
        out["bound"] = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        out["loosest"] = fill.min()
        return out
    return pack


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str | None = None,
         ranks: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, rounds: int = ROUNDS,
         group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Rows that repeat an id, or have none, are packed each for
    itself under that id. Equal lengths are placed in any order. Other columns are ignored. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "packing")
    files = default_files()
    pieces = stage.table(
        narrow(docs, doc_id=id_col, text=text_col)
        .mapInArrow(_tokeniser(vocabulary or files[0], ranks or files[1], capacity, end_id), PIECE), "pieces")
    names, final = pieces.columns, []

    def packed(rows: DataFrame, turn: int) -> DataFrame:
        parts = max(1, -(-rows.count() // group_rows))
        dealt = rows.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(parts)))
        return stage.table(dealt.groupBy("part").applyInPandas(_packer(capacity, turn), PLACED), f"turn{turn}")

    def bins(rows: DataFrame) -> int:
        return rows.agg(F.count_distinct("sequence_id")).first()[0]

    # Unfilled bins of partitions with a gap, and the loosest bins of all others.
    is_open = (F.col("fill") < capacity) & ((F.col("bins") > F.col("bound")) | (F.col("fill") == F.col("loosest")))
    current = packed(pieces, 0)
    stage.drop("pieces")
    for turn in range(1, rounds + 1):
        handed = current.where(is_open)
        before = bins(handed)
        if before < 2:
            break
        again = packed(handed.select(*names), turn)
        if bins(again) >= before:
            break  # nothing saved: what was there before stays
        final.append(current.where(~is_open))
        current = again
    final.append(current)
    return reduce(DataFrame.unionByName, final).select(*names, "sequence_id", "offset")
