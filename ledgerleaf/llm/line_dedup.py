"""Line de-duplication by a fixed-depth log-template tree.

A line's path in the tree is its token count and its leading tokens; a token with a digit in it is a
variable field. In a leaf, lines that agree in most token positions are one template, whose other
positions are variable fields too. A template that occurs in ``min_docs`` different texts, or one of
long lines in two, is dropped from all of them but one, so nothing vanishes from the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, beside_row, blocks, utf8

MIN_DOCS = 3        # different texts that make a template recurring
LONG_TOKENS, LONG_DOCS = 50, 2  # lines of so many tokens recur from so many different texts on
MIN_TOKENS = 3      # shorter lines are left alone
SIMILARITY = 0.75   # share of equal token positions that makes two lines of a leaf one template
DEPTH = 2           # leading tokens of a leaf
LEAF_ROWS = 2000    # lines of a leaf that look for templates in one task at first; no result depends on it
LINES = "k long, line long, wordy boolean, leaf long, tokens binary"


class TokenHash(dict):
    """64-bit hashes of tokens; every token with a digit has the same one."""

    def __missing__(self, token: bytes) -> int:
        import xxhash

        variable = any(48 <= c <= 57 for c in token)
        self[token] = value = 42 if variable else xxhash.xxh3_64_intdigest(token)
        return value


def parsed(texts: list[bytes], cache: TokenHash, min_tokens: int):
    """Of all lines of min_tokens or more tokens: text index, position in the text, token count, line hash,
    leaf hash, and all their token hashes with their starts."""
    import numpy as np

    if len(cache) > 1_000_000:
        cache.clear()
    words, owner, place, counts = [], [], [], []
    for i, text in enumerate(texts):
        for j, line in enumerate(text.split(b"\n")):
            tokens = line.split()
            if len(tokens) >= min_tokens:
                words += tokens
                owner.append(i)
                place.append(j)
                counts.append(len(tokens))
    h = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
    n = np.array(counts, dtype=np.int64)
    starts = np.cumsum(n) - n
    if not len(n):
        return np.array(owner, np.int64), place, n, np.empty(0, np.int64), np.empty(0, np.int64), h, starts
    at = np.arange(len(h)) - np.repeat(starts, n)
    power = np.ones(int(n.max()), dtype=np.uint64)
    power[1:] = np.uint64(0x9E3779B97F4A7C15)
    power = np.multiply.accumulate(power)
    term = (h ^ (h >> np.uint64(29))) * power[at]

    def key(terms, salt):
        total = np.add.reduceat(terms, starts) + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(salt)
        total = (total ^ (total >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return (total ^ (total >> np.uint64(29))).view(np.int64)

    leaf = key(np.where(at < DEPTH, term, np.uint64(0)), DEPTH)
    return np.array(owner, np.int64), place, n, key(term, 0), leaf, h, starts


def _parser(min_tokens: int):
    def parse(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        cache = TokenHash()
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(), utf8(batch.column(1))
            for lo, hi in blocks(texts):
                owner, _, n, line, leaf, h, starts = parsed(texts[lo:hi], cache, min_tokens)
                if not len(n):
                    continue
                order = np.lexsort((line, owner))
                new = np.ones(len(order), bool)
                new[1:] = (owner[order][1:] != owner[order][:-1]) | (line[order][1:] != line[order][:-1])
                pick = np.sort(order[new])  # a line that a text repeats counts once
                small = (h >> np.uint64(48)).astype("<u2")
                tokens = [small[s:s + m].tobytes() for s, m in zip(starts[pick], n[pick], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[lo:hi][owner[pick]]), pa.array(line[pick]), pa.array(n[pick] >= LONG_TOKENS),
                     pa.array(leaf[pick]), pa.array(tokens, pa.binary())], names=["k", "line", "wordy", "leaf", "tokens"])
    return parse


def needed(m: int, similarity: float) -> int:
    """How many of m token positions must agree."""
    least = max(0, int(similarity * m) - 1)
    while least / m < similarity:
        least += 1
    return least


class Templates:
    """The seeds of one leaf in the order of their lines. A line belongs to the first seed it is similar to.

    The lines of a leaf share their leading tokens. Lines that may differ in d of the other positions agree
    in one of any d + 1 bands of them, so only seeds that share a band are compared and none is missed.
    """

    def __init__(self, similarity: float):
        self.similarity, self.seeds, self.bands = similarity, [], {}

    def _keys(self, tokens: bytes):
        m = len(tokens) // 2
        first, count = min(DEPTH, m), m - needed(m, self.similarity) + 1
        cuts = [2 * (first + (m - first) * i // count) for i in range(count + 1)]
        return [(m, i, tokens[cuts[i]:cuts[i + 1]]) for i in range(count)]

    def add(self, tokens: bytes) -> None:
        for key in self._keys(tokens):
            self.bands.setdefault(key, []).append(len(self.seeds))
        self.seeds.append(tokens)

    def find(self, tokens: bytes) -> int | None:
        """Place in ``seeds`` of the first one that is similar."""
        import numpy as np

        near = sorted({i for key in self._keys(tokens) for i in self.bands.get(key, ())})
        least, own = needed(len(tokens) // 2, self.similarity), np.frombuffer(tokens, dtype="<u2")
        for lo in range(0, len(near), 64):
            some = near[lo:lo + 64]
            matrix = np.frombuffer(b"".join([self.seeds[i] for i in some]), dtype="<u2").reshape(len(some), -1)
            fits = (matrix == own).sum(axis=1) >= least
            if fits.any():
                return some[int(fits.argmax())]
        return None


GROUPED = "leaf long, line long, template long, tokens binary"


def _grouper(similarity: float):
    """Over rows (leaf, part, role, line, tokens, wide) sorted by the first four: (leaf, line, template, tokens).

    Role 0 is a seed found before, 1 a line that may become a seed, 2 a line that is only compared. A seed
    comes out with its tokens; one without another line only if its leaf is wide (has more lines elsewhere).
    """
    def group(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def seeds():
            for line, (tokens, wide, many) in zip(names, state, strict=True):
                if wide or many:
                    out.append((at[0], line, line, tokens))

        def batch_of(rows):
            leaf, line, template, tokens = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(leaf, pa.int64()), pa.array(line, pa.int64()), pa.array(template, pa.int64()),
                 pa.array(tokens, pa.binary())], names=["leaf", "line", "template", "tokens"])

        at, known, names, state, out = None, None, [], [], []
        for batch in batches:
            for leaf, part, role, line, tokens, wide in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (leaf, part) != at:
                    seeds()
                    at, known, names, state = (leaf, part), Templates(similarity), [], []
                found = None if role == 0 else known.find(tokens)
                if found is not None:
                    out.append((leaf, line, names[found], None))
                    state[found][2] = role == 1 or state[found][2]
                elif role < 2:
                    known.add(tokens)
                    names.append(line)
                    state.append([tokens, wide and role == 1, False])
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        seeds()
        if out:
            yield batch_of(out)
    return group


def grouped_lines(lines: DataFrame, stage: Stage, similarity: float) -> DataFrame:
    """(line, template) of lines (leaf, line, tokens): a template is named by its seed.

    In the order of its lines, each line of a leaf joins the first seed it is similar to, or is one. A leaf of
    more than LEAF_ROWS lines is taken in turns: about its first LEAF_ROWS lines in one task, then all others
    against the seeds found, in many; what is left is the leaf of the next turn, with twice the rows. This
    gives the same templates whatever LEAF_ROWS is.
    """
    n = int(stage.spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.col("line") / F.lit(2.0 ** 64)
    rows, turn, left, found = LEAF_ROWS, 0, lines, None
    names = ("leaf", "part", "role", "line", "tokens", "wide")

    def run(df: DataFrame, key: str) -> DataFrame:
        return stage.table(df.select(*names).repartition(n, "leaf", "part").sortWithinPartitions(*names[:4])
                           .mapInArrow(_grouper(similarity), GROUPED), f"{key}{turn}")

    while True:
        size = left.groupBy("leaf").agg(F.count("*").alias("n"), F.min(place).alias("lo"), F.max(place).alias("hi"))
        wide = stage.table(size.where(F.col("n") > rows).select(
            "leaf", (F.col("lo") + (F.col("hi") - F.col("lo")) * rows / F.col("n")).alias("edge"),
            F.ceil(F.col("n") / rows).cast("int").alias("parts")), f"wide{turn}")
        crowded = not wide.isEmpty()
        marked = left.join(wide, "leaf", "left") if crowded else left.withColumns(
            {"edge": F.lit(None).cast("double"), "parts": F.lit(1)})
        first = marked.where(F.col("edge").isNull() | (place <= F.col("edge")))
        learnt = run(first.withColumns({"part": F.lit(-1), "role": F.lit(1), "wide": F.col("edge").isNotNull()}), "learnt")
        found = learnt if found is None else found.union(learnt)
        if not crowded:
            return found.select("line", "template")
        others = marked.where(place > F.col("edge")).select(
            "leaf", F.pmod(F.xxhash64("line"), "parts").cast("int").alias("part"), F.lit(2).alias("role"), "line", "tokens",
            F.lit(True).alias("wide"))
        seeds = (learnt.where("line = template").join(wide, "leaf")
                 .select("leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"),
                         "line", "tokens", F.lit(True).alias("wide")))
        matched = run(others.union(seeds), "matched")
        found = found.union(matched)
        left = stage.table(others.join(matched.select("line"), "line", "left_anti").select("leaf", "line", "tokens"),
                           f"left{turn}")
        rows, turn = 2 * rows, turn + 1


def recurring_lines(docs: DataFrame, stage: Stage, text_col: str = "text", *, min_docs: int = MIN_DOCS,
                    min_tokens: int = MIN_TOKENS, similarity: float = SIMILARITY) -> DataFrame:
    """(k, lines): the hashes of the lines to drop from the text with hash k (xxhash64 of the text)."""
    text = F.col(text_col)
    rows = stage.table(docs.where(text.isNotNull()).select(F.xxhash64(text).alias("k"), text.alias("text"))
                       .mapInArrow(_parser(min_tokens), LINES), "lines")
    # Copies of a text give equal rows: they count as one text.
    seen = stage.table(rows.select("k", "line", "wordy").distinct(), "seen")
    counts = F.count("*").alias("texts"), F.min("k").alias("keeper"), F.max("wordy").alias("wordy")
    recurs = F.col("texts") >= F.when(F.col("wordy"), min(min_docs, LONG_DOCS)).otherwise(min_docs)
    known = stage.table(seen.groupBy("line").agg(*counts).where(recurs), "known")

    several = rows.groupBy("leaf").agg(F.min("line").alias("lo"), F.max("line").alias("hi")).where("lo <> hi")
    own = (rows.join(several.select("leaf"), "leaf", "left_semi").groupBy("leaf", "line").agg(F.min("tokens").alias("tokens")))
    grouped = grouped_lines(stage.table(own, "members"), stage, similarity)

    merged = (seen.join(grouped, "line").select("k", "template", "wordy").distinct()
              .groupBy("template").agg(*counts).where(recurs))
    alone = known.join(grouped, "line", "left_anti")
    dropped = (alone.select("line", "keeper")
               .union(grouped.join(merged, "template").select("line", "keeper")))
    out = stage.table(seen.join(dropped, "line").where("k <> keeper").groupBy("k")
                      .agg(F.collect_list("line").alias("lines")), "drops")
    stage.drop(*(key for key in list(stage.paths) if key != "drops"))
    return out


def _rewriter(text_col: str, min_tokens: int):
    def rewrite(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cache = TokenHash()
        for batch in batches:
            rows = batch.column("row")
            texts, drops = utf8(rows.field(text_col)), batch.column("lines").to_pylist()
            new, total, gone = [], [], []
            for text, drop in zip(texts, drops, strict=True):
                lines = text.split(b"\n")
                total.append(sum(1 for x in lines if x.strip()))
                if drop:
                    drop = set(drop)
                    _, place, _, line, *_ = parsed([text], cache, min_tokens)
                    out = {j for j, x in zip(place, line.tolist(), strict=True) if x in drop}
                    text = b"\n".join(x for j, x in enumerate(lines) if j not in out)
                    gone.append(len(out))
                else:
                    gone.append(0)
                new.append(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(new, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
                 rows], names=["new_text", "n_lines", "n_dropped", "row"])
    return rewrite


def drop_recurring_lines(docs: DataFrame, text_col: str = "text", *, min_docs: int = MIN_DOCS,
                         min_tokens: int = MIN_TOKENS, similarity: float = SIMILARITY) -> DataFrame:
    """Every row of ``docs`` under ``row`` (a struct of all its columns, whatever their names) with new_text,
    n_lines (lines that are not blank) and n_dropped.

    A template is recurring when it occurs in ``min_docs`` different texts (in LONG_DOCS, if its lines have
    LONG_TOKENS tokens or more); copies of a text count as one.
    Exactly repeated lines are part of their template like any other. Of the texts with lines of one template
    the one with the smallest hash keeps them (and so do its copies). Lines of fewer than ``min_tokens`` tokens are left
    alone, and so is a line that only one text repeats. A null or empty text gives an empty one and no
    lines. Rows are independent of their ids, which may repeat or be null. An empty table gives no rows.
    """
    stage = Stage(docs.sparkSession, "lines")
    drops = recurring_lines(docs, stage, text_col, min_docs=min_docs, min_tokens=min_tokens, similarity=similarity)
    rows = docs.select(F.xxhash64(docs[text_col]).alias("of"), F.struct("*").alias("row"))
    joined = rows.join(drops, F.col("of") == F.col("k"), "left").select("lines", "row")
    return joined.mapInArrow(_rewriter(text_col, min_tokens), beside_row("new_text string, n_lines long, n_dropped long", docs))
