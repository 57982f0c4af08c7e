"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks.

A text is cut into sentences, and a sentence is the sequence of its letters with a border code between words. The kernel
compares windows of a sentence by the runs of four codes they share in order, with gaps: a run that spans n codes
weighs ``DECAY ** (n - 4)``, up to ``SPAN`` codes. Windows slide over word borders, so inserted letters and signs,
look-alike digits, doubled letters, a blank inside an insult and insults of several words leave most runs in place;
single characters in a row are read without the blanks between them. A sentence scores as its best window of the
lengths ``LENGTHS``, a text as its best sentence.

Training sees labelled documents only. Windows that many more toxic than clean documents have (first by their number
of documents, then also the machine's own choice of each document) are the positive examples, windows of clean sentences are
negative ones: random ones and those that score highest. As the machine is linear in the kernel, landmarks and weights
fold into one table over runs, so a window costs a difference of running sums and no pass over landmarks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside_row, blocks, fold, narrow, utf8

TOXIC_ROWS, CLEAN_ROWS = 1500, 2000  # labelled documents the machine is fitted on, at most
LANDMARKS, DECAY, SPAN = 300, 0.5, 7
LENGTHS = (7, 9, 12, 16)  # codes of a window; borders count
COST, TURNS = 10.0, 3
CODES = 32 ** 4
CANDIDATES = 1000  # windows that are looked up in all documents of the sample in a turn, at most
BORDER, CHUNK = 31, 1 << 20  # code between words; codes handled at once
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
EDGES = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "«»“”‘’„…–—"
ENDS, STOP = ".!?…", "\x01"


def alphabet():
    """Code of each character below 0x600: 1-26 for plain letters and their look-alikes, 27-30 for other
    letters, 0 for what is skipped."""
    import numpy as np

    table = np.zeros(0x600, dtype=np.int64)
    for c in range(0x600):
        plain = LOOKALIKE.get(chr(c), chr(c).lower())
        if len(plain) == 1 and "a" <= plain <= "z":
            table[c] = ord(plain) - 96
        elif chr(c).isalpha():
            table[c] = 27 + c % 4
    return table


class Borders(dict):
    """What stands between two words, by the signs and blanks there: a border, or the end of a sentence and a border."""

    def __missing__(self, between: str) -> str:
        before = between[:len(between) - len(between.lstrip(EDGES))]
        ended = set(ENDS) & set(before) or len(between.splitlines()) > 1 or between.strip(EDGES)[-1:] in "\n\r"
        self[between] = out = STOP + "\n" if ended else "\n"
        return out


def reader():
    """A function from texts to their codes (uint8), the sizes of their sentences, and each text's number of sentences.

    Signs at the edge of a word are no letters; a sentence ends with a line, or with a word that ends in ``ENDS``. Three or
    more single characters in a row are one word, across such ends too. Sentences that are shorter than the longest
    window are padded with borders.
    """
    import re

    import numpy as np

    table, borders, signs = alphabet(), Borders(), re.escape(EDGES)
    between = re.compile(f"(?<![{signs}])[{signs}]*\\s+[{signs}]*").sub
    single = re.compile(f"(?<=[\n])[^\n{STOP}](?:{STOP}?\n[^\n{STOP}](?=[\n{STOP}])){{2,}}").sub

    def plain(text: str) -> str:
        if len(borders) > 100_000:
            borders.clear()
        text = between(lambda m: borders[m[0]], f"\n{text.lower().replace(STOP, ' ')}\n")
        text = single(lambda m: m[0].replace(STOP, "").replace("\n", ""), text)
        return f"\n{text.strip(STOP + chr(10))}{STOP}"

    def read(texts: list[str]):
        texts = [plain(t) for t in texts]
        counts = np.array([t.count(STOP) for t in texts], dtype=np.int64)
        c = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), dtype=np.uint32)
        code = np.where(c < 0x600, table[np.minimum(c, 0x5FF)], 27 + c % 4).astype(np.uint8)
        stop = c == ord(STOP)
        code[stop | (c == 10)] = BORDER
        kept = code > 0
        code, ends = code[kept], np.flatnonzero(stop[kept]) + 1
        sizes = np.diff(ends, prepend=0)
        lack = np.maximum(0, max(LENGTHS) - sizes)
        if lack.any():
            code = np.insert(code, np.repeat(ends, lack), BORDER)
        return code, sizes + lack, counts
    return read


def runs(code, window) -> Iterator[tuple]:
    """(window, run, weight) of all runs of four codes, for each choice of gaps."""
    for c in range(3, SPAN):
        same = window[c:] == window[:-c]
        at = same.nonzero()[0]
        of, ends = window[at], (code[at] << 15) | code[at + c]
        for b in range(2, c):
            for a in range(1, b):
                yield of, ends | (code[at + a] << 10) | (code[at + b] << 5), DECAY ** (c - 3)


def norm(length: int) -> float:
    """The kernel norm of a window: the root of its runs' squared weights."""
    return sum(DECAY ** (2 * (c - 3)) * (c - 1) * (c - 2) / 2 * max(0, length - c) for c in range(3, SPAN)) ** 0.5


def values(code, weights):
    """For each length of a window the normalised kernel sum of the window at each place of ``code``, as a dict."""
    import numpy as np

    n = len(code)
    code = code.astype(np.int32)
    sums = []  # running sums of the weights of the runs that begin at each place, by span
    for c in range(3, SPAN):
        ends = (code[:n - c] << 15) | code[c:]
        own = np.zeros(n - c, dtype=np.float32)
        for b in range(2, c):
            for a in range(1, b):
                own += weights[ends | (code[a:n - c + a] << 10) | (code[b:n - c + b] << 5)]
        sums.append(np.concatenate([[0.0], np.cumsum(own, dtype=np.float64)]) * DECAY ** (c - 3))
    out = {}
    for length in LENGTHS:
        places = n - length + 1
        total = np.zeros(places)
        for c, s in zip(range(3, SPAN), sums, strict=True):
            total += s[length - c:length - c + places] - s[:places]
        out[length] = total / norm(length)
    return out


def best_windows(code, sizes, counts, weights, windows: bool = False):
    """The value of the best window of each text (0 for one without sentences), and the windows if wanted."""
    import numpy as np

    to_end = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(code))
    limits = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
    top, found = np.full(len(counts), -np.inf), [None] * len(counts)
    for lo in range(0, len(code), CHUNK):
        hi = min(len(code), lo + CHUNK)
        some = np.flatnonzero((limits[:-1] < hi) & (limits[1:] > lo) & (counts > 0))
        at = np.maximum(limits[some], lo) - lo
        for length, v in values(code[lo:hi + max(LENGTHS)], weights).items():
            v = v[:hi - lo]
            v[to_end[lo:lo + len(v)] < length] = -np.inf  # windows stay inside their sentence
            if len(v) < hi - lo:
                v = np.append(v, np.full(hi - lo - len(v), -np.inf))
            best = np.maximum.reduceat(v, at)
            better = np.flatnonzero(best > top[some])
            top[some[better]] = best[better]
            for k in better.tolist() if windows else ():
                place = lo + at[k] + int(v[at[k]:at[k + 1] if k + 1 < len(at) else None].argmax())
                found[some[k]] = code[place:place + length]
    top[np.isinf(top)] = 0.0
    return (top, found) if windows else top


def weigh(texts: list[str], alphabet_table, weights):
    """The value of each text's best window."""
    return best_windows(*reader()(texts), weights)


def spelt(tokens: list[str]) -> list[str]:
    """Runs of three or more single characters, joined."""
    out, run = [], []
    for t in [*tokens, ""]:
        t = t.strip(EDGES) or t
        if len(t) == 1:
            run.append(t)
        else:
            out += ["".join(run)] if len(run) > 2 else []
            run = []
    return out


def _collector(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.binary())], names=["label", "text"])


def _machine(z, y, share):
    """Weights and offset of a squared-hinge linear machine (Newton steps on the examples inside the margin)."""
    import numpy as np

    x = np.hstack([z, np.ones((len(z), 1), dtype=z.dtype)])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(30):
        inside = y * (x @ w) < 1
        c = 2 * COST * share[inside]
        a = x[inside]
        c = c.astype(a.dtype)
        new = np.linalg.solve(ridge + (a * c[:, None]).T @ a, a.T @ (c * y[inside]).astype(a.dtype))
        done = np.abs(new - w).max() < 1e-6
        w = new if done else 0.5 * (w + new) if _ > 10 else new
        if done:
            break
    return w[:-1], w[-1]


def train(documents: Iterable[tuple[int, list[str]]], seed: int = 7):
    """(run table, offset, slope, shift): the machine and its calibration, or the share of label 1 alone
    (table None) where the sample lacks a class. A document is a label and a list of texts."""
    import numpy as np

    rng = np.random.default_rng(seed)
    read, y, docs = reader(), [], []
    for label, texts in documents:
        y.append(label)
        docs.append(read(["\n".join(texts)])[:2])
    y = np.array(y, dtype=np.int64)
    if not 0 < y.sum() < len(y):
        return None, float(y.mean()) if len(y) else 0.5, 0.0, 0.0
    fit = rng.random(len(y)) < 0.7
    for label in (0, 1):  # both parts have both classes where there are two rows
        own = np.flatnonzero(y == label)
        fit[own[0]] = True
        if len(own) > 1:
            fit[own[1]] = False
    toxic, clean = ([docs[i] for i in np.flatnonzero(fit & (y == label))] for label in (1, 0))

    def best(rows: list, windows: bool = True):
        """The best windows of documents, in parts."""
        out = []
        for k in range(0, len(rows), 100):
            code, sizes = (np.concatenate(c) for c in zip(*rows[k:k + 100], strict=True))
            out.append(best_windows(code, sizes, np.array([len(s) for _, s in rows[k:k + 100]]), table, windows))
        if not windows:
            return np.concatenate(out)
        return [(v, w.tobytes()) for top, found in out for v, w in zip(top.tolist(), found, strict=True) if w is not None]

    toxic_bytes, clean_bytes = ([code.tobytes() for code, _ in rows] for rows in (toxic, clean))
    judged: dict[bytes, int] = {}

    def telling(found: Counter) -> dict[bytes, int]:
        """Of the windows that the most documents point at, those that, relatively, ten times as many toxic documents as
        clean ones have, with the number of toxic documents that have them."""
        for w, _ in found.most_common(CANDIDATES):
            if w not in judged:
                p, q = (sum(w in d for d in docs) for docs in (toxic_bytes, clean_bytes))
                judged[w] = p if p / len(toxic) > 10 * q / len(clean) else 0
        return {w: judged[w] for w, _ in found.most_common(CANDIDATES) if judged[w]}

    # First the windows from the start of a word on that several toxic documents have and clean ones have not.
    ours = {w.tobytes() for w in _windows_at_random(clean, rng, 6000)}
    told = _first_windows(toxic, clean) or Counter(w.tobytes() for w in _windows_at_random(toxic, rng, 100))
    for turn in range(TURNS):
        known = Counter(told)
        if turn:
            known.update(telling(Counter(w for v, w in best(toxic) if v + offset > -0.5)))
            ours |= {w for _, w in best(clean)}
        ours -= set(known)
        order = sorted(known, key=lambda w: (-known[w], w))
        positive, negative = ([np.frombuffer(w, np.uint8) for w in ws] for ws in (order, sorted(ours)))
        count = np.array([known[w] for w in order])
        some = rng.permutation(len(negative))[:LANDMARKS // 2]
        table, offset = _fit([*positive[:LANDMARKS // 2], *[negative[k] for k in some]], positive, negative, count)
    held = np.flatnonzero(~fit)
    top = best([docs[i] for i in held], windows=False) + offset if len(held) else np.zeros(0)
    slope, shift = _calibrate(top, y[held]) if 0 < y[held].sum() < len(held) else (4.0, 0.0)
    return table, float(offset), slope, shift


def _first_windows(toxic: list, clean: list) -> dict[bytes, int]:
    """For each length the window from the start of a word on that tells most about each toxic document, by how much more
    often toxic documents have it than clean ones (in standard errors, and ten times as often); those that three or more
    documents point at (one or more, if there are none such), with the number of these."""
    import numpy as np

    def windows(rows, length):
        """The windows of each document, as numbers."""
        shifts = 5 * np.arange(length - 1, -1, -1)
        for code, _ in rows:
            at = np.flatnonzero(code[:len(code) - length + 1] == BORDER)
            seen = np.lib.stride_tricks.sliding_window_view(code, length)[at].astype(np.int64)
            yield np.unique((seen << shifts).sum(axis=1))

    pointed = Counter()
    for length in [n for n in LENGTHS if n <= 12]:
        of = list(windows(toxic, length))
        key, p = np.unique(np.concatenate(of), return_counts=True)
        other, q = np.unique(np.concatenate(list(windows(clean, length))), return_counts=True)
        at = np.searchsorted(other, key).clip(max=len(other) - 1)
        q = np.where(other[at] == key, q[at], 0)
        p, q = (p + 0.5) / (len(toxic) + 1), (q + 0.5) / (len(clean) + 1)
        z = np.where(p > 10 * q, (p - q) / np.sqrt(p / len(toxic) + q / len(clean)), 0.0)
        for own in of:
            value = z[np.searchsorted(key, own)]
            if value.max() > 1:
                k = int(own[value.argmax()])
                pointed[bytes((k >> (5 * i)) & 31 for i in range(length - 1, -1, -1))] += 1
    return {w: n for w, n in pointed.items() if n > 2} or dict(pointed)


def _windows_at_random(documents: list, rng, n: int) -> list:
    out = []
    for d in rng.integers(0, len(documents), n).tolist():
        code, sizes = documents[d]
        k, length = int(rng.integers(0, len(sizes))), LENGTHS[int(rng.integers(0, len(LENGTHS)))]
        at = int(sizes[:k].sum() + rng.integers(0, sizes[k] - length + 1))
        out.append(code[at:at + length])
    return out


def _fit(marks: list, positive: list, negative: list, count):
    import numpy as np

    def features(items):
        """Normalised run weights of each window, as (item, run, weight)."""
        size = [len(w) for w in items]
        code, window = np.concatenate(items).astype(np.int64), np.repeat(np.arange(len(items)), size)
        each = np.array([norm(n) for n in size])
        item, run, weight = (np.concatenate(c) for c in zip(
            *[(of, t, np.full(len(of), w)) for of, t, w in runs(code, window)], strict=True))
        return item, run, weight / each[item]

    item, run, weight = features(marks)
    seen, place = np.unique(run, return_inverse=True)
    landmark = np.zeros((len(seen), len(marks)), dtype=np.float32)
    np.add.at(landmark, (place, item), weight)

    def kernel(items):
        if len(items) > 1000:
            return np.vstack([kernel(items[k:k + 1000]) for k in range(0, len(items), 1000)])
        item, run, weight = features(items)
        out = np.zeros((len(items), len(marks)), dtype=np.float32)
        place = np.searchsorted(seen, run).clip(max=len(seen) - 1)
        order = np.flatnonzero(seen[place] == run)
        order = order[np.argsort(item[order], kind="stable")]
        item, run, weight = item[order], place[order], weight[order]
        for lo in range(0, len(item), 50_000):
            s = slice(lo, lo + 50_000)
            rows, at = np.unique(item[s], return_index=True)
            out[rows] += np.add.reduceat(landmark[run[s]] * weight[s, None], at, axis=0)
        return out

    values, vectors = np.linalg.eigh(kernel(marks).astype(np.float64))
    good = values > 1e-4
    root = vectors[:, good] / np.sqrt(values[good])
    z = np.vstack([kernel(positive), *([kernel(negative)] if negative else [])]) @ root.astype(np.float32)
    sign = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    share = np.concatenate([count / count.sum(), np.full(len(negative), 1 / max(1, len(negative)))]) * 2000
    w, offset = _machine(z, sign, share)
    table = np.zeros(CODES, dtype=np.float32)
    table[seen] = landmark @ (root @ w)
    return table, offset


def _calibrate(value, y):
    """Slope and shift of a logistic curve with smoothed targets."""
    import numpy as np

    n1 = y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    x, w = np.column_stack([value, np.ones(len(value))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target))
        w -= step / max(1.0, np.abs(step).max())
    return float(w[0]), float(w[1])


def _scorer(model):
    def score(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        table, offset, slope, shift = model.value
        read = reader()
        for batch in batches:
            texts = utf8(batch.column(0))
            for lo, hi in blocks(texts, CHUNK):
                if table is None:
                    p = np.full(hi - lo, offset)
                else:
                    value = best_windows(*read([x.decode("utf-8", "replace") for x in texts[lo:hi]]), table) + offset
                    p = 1 / (1 + np.exp(-(slope * value + shift).clip(-500, 500)))
                yield pa.RecordBatch.from_arrays([pa.array(p), batch.column(1).slice(lo, hi - lo)],
                                                 names=["score", "row"])
    return score


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", *, id_col: str = "doc_id", text_col: str = "text",
        modulus: int = 3, held_out: int = 1, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS):
    """The broadcast machine, from labelled rows outside the held-out fold: of each class the ids with the
    smallest hash, up to the bounds. An id with several labels counts as toxic if one of them is."""
    spark = docs.sparkSession
    own = narrow(labels, doc_id=id_col, label=label_col).where("doc_id is not null and label is not null")
    own = (own.where(fold("doc_id", modulus) != held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
           .select("*", F.xxhash64("doc_id").alias("h")))
    chosen = [(r.doc_id, int(r.label)) for label, n in ((1, toxic_rows), (0, clean_rows))
              for r in own.where(F.col("label") == label).orderBy("h").limit(n).collect()]
    few = spark.createDataFrame(chosen, "doc_id long, label int")
    rows = (narrow(docs, doc_id=id_col, text=text_col).join(F.broadcast(few), "doc_id").select("label", "text")
            .mapInArrow(_collector, "label int, text binary").collect())
    rows = sorted((r.label, bytes(r.text or b"")) for r in rows)
    return spark.sparkContext.broadcast(train((label, [text.decode("utf-8", "replace")]) for label, text in rows))


def scores(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """score (0 to 1, higher: label 1 likelier) beside every row of ``docs`` as the struct ``row``.

    A null or empty text scores as one whose windows share nothing with any landmark. Rows may repeat, ids
    may be null and other columns may have any name. Without labels of both classes every score is the
    sample's share of label 1 (0.5 without labels).
    """
    rows = docs.select(docs[text_col].alias("text"), F.struct("*").alias("row"))
    return rows.mapInArrow(_scorer(model), beside_row("score double", docs))
