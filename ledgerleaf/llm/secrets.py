"""Secret scan by assignment-aware lexing.

Three base patterns (``BASE``) mark assignments to well-known words, cloud access ids and long hex
runs. Beyond them the text is lexed as source or configuration: every ``=``, ``:=``, ``=>`` and ``:``
with a name before it and a value after it is a name-literal pair. Constants are propagated (a value
that is the name of an earlier pair, also in ``+`` chains and ``${...}``, stands for its literals, in a graph
that shares them, so work stays in proportion to the text), a name is carried over a type (``name: type = value``), and
a literal is a secret when the words of the name it flows into and its own form score high enough.
Such literals outside all base spans get spans of the kind ``literal``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import blocks, narrow, utf8

KINDS = ("assign", "access", "hex", "literal")
# Fixed patterns. A hex run or access id of the least length is found by that length at once, as its
# characters run on greedily; an assignment's value may be too short, and its match is then dropped.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX, LEAST = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}", 8

# Words of a target name and how much they say that its value is secret.
NAME_WEIGHT = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "apikey": 1.0,
    "token": 0.9, "credential": 0.9, "credentials": 0.9, "bearer": 0.9, "jwt": 0.9, "pass": 0.8,
    "auth": 0.6, "signature": 0.6, "salt": 0.6, "key": 0.4, "private": 0.4, "access": 0.4, "api": 0.3,
    "signing": 0.4, "encryption": 0.4, "client": 0.2, "session": 0.3, "connection": 0.3,
}
# Last words that make a name speak about a secret and not hold it.
HARMLESS_LAST = {"name", "file", "path", "url", "uri", "length", "len", "size", "type", "hint", "label", "field",
                 "policy", "expiry", "ttl", "count", "enabled", "required", "prompt", "message", "header"}
PLACEHOLDER = ("changeme", "example", "placeholder", "your", "xxxx", "****", "dummy", "sample", "redacted", "todo")
THRESHOLD = 0.55


def name_score(name: str) -> float:
    import re

    words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)]
    if not words or words[-1] in HARMLESS_LAST:
        return 0.0
    return min(1.0, sum(NAME_WEIGHT.get(w, 0.0) for w in set(words)))


class Value:
    """What a name stands for: a literal range, then the value of what follows it or the constant it refers to.

    ``counts`` (characters) and ``barred`` describe the whole text, so that a value is scored without being written
    out, however often its operands repeat, and chains share their tails.
    """

    __slots__ = ("span", "operands", "length", "counts", "first", "barred", "given")
    FULL = 1 << 40  # counts of longer texts are scaled down; only their shares matter then

    def __init__(self, span: tuple[int, int] | None, counts: Counter, first: str, barred: bool, operands: list[Value]):
        self.span, self.operands, self.given = span, operands, False
        self.counts, self.first, self.barred = counts, first, barred
        for value in operands:
            self.counts.update(value.counts)
            self.first = self.first or value.first
            self.barred |= value.barred
        self.length = sum(self.counts.values())
        if self.length > self.FULL:
            self.counts = Counter({c: n // 1024 + 1 for c, n in self.counts.items()})
            self.length = sum(self.counts.values())

    def score(self) -> float:
        """Up to 1 by length, spread and classes of characters; 0 for blanks, references and placeholders."""
        import math

        n = self.length
        if n < LEAST or self.barred or self.first in "<$%{":
            return 0.0
        entropy = -sum(c / n * math.log2(c / n) for c in self.counts.values() if c)
        kinds = [c for c, times in self.counts.items() if times]
        classes = sum((any(c.islower() for c in kinds), any(c.isupper() for c in kinds),
                       any(c.isdigit() for c in kinds), not all(c.isalnum() for c in kinds)))
        return min(1.0, 0.15 * classes + 0.15 * entropy + 0.01 * min(n, 20))


class Run:
    """A literal whose end several operators inside it share; each asks for what is left from its own start on."""

    def __init__(self, text: str, start: int, end: int):
        part = text[start:end]
        low = part.lower()
        self.text, self.start, self.counts = text, start, Counter(part)
        self.blank = max((start + i for i, c in enumerate(part) if c.isspace()), default=-1)
        self.placeholder = max((start + i for i in map(low.rfind, PLACEHOLDER) if i >= 0), default=-1)

    def since(self, start: int) -> tuple[Counter, bool]:
        """Characters from ``start`` on, and whether a blank or placeholder bars them; starts only grow."""
        self.counts.subtract(self.text[self.start:start])
        self.start = start
        return Counter(self.counts), max(self.blank, self.placeholder) >= start


class Runs:
    """The literals of a text met so far, so that a long one is read once for all the operators inside it."""

    def __init__(self):
        self.starts, self.ends, self.of = [], [], {}

    def literal(self, pattern, text: str, at: int) -> tuple[int, int, int, bool]:
        """(start, end, end of the match, quoted) of the literal at ``at``; ends are -1 without one."""
        from bisect import bisect_right

        i = bisect_right(self.starts, at) - 1
        if i >= 0 and at < self.ends[i]:  # inside a bare literal
            return at, self.ends[i], self.ends[i], False
        m = pattern.match(text, at)
        if not m:
            return -1, -1, -1, False
        if m[1]:
            return *m.span(2), m.end(), True
        s, e = m.span(3)
        if not self.ends or s >= self.ends[-1]:
            self.starts.append(s)
            self.ends.append(e)
        return s, e, e, False

    def since(self, text: str, s: int, e: int) -> tuple[Counter, bool]:
        if e not in self.of or s < self.of[e].start:
            self.of[e] = Run(text, s, e)
        return self.of[e].since(s)


class Lexer:
    """Name-literal pairs of a text and the secret spans among them, in one pass over its operators."""

    def __init__(self):
        import re

        self.operator = re.compile(r"(?<![=!<>:+*/%&|^~-])(?::=|=>|=|:)(?![=:/])")
        self.name = re.compile(r"""["']?([\w$.-]*[A-Za-z_$])""")  # of a reversed text
        self.literal = re.compile(r"""[ \t]*(?:(["'`])((?:[^"'`\\\n]|\\.|(?!\1)["'`])*)\1|([^\s,;()\[\]{}"'`+]+))""")
        self.reference = re.compile(r"\$?\{?([A-Za-z_][\w.]*)\}?")
        self.chain = re.compile(r"[ \t]*\+[ \t]*")
        # "name: type = value"; without blanks before "=" only a quoted value tells a type from a value.
        one = r"""(?:&(?:'\w+[ \t]+)?(?:mut[ \t]+)?)?[A-Za-z_][\w.]*(?:[\[<][^\n=;{}()"]*[\]>])?[?*\[\]]*"""
        self.typed = re.compile(rf"""[ \t]*{one}(?:[ \t]*[|&][ \t]*{one})*(?:[ \t]+=(?![=>~])|=(?=[ \t]*["'`]))""")

    def pairs(self, text: str) -> Iterator[tuple[str, Value]]:
        """(name, value) in text order; a value reaches back to the literals of propagated constants."""
        known: dict[str, Value] = {}
        tails: dict[int, Value | None] = {}
        runs = Runs()
        before, carried, expected = 0, None, -1
        for op in self.operator.finditer(text):
            between, before = text[before:op.start()].rstrip(" \t"), op.end()
            found = self.name.match(between[::-1] if between[-1:] != "]" else between[-2::-1])
            name = found[1][::-1] if found else None
            if op[0] == ":" and name and (typed := self.typed.match(text, op.end())):
                carried, expected = name, typed.end() - 1
                continue
            if op.start() == expected and name_score(carried) >= name_score(name or ""):
                name = carried
            if not name:
                continue
            value = self.value(text, op.end(), known, tails, runs)
            if value:
                known[name] = value
                yield name, value

    def value(self, text: str, at: int, known: dict, tails: dict, runs: Runs) -> Value | None:
        """The value that begins at ``at``. ``tails`` has the values that follow a ``+`` by their place: chains that
        end alike share what they have in common."""
        parts, tail = [], None
        while True:
            whole, (s, e, end, quoted) = at, runs.literal(self.literal, text, at)
            if end < 0:
                break
            ref = None if quoted else self.reference.fullmatch(text, s, e)
            constant = known.get(ref[1]) if ref else None
            dropped = not quoted and not constant and (text[e:e + 1] in ("(", "[", "{") or text[s] == "$")
            parts.append((whole, s, e, constant, dropped))
            more = self.chain.match(text, end)
            if not more:
                break
            at = more.end()
            if at in tails:
                tail = tails[at]
                break
        for k, (whole, s, e, constant, dropped) in reversed(list(enumerate(parts))):
            if constant or dropped:
                operands = [v for v in (constant, tail) if v]
                tail = operands[0] if len(operands) == 1 else Value(None, Counter(), "", False, operands) if operands else None
            else:
                counts, barred = runs.since(text, s, e)
                alone = tail is None and e - s < 20 and text[s:e].lower() in ("undefined", "required", "disabled")
                tail = Value((s, e), counts, text[s:s + 1] if e > s else "", barred or alone, [tail] if tail else [])
            if k:
                tails[whole] = tail
        return tail

    def secrets(self, text: str) -> set[tuple[int, int]]:
        out = set()
        for name, value in self.pairs(text):
            weight = name_score(name)
            if not weight or weight * value.score() < THRESHOLD:
                continue
            waiting = [value]
            while waiting:  # each value hands its literals over once
                value = waiting.pop()
                if not value.given:
                    value.given = True
                    if value.span:
                        out.add(value.span)
                    waiting += value.operands
        return out


class Scanner:
    def __init__(self):
        import re

        self.assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
        self.access, self.hex, self.lexer = re.compile(ACCESS), re.compile(HEX), Lexer()
        self.value = re.compile(r"[A-Za-z0-9+/_.=-]+")

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the base spans, in order."""
        out = []
        if ":" in text or "=" in text:
            out += [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if len(m[2]) >= LEAST]
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in self.access.finditer(text)]
        out += [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
        return sorted(out)

    def literals(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Secret literals that no base span covers."""
        from bisect import bisect_right

        if ":" not in text and "=" not in text:
            return []
        reach, end = [], 0  # the furthest end of the base spans up to each
        for _, _, e in base:
            reach.append(end := max(end, e))
        starts = [s for s, _, _ in base]
        out = []
        for s, e in self.lexer.secrets(text):
            i = bisect_right(starts, s)
            if not (i and reach[i - 1] >= e):
                out.append((s, 3, e))
        return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _scan(batches: Iterator) -> Iterator:
    import hashlib

    import pyarrow as pa

    scanner = Scanner()
    for batch in batches:
        texts, ids = utf8(batch.column(1)), batch.column(0)
        for lo, hi in blocks(texts):
            counts, digest, spans = [[], [], []], [], []
            for text in texts[lo:hi]:
                text = text.decode("utf-8", "replace")
                base = scanner.base(text)
                for k, own in enumerate(counts):
                    own.append(sum(kind == k for _, kind, _ in base))
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + scanner.literals(text, base)))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()),
                 pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    ``spans`` lists kind:start:end (code points, end exclusive) by start, then kind. A null or empty text has
    none. Rows are scanned each for itself; ids may repeat or be null, other columns are ignored. An empty
    table gives no rows.
    """
    return narrow(docs, doc_id=id_col, text=text_col).mapInArrow(
        _scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
