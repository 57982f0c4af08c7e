"""Sentences, windows and the kernel of the toxicity machine against plain re-computations."""

import numpy as np
import pytest

from ledgerleaf.llm import toxicity as T

NAMES = np.array(list("_abcdefghijklmnopqrstuvwxyz1234#"))


def read(text):
    code, sizes, counts = T.reader()([text])
    assert counts.tolist() == [len(sizes)] and sizes.sum() == len(code)
    return ["".join(NAMES[s]).strip("#") for s in np.split(code, np.cumsum(sizes)[:-1])]


@pytest.mark.parametrize(("text", "want"), [
    ("Hello, World. Again!", ["hello#world", "again"]), ("one\ntwo  three", ["one", "two#three"]),
    ("(so-called) 'idea'", ["socalled#idea"]), ("i d i o t here", ["idiot#here"]), ("i- d- i- o- t-", ["idiot"]),
    ("you i. d. i. o. t. there", ["you#idiot", "there"]), ("a b", ["a#b"]), ("id iot", ["id#iot"]), ("1d10t $cum", ["idiot#cum"]),
    ("", [""]), (" \n ", [""]), ("\x01x\x01y", ["x#y"]), ("Wow!!! ...yes", ["wow", "yes"]), ("v1.5 is out", ["vis#is#out"])])
def test_sentences(text, want):
    assert read(text) == want


def kernel_sum(window, weights):
    """All runs of four codes of a window, one by one."""
    from itertools import combinations
    total = square = 0.0
    for at in combinations(range(len(window)), 4):
        if at[3] - at[0] < T.SPAN:
            w = T.DECAY ** (at[3] - at[0] - 3)
            a, b, c, d = (int(window[k]) for k in at)
            total, square = total + w * weights[(a << 15) | (b << 10) | (c << 5) | d], square + w * w
    return total / square ** 0.5


def test_values_equal_a_naive_kernel():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=T.CODES).astype(np.float32)
    code = rng.integers(1, 32, 60).astype(np.uint8)
    for length, v in T.values(code, weights).items():
        want = [kernel_sum(code[k:k + length], weights) for k in range(60 - length + 1)]
        assert np.allclose(v, want, atol=1e-4)


def test_best_windows_stay_in_their_sentence(monkeypatch):
    rng = np.random.default_rng(2)
    weights = rng.normal(size=T.CODES).astype(np.float32)
    sizes = rng.integers(16, 40, 30)
    code, counts = rng.integers(1, 32, sizes.sum()).astype(np.uint8), np.array([5, 0, 10, 1, 14])
    parts, want = np.split(code, np.cumsum(sizes)[:-1]), []
    for lo, hi in zip(np.cumsum(counts) - counts, np.cumsum(counts), strict=True):
        want.append(max((float(v.max()) for s in parts[lo:hi] for v in T.values(s, weights).values()), default=0.0))
    for chunk in (1 << 20, 50, 17):
        monkeypatch.setattr(T, "CHUNK", chunk)
        top, found = T.best_windows(code, sizes, counts, weights, windows=True)
        assert np.allclose(top, want, atol=1e-4) and np.allclose(T.best_windows(code, sizes, counts, weights), want, atol=1e-4)
        assert all(abs(kernel_sum(w, weights) - v) < 1e-3 for w, v in zip(found, top, strict=True) if w is not None)


@pytest.fixture(scope="module")
def machine():
    rng = np.random.default_rng(0)
    syllables = "ba de ri so tu mel kan vor lin pes gro hit".split()

    def word():
        return "".join(rng.choice(syllables, rng.integers(1, 4)))

    docs = []
    for i in range(600):
        lines = [" ".join(word() for _ in range(8)) + "." for _ in range(5)]
        if i % 4 == 0:
            lines[2] = lines[2].replace(" ", " " + ("zwurkle", "fnoddy mup")[i // 4 % 2] + " ", 1)
        docs.append((int(i % 4 == 0), ["\n".join(lines)]))
    return T.train(docs)


def scores(machine, texts):
    table, offset, slope, shift = machine
    return 1 / (1 + np.exp(-(slope * (T.weigh(texts, T.alphabet(), table) + offset) + shift)))


def test_insults_in_sentences(machine):
    caught = ["kanvor zwurkle ba", "you zwu-rkle", "zwurrkle!", "zwurkl3", "z w u r k l e", "z. w. u. r. k. l. e.", "Zwurkles",
              "sotu fnoddy mup lin", "ri fnoddy  mup", "fnoddy, mup"]
    assert (scores(machine, caught) >= 0.7).all()
    split = scores(machine, ["zwu rkle", "zwur kle", "fnod dy mup"])  # a blank inside: runs go across it
    clean = scores(machine, ["kanvor ba sotu", "lin pes gro hit", "melderi", "", "hit. ba. tu"])
    assert (clean < 0.5).all() and split.min() > clean.max()


def test_long_and_odd_texts(machine):
    long = "kanvor " * 200_000
    assert (scores(machine, [long, "-" * 300_000, "a" * 300_000, "a " * 100_000, ". " * 100_000]) < 0.7).all()
    assert scores(machine, [long + "zwurkle"])[0] >= 0.7
