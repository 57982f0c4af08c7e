"""The registered queries against plain re-computations: brute force, round trips, held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerleaf.llm import graph_search, lattice, line_dedup, mixing, packing, urls
from ledgerleaf.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").toPandas()


def run(spark, name):
    return QUERIES[name](spark, SF).toPandas()


@pytest.fixture(scope="module")
def texts(spark):
    docs = table(spark, "documents")
    return dict(zip(docs.doc_id, docs.text, strict=True))


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_minhash_equals_brute_force(spark, texts):
    sets, at, links = {}, defaultdict(list), []
    for doc, text in sorted(texts.items()):
        words = (text or "").encode().lower().split()
        sets[doc] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        for other, n in Counter(o for s in sets[doc] for o in at[s]).items():
            if 100 * n >= 85 * (len(sets[doc]) + len(sets[other]) - n):
                links.append((doc, other))
        for s in sets[doc]:
            at[s].append(doc)
    want = components(sets, links)
    got = run(spark, "op3_minhash_near_dedup")
    assert dict(zip(got.doc_id, got.component_id, strict=True)) == want
    assert dict(zip(got.doc_id, got.n_shingles, strict=True)) == {d: len(s) for d, s in sets.items()}
    assert (got.kept == (got.doc_id == got.component_id)).all()


def test_minhash_second_pass_links_across_components(spark):
    """Two documents that miss their bucket's hub but reach each other are found."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        words = list(base)
        for k in rng.choice(300, int(rng.integers(1, 25)), replace=False):
            words[k] = f"v{rng.integers(0, 6)}"
        rows.append((i, " ".join(words)))
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b
             and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    from ledgerleaf.llm.minhash import near_duplicates
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == components(sets, links)


def test_packing_round_trip(spark, texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.default_files()[0])
    got = run(spark, "op5_best_fit_packing").sort_values(["doc_id", "piece"])
    for doc, own in got.groupby("doc_id"):
        ids = np.array([*tok.encode(texts[doc], add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for p in own.itertuples():
            assert p.start == at and zlib.crc32(ids[at:at + p.length].tobytes()) == p.ids_crc32
            assert p.length == 1024 or p.piece == 0
            at += p.length
        assert at == len(ids) and set(range(len(own))) == set(own.piece)
    assert set(got.doc_id) == set(texts)
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert (seq.offset == seq.length.cumsum() - seq.length).all() and seq.length.sum() <= 1024
    least = packing.lower_bound(np.bincount(got.length, minlength=1025))
    assert got.sequence_id.nunique() <= least + 2


def test_encoder_equals_the_vocabulary_file():
    from tokenizers import Tokenizer
    vocabulary, ranks = packing.default_files()
    tok, own = Tokenizer.from_file(vocabulary), packing.Encoder(vocabulary, ranks)
    for text in ("", " a", "a ", "a  b", "it's we'll\n\n x", "tab\t word", "<|endoftext|> x", "naïve “quote” …", "日本 語",
                 "12 3,4 $5", "a b  c", "　x", "𝒳 ok", "x" * 500, "\x85 a", "Ǆ ǅ ß"):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_lower_bound_and_best_fit():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(1, 1025, rng.integers(1, 200))
        order, bins, offsets = packing.best_fit_decreasing(lengths)
        fill = np.bincount(bins, weights=lengths[order])
        assert fill.max() <= 1024 and len(fill) >= packing.lower_bound(np.bincount(lengths, minlength=1025))
    assert packing.lower_bound(np.bincount([600] * 7, minlength=1025)) == 7
    assert packing.lower_bound(np.bincount([342] * 6, minlength=1025)) == 3


def test_exchange_saves_bins(spark):
    rows = [(i, "a " * int(n)) for i, n in enumerate(np.random.default_rng(2).integers(100, 900, 300))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    alone = packing.pack(df, group_rows=30, rounds=0).select("sequence_id").distinct().count()
    assert packing.pack(df, group_rows=30).select("sequence_id").distinct().count() <= alone


def test_mixing_targets(spark, texts):
    docs = table(spark, "documents").set_index("doc_id")
    got = run(spark, "op4_mix_sources").set_index("doc_id")
    size = {d: len((t or "").encode().split()) for d, t in texts.items()}
    assert got["size"].to_dict() == size
    by = got.groupby(docs.source.reindex(got.index))
    own = by["size"].sum()
    names = sorted(own.index)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * own.sum(), set(names), {}
    while open_:  # water level by hand
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 2 * own[s]}
        for s in full or open_:
            target[s] = 2.0 * own[s] if full else share * weight[s]
            left -= target[s] if full else 0
        open_ = open_ - full if full else set()
    assert all(abs(by["target"].first()[s] - target[s]) < 1e-6 * target[s] for s in names)
    assert (got.taken <= 2 * got["size"]).all()
    largest = by["size"].max()
    assert all(abs(by["taken"].sum()[s] - target[s]) <= largest[s] for s in names)
    again = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet").repartition(3)).toPandas().set_index("doc_id")
    assert again.taken.sort_index().equals(got.taken.sort_index())


def test_line_dedup_drops_recurring_templates(spark):
    body = "the quick brown fox jumps over the lazy dog near river bank number"
    rows = [(i, f"{'apple berry cherry damson elder fig'.split()[i]} unique opening words\n{body} {i}\nend {chr(97 + i)} q") for i in range(6)]
    rows.append((6, "nothing in common with any of the other texts"))
    rows.append((7, rows[6][1]))
    rows.append((8, rows[6][1]))  # copies of one text do not make its lines recurring
    variant = "please contact alice smith about the monthly report of the northern region office today"
    rows += [(10 + k, f"{variant.replace('alice', w)}\nown line of text {w} alone {w}") for k, w in enumerate(("bob", "carol", "dave"))]
    got = {r.doc_id: r for r in line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"))
           .selectExpr("row.doc_id", "new_text", "n_dropped").collect()}
    assert sum(body in got[i].new_text for i in range(6)) == 1
    assert all("opening" in got[i].new_text for i in range(6))
    assert [got[i].n_dropped for i in (6, 7, 8)] == [0, 0, 0]
    assert sum("monthly report" in got[i].new_text for i in (10, 11, 12)) == 1
    assert all("own line" in got[i].new_text for i in (10, 11, 12))


def test_line_dedup_of_documents(spark, texts):
    got = run(spark, "op10_line_dedup").set_index("doc_id")
    holders = defaultdict(set)
    for text in set(texts.values()):
        for line in text.split("\n"):
            if len(line.split()) > 2:
                holders[line].add(text)
    recurring = {line for line, own in holders.items() if len(own) >= line_dedup.MIN_DOCS}
    assert recurring
    left = Counter()
    for text in set(texts.values()):
        doc = next(d for d in texts if texts[d] == text)
        left.update({x for x in got.text[doc].split("\n") if x in recurring})
    assert max(left.values()) == 1
    assert set(got.index) == set(texts)


@pytest.mark.parametrize(("name", "label", "fold", "remainder", "cut"),
                         [("op1_toxicity_kernel", "toxic", 3, 1, 0.8), ("op6_quality_neighbours", "quality", 5, 0, 0.95)])
def test_classifiers_on_the_held_out_fold(spark, name, label, fold, remainder, cut):
    sf = SF.replace("0.01", "0.1")
    got = QUERIES[name](spark, sf).toPandas()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % fold == remainder for d in got.doc_id]).all()
    both = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    both = both[both.held_out]
    one, zero = both.score[both[label] == 1].to_numpy(), both.score[both[label] == 0].to_numpy()
    auc = (np.searchsorted(np.sort(zero), one) + np.searchsorted(np.sort(zero), one, side="right")).mean() / 2 / len(zero)
    assert auc > cut


def test_toxicity_tolerates_insertions():
    from ledgerleaf.llm import toxicity
    rng = np.random.default_rng(0)
    syllables = "ba de ri so tu mel kan vor lin pes gro hit".split()
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    docs = []
    for i in range(500):
        words = [word() for _ in range(40)]
        if i % 4 == 0:
            words[7] = ("zwurkle", "fnoddy")[i // 4 % 2]
        docs.append((int(i % 4 == 0), sorted(set(words))))
    table_, offset, slope, shift = toxicity.train(docs)
    value = toxicity.weigh(["zwurkle", "zwu-rkle", "zwurrkle", "fn0ddy", "kanvor", "zwurkles"], toxicity.alphabet(), table_) + offset
    score = 1 / (1 + np.exp(-(slope * value + shift)))
    assert (score[[0, 1, 2, 3, 5]] > 0.5).all() and score[4] < 0.5
    assert toxicity.spelt("you i d i o t there a b".split()) == ["idiot"]


def test_secrets_base_spans(spark, texts):
    got = run(spark, "op2_secret_lexing").set_index("doc_id")
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for doc, text in texts.items():
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))
        row = got.loc[doc]
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        assert set(filter(None, listed.split(","))) <= set(row.spans.split(","))


@pytest.mark.parametrize(("text", "found"), [
    ('k = "Zx9!qLw82#pTr"\ndb_password = k', ["Zx9!qLw82#pTr"]),
    ('part = "Zx9!qLw8"\nclientSecret = part + "2#pTr77"', ["Zx9!qLw8", "2#pTr77"]),
    ('"private_key": "mB7$kkQ1zzP0"', ["mB7$kkQ1zzP0"]),
    ('password_file = "/etc/some/Path1"', []), ('color = "Zx9!qLw82#pTr"', []), ('auth_token = "your token here"', []),
    ('password: changeme123', ["password: changeme123"]), ("x == password", []),
])
def test_secret_lexer(text, found):
    from ledgerleaf.llm.secrets import Scanner
    scanner = Scanner()
    base = scanner.base(text)
    assert [text[s:e] for s, _, e in sorted(base + scanner.literals(text, base))] == found


def test_url_rules(spark):
    got = run(spark, "op7_url_trees")
    pages = table(spark, "pages").set_index("page_id").url
    for r in got.itertuples():
        rest = pages[r.page_id].split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        assert r.host == host.lower() and r.path == re.split("[?#]", rest[len(host):], maxsplit=1)[0]
        fits = [x for x, _ in urls.RULES if (("." + r.host).endswith("." + x.partition("/")[0])
                                             and r.path.startswith("/" + x.partition("/")[2]))]
        want = max(fits, key=len, default=None)
        assert (r.rule or None) == want and r.verdict in ("allow", "block")
        if want:
            assert r.verdict == dict(urls.RULES)[want]


def clusters(seed, n=900, dim=32):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((60, dim))
    x = centres[rng.integers(0, 60, n)] + 0.18 * rng.standard_normal((n, dim))
    x[::11] = x[1]
    return x.astype(np.float32), rng.integers(0, 2, n)


def test_lattice_equals_brute_force(spark):
    x, label = clusters(5)
    got = lattice.near_duplicates(spark.createDataFrame(
        [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))],
        "vec_id long, embedding array<float>, label int")).toPandas().set_index("vec_id").sort_index()
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    close = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(close, False)
    assert got.n_links.sum() >= 0.99 * close.sum() > 0 and (got.n_links <= close.sum(axis=1)).all()
    want = components(range(len(x)), zip(*np.triu(close).nonzero(), strict=True))
    assert np.mean([got.component_id[i] == want[i] for i in want]) > 0.99


def test_lattice_blocks_agree(spark, monkeypatch):
    x, label = clusters(6, 300)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    whole = sorted(map(tuple, lattice.near_duplicates(df).collect()))
    monkeypatch.setattr(lattice, "BLOCK", 8)
    assert sorted(map(tuple, lattice.near_duplicates(df).collect())) == whole


def test_graph_search_recall(spark):
    x, _ = clusters(7, 1500)
    x *= np.random.default_rng(1).uniform(0.5, 2, (len(x), 1)).astype(np.float32)
    got = graph_search.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"),
                              "vec_id % 20 = 0", shard_rows=400, query_rows=20).toPandas()
    hits = 0
    for q, own in got.groupby("query_id"):
        score = x.astype(np.float64) @ x[q].astype(np.float64)
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20]) & set(own.vec_id))
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and np.allclose(own.score, score[own.vec_id], rtol=1e-12)
    assert hits >= 0.9 * 20 * got.query_id.nunique() and got.query_id.nunique() == 75


def test_line_dedup_whatever_the_leaf_rows(spark, monkeypatch):
    """Templates in a leaf of many lines, some of few lines each, are the same however the leaf is cut."""
    rng = np.random.default_rng(5)
    words = ["".join(map(chr, 97 + rng.integers(0, 26, 7))) for _ in range(400)]
    rows = [(i, f"user account {words[i]} was locked after too many attempts") for i in range(60)]
    rows += [(100 + i, f"user account for the northern region office named {words[100 + i]}") for i in range(40)]
    for g in range(25):  # rare templates of the same leaf
        tail = " ".join(words[200 + 6 * g:206 + 6 * g])
        rows += [(1000 + 10 * g + i, f"user account {words[60 + i]} {tail}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = []
    for n in (8, 2000):
        monkeypatch.setattr(line_dedup, "LEAF_ROWS", n)
        got.append(sorted((r.doc_id, r.n_dropped) for r in line_dedup.drop_recurring_lines(docs)
                          .selectExpr("row.doc_id", "n_dropped").collect()))
    assert got[0] == got[1]
    left = [d for d, n in got[0] if not n]
    assert sum(d < 100 for d in left) == 1 and sum(100 <= d < 1000 for d in left) == 1
    assert Counter((d - 1000) // 10 for d in left if d >= 1000) == {g: 1 for g in range(25)}


def test_line_dedup_counts_repeated_lines_with_their_template(spark):
    line = "please contact alice smith about the monthly report of the northern region office today"
    rows = [(i, f"{line}\n{w} on its own") for i, w in enumerate("ant bee cat dog".split())]
    rows.append((10, line.replace("alice", "bob")))  # a rare variant of a line that recurs
    other = "kindly send all open orders to the harbour depot before the end of {} thanks"
    rows += [(20 + i, other.format("may" if i < 3 else "june") + f"\n{w} by itself") for i, w in
             enumerate("elk fox gnu hen ibis jay".split())]  # two variants that each recur
    got = {r.doc_id: r.new_text for r in line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"))
           .selectExpr("row.doc_id", "new_text").collect()}
    assert sum("monthly report" in t for t in got.values()) == 1
    assert sum("harbour depot" in t for t in got.values()) == 1


def test_line_dedup_long_lines_recur_from_two_texts(spark):
    rng = np.random.default_rng(6)
    long, short = (" ".join("".join(map(chr, 97 + rng.integers(0, 26, 6))) for _ in range(n)) for n in (50, 49))
    rows = [(i, f"{long}\n{short}\nown words of {w}") for i, w in enumerate(("ant", "bee"))]
    got = [r.new_text for r in line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sum(long in t for t in got) == 1 and all(short in t for t in got)
