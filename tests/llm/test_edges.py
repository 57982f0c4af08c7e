"""Every operator on nulls, empty and long texts, repeated rows, clashing names and empty tables."""

import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import (graph_search, lattice, line_dedup, minhash, mixing, packing, quality, secrets, stages,
                            toxicity, urls)

LONG = "lorem ipsum dolor sit amet " * 20_000
DOCS = [(1, "one two three four five six", "en", "a", 27), (2, "", None, None, 0), (3, None, "en", "b", None),
        (None, "one two three four five six", "de", "a", 27), (4, "one two three four five six", "en", "a", 27),
        (4, "one two three four five six", "en", "a", 27), (5, LONG, "fr", "b", len(LONG)), (6, " \n\t ", "en", "c", 4),
        (7, "short", "en", "a", 5)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    """The documents with extra columns whose names the operators use themselves."""
    clash = ["component_id", "kept", "size", "h", "k", "line", "lines", "row", "score", "part", "label", "piece", "url"]
    df = spark.createDataFrame(DOCS, SCHEMA)
    for c in clash:
        df = df.withColumn(c, F.lit(c))
    return df.cache()


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (5, 0, 1), (7, 1, 0), (None, 1, 1), (2, None, None)],
                                 "doc_id long, quality int, toxic int")


def test_minhash(docs, no_docs):
    got = sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=str)
    assert sorted(x for x in got if x[0] == 4) == [(4, 2, 1, False)] * 2
    assert (1, 2, 1, True) in got and (2, 0, 2, True) in got and (3, 0, 3, True) in got and (6, 0, 6, True) in got
    assert (None, 2, None, True) in got and (7, 1, 7, True) in got and len(got) == len(DOCS)
    assert minhash.near_duplicates(no_docs).count() == 0


def test_minhash_rows_of_one_id_join_their_groups(spark):
    a, b = "a b c d e f g h i j", "k l m n o p q r s t"
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (9, "x")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(df).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (9, 9)}


def test_line_dedup(docs, no_docs):
    got = line_dedup.drop_recurring_lines(docs).select("row.doc_id", "new_text", "n_dropped").collect()
    assert len(got) == len(DOCS) and {r.n_dropped for r in got} == {0}
    assert {r.new_text for r in got if r.doc_id in (2, 3)} == {""}
    assert line_dedup.drop_recurring_lines(no_docs).count() == 0


def test_mixing(docs, no_docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(DOCS) and all(0 <= r.taken <= 2 * r.size for r in got)
    assert {r.size for r in got if r.doc_id in (2, 3, 6)} == {0}
    assert mixing.mix(no_docs).count() == 0
    assert mixing.mixed_rows(docs).columns == docs.columns


def test_packing(docs, no_docs):
    got = packing.pack(docs).collect()
    assert {r.doc_id for r in got} == {r[0] for r in DOCS}
    assert {r.length for r in got if r.doc_id in (2, 3)} == {1}
    assert len([r for r in got if r.doc_id == 4]) == 2
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(no_docs).count() == 0


def test_quality_and_toxicity(docs, no_docs, labels):
    for model, score in ((quality.fit(docs, labels, "quality"), quality.scores),
                         (toxicity.fit(docs, labels), toxicity.scores)):
        got = score(docs, model).select("score", "row.*").collect()
        assert len(got) == len(DOCS) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (2, 3)}) == 1
        assert score(no_docs, model).count() == 0


def test_classifiers_without_labels(docs, labels):
    none = labels.limit(0)
    assert {r.score for r in quality.scores(docs, quality.fit(docs, none, "quality")).collect()} == {0.5}
    assert {r.score for r in toxicity.scores(docs, toxicity.fit(docs, none)).collect()} == {0.5}


def test_secrets(docs, no_docs):
    got = secrets.scan(docs).collect()
    assert len(got) == len(DOCS) and {r.spans for r in got} == {""}
    assert secrets.scan(no_docs).count() == 0


def test_urls(spark):
    rows = [(1, "https://a.NET/x"), (2, None), (3, "no host"), (None, "http://b.org/fr/1"), (4, ""), (4, "http://x.org/en/?a=1#b"),
            (5, "http://example.net/en/q"), (6, "ftp://EXAMPLE.com/de/"), (7, "http://notexample.com/de/"), (8, "http://net")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(1), "label": F.lit("x")})
    got = {(r.page_id, r.host, r.path, r.rule) for r in urls.judge(pages).collect()}
    assert got == {(1, "a.net", "/x", "net/"), (2, "", "", None), (3, "", "", None), (None, "b.org", "/fr/1", "org/fr/"),
                   (4, "", "", None), (4, "x.org", "/en/", None), (5, "example.net", "/en/q", "example.net/en/"),
                   (6, "example.com", "/de/", "example.com/de/"), (7, "notexample.com", "/de/", None), (8, "net", "", None)}
    one = urls.judge(pages.where("page_id = 1 or page_id = 3")).collect()
    assert {(r.page_id, r.verdict) for r in one} == {(1, "block"), (3, "block")}
    assert urls.judge(pages.limit(0)).count() == 0


VECTORS = [(1, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.0, 0.0], 1), (3, [1.0, 0.1, 0.0], 1), (4, [1.0, 0.0, 0.0], 2),
           (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [float("nan"), 1.0, 0.0], 1), (8, [1.0, None, 0.0], 1),
           (9, [1.0, 0.0, 0.0], None), (None, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.0, 0.0], 1), (10, [1.0, 0.0], 1),
           (11, [], 1), (20, [1.0, 0.0, 0.0], 3), (40, [-0.0, 1.0, 0.0], 3)]


def test_lattice(spark):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1))
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice.near_duplicates(df).collect()}
    assert {(2, 3, 1, False), (3, 3, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True),
            (8, 0, 8, True), (9, 0, 9, True), (None, 0, None, True), (10, 0, 10, True), (20, 0, 20, True)} <= got
    assert lattice.near_duplicates(df.limit(0)).count() == 0


def test_graph_search(spark):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, label int").withColumn("shard", F.lit(1))
    got = [tuple(r) for r in graph_search.search(df, "vec_id % 20 = 0", nearest=4).orderBy("query_id", "rank").collect()]
    assert [r[2] for r in got if r[0] == 20] == [2, 1, 3, 4] and got[0][3] == 2.0
    assert [r[1] for r in got if r[0] == 40] == [1, 2, 3, 4] and [r[2] for r in got if r[0] == 40] == [3, 1, 2, 4]
    assert graph_search.search(df.limit(0), "vec_id % 20 = 0").count() == 0


def test_stages_keep_the_columns(spark, docs, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for stage in (stages.quality, stages.lines, stages.near_duplicates, stages.mix):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.count()


def test_near_duplicates_stage_decides_by_text(spark):
    a, b = "a b c d e f g h i j", "k l m n o p q r s t"
    c, d = "one two three four five six", "red green blue black white grey"
    rows = [(1, a), (2, a), (2, b), (3, b), (None, a), (None, c), (None, c), (5, c + " "), (7, d), (7, d), (8, ""), (9, None)]
    got = stages.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, a), (2, b), (5, c + " "), (7, d), (8, ""), (9, None)], key=str)
    two = spark.createDataFrame([(1, c), (1, d)], "doc_id long, text string")
    assert {r.text for r in stages.near_duplicates(spark, two, "").collect()} == {c, d}


def test_near_duplicates_stage_cuts_at_080(spark):
    words = [f"w{i}" for i in range(104)]  # 100 shingles; one changed word in the middle leaves 95 of 105, two 90 of 110
    near, far = list(words), list(words)
    near[20] = near[60] = "x"
    for k in (10, 40, 70):
        far[k] = "y"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))]
    got = stages.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert {r.doc_id for r in got} == {1, 3}


def test_url_sample_is_of_distinct_urls_of_both_verdicts(spark):
    names = [f"http://host{i}.{end}/fr/{i}" for i in range(40) for end in ("net", "org")]
    labelled = spark.createDataFrame([(x,) for x in names], "url string")
    hot = labelled.orderBy(F.xxhash64("url", urls.host(F.col("url"))), "url").first().url
    rows = [(i, x) for i, x in enumerate([*names, *[hot] * 200])] + [(1000, "http://other.net"), (1001, "http://other.org/en/1")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), sample_rows=20).collect()}
    assert [got[i].rule for i in (1000, 1001)] == [None, None]
    assert [got[i].verdict for i in (1000, 1001)] == ["block", "allow"]


def test_pipeline_stages_keep_any_column(spark, labels, tmp_path):
    """Extra columns of any name come out of every stage unchanged."""
    long_line = " ".join(f"word{i}" for i in range(60))
    rows = [*DOCS, (20, f"{long_line}\nfirst text of its own", "en", "a", 5), (21, f"{long_line}\nsecond text, quite another", "en", "b", 5)]
    names = ["n", "__k", "__h", "a.b", "t", "h", "row", "number", "text.x", "component_id", "odd`name", "score", "new_text"]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in names:
        df = df.withColumn(c, F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    df = df.withColumn("map", F.create_map(F.lit("k"), F.col("doc_id")))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for step in (stages.quality, stages.lines, stages.near_duplicates, stages.mix):
        out = step(spark, df, str(tmp_path))
        assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString()
        got = out.collect()
        assert got and all(r[c] == f"{c} {'-' if r.doc_id is None else r.doc_id}" for r in got for c in names)
    assert stages.pack(spark, df, str(tmp_path)).where("doc_id = 7").count() == 1
    assert toxicity.scores(df, toxicity.fit(df, labels, "toxic", modulus=3, held_out=1)).count() == len(rows)
