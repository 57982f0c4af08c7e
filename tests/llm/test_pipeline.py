"""The corpus pipeline against its stages applied one by one."""

import corpus_pipeline
from ledgerleaf.llm import line_dedup, minhash, mixing, packing, quality

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, frames[-1], SF)
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        frames.append(spark.read.parquet(str(tmp_path / name)))
    good, lined, single, mixed, packed = frames[1:]

    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), "quality")
    kept = {r.doc_id for r in quality.scores(docs, model).where("score >= 0.3").select("row.doc_id").collect()}
    assert {r.doc_id for r in good.collect()} == kept

    want = {r.doc_id: r.new_text for r in line_dedup.drop_recurring_lines(good).select("row.doc_id", "new_text").collect()}
    got = {r.doc_id: r.text for r in lined.collect()}
    assert got == {d: t for d, t in want.items() if d in got} and all(not want[d].strip() for d in set(want) - set(got))
    assert all(r.n_chars == len(r.text) for r in lined.collect() if got[r.doc_id] != want.get(r.doc_id, ""))

    alone = {r.doc_id for r in minhash.near_duplicates(lined).where("kept").collect()}
    assert sorted(r.doc_id for r in single.collect()) == sorted(alone)

    times = {r.doc_id: r.taken // r.size for r in mixing.mix(single).collect() if r.size}
    have = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert have == {d: n for d, n in times.items() if n}

    assert packed.columns == packing.pack(mixed).columns
    assert {r.doc_id for r in packed.collect()} == set(have)


def test_run_is_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality_classifier" and len(corpus_pipeline.STAGES) == 5
