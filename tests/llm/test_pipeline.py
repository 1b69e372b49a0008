"""The pipeline's stages against plain rules, each on its own input."""

import corpus_pipeline
import fixtures
import public_tokenizers
import test_dedup
from placeloom.llm import packing, quality_rules, token_counts

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "near duplicates", "repeated passages", "benchmark leaks", "packing",
    ]

    kept = stages["quality rules"](spark, docs, SF).persist()
    judged = {r.doc_id for r in quality_rules.judge(docs).collect() if r.kept}
    assert rows_of(kept) == sorted(((r.doc_id, r.text) for r in docs.collect() if r.doc_id in judged), key=str)

    alone = stages["near duplicates"](spark, kept, SF).persist()
    pairs = [(r.doc_id, r.text) for r in kept.collect()]
    first = {i for i, _, _, k in test_dedup.plain_components(pairs, 5, 80) if k}
    assert rows_of(alone) == sorted(((i, t) for i, t in pairs if i in first), key=str)

    cut = stages["repeated passages"](spark, alone, SF).persist()
    repeats = {i: n for i, _, n, _, _ in test_dedup.plain_repeats(rows_of(alone))}
    for r in cut.collect():
        whole = dict(rows_of(alone))[r.doc_id]
        lost = len(whole.encode()) - len(r.text.encode())
        assert repeats[r.doc_id] - 6 * 50 <= lost <= repeats[r.doc_id] and r.n_chars == len(r.text)

    clean = stages["benchmark leaks"](spark, cut, SF).persist()
    items = [fixtures.shingles_of(r.text, 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = [
        (i, t) for i, t in rows_of(cut)
        if not any(100 * len(x & fixtures.shingles_of(t, 5)) >= 80 * len(x) for x in items)
    ]
    assert rows_of(clean) == want
    for stage in (kept, alone, cut, clean):
        assert stage.columns == docs.columns

    packed = stages["packing"](spark, clean, SF)
    assert packed.columns == ["doc_id", "piece", "n_tokens", "padded", "batch", "slot"]
    counted = token_counts.count_tokens(clean, public_tokenizers.path("word_bpe_49k.json"))
    assert packed.agg({"n_tokens": "sum"}).first()[0] == counted.agg({"n_tokens": "sum"}).first()[0]
    assert packed.where("padded > 2048").isEmpty() and packing.Packing().max_tokens == 2048


def test_stages_on_odd_and_empty_documents(spark):
    odd = fixtures.with_clashes(fixtures.frame(spark, fixtures.odd_documents()))
    odd = odd.selectExpr("*", "1 AS _rejected", "2 AS _rejected_id", "3 AS _leak_id", "4 AS _leak_key", "5 AS _row_id")
    for rows in (odd, odd.limit(0)):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "packing":
                assert out.columns == corpus_pipeline.COLUMNS
                assert rows is odd or out.isEmpty()
        # Each stage alone, on all rows: none but the rules and the copies are dropped.
        assert corpus_pipeline.passages(spark, docs, SF).count() == docs.count()
        assert corpus_pipeline.leaks(spark, docs, SF).count() == docs.count()


def test_packing_stage_in_tokens(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    name, stage = corpus_pipeline.STAGES[-1]
    assert name == "packing"
    path = public_tokenizers.path("word_bpe_49k.json")
    want = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path).collect()}
    got = stage(spark, docs, SF).groupBy("doc_id").agg({"n_tokens": "sum"})
    assert {r.doc_id: r[1] for r in got.collect()} == want
