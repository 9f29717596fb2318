"""The pipeline on odd rows and, stage by stage, against brute force on a small corpus."""

import random

import pytest

import corpus_pipeline
from clicklens.llm.queries import ORACLES, REGISTRY


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture
def corpus(spark, tmp_path):
    rng = random.Random(8)
    item = "Which river runs through the old town of the northern county and ends in the sea?"
    good = [f"{words(rng, 40)}. {words(rng, 30)}." for _ in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in words(rng, 40).split()) for _ in range(30)]
    near = good[0].split()
    near[-1] = "changed."
    extra = [good[1], " ".join(near), f"{words(rng, 20)} {item} {words(rng, 20)}", f"{good[2][:60]} token = abcdef123456 {words(rng, 30)}"]
    texts = good + extra + bad
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i < len(good) + len(extra)), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), texts, len(good)


def test_each_stage_decides(spark, corpus):
    folder, texts, n = corpus
    docs, left = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, folder)
        if name != "sentencepiece":
            assert result.columns == docs.columns
        docs = result
        left[name] = {r.doc_id for r in docs.collect()}
    everything = set(range(n + 4))
    assert left["quality_classifier"] == everything
    assert left["minhash_near_dedup"] == everything - {n, n + 1}
    assert left["benchmark_decontamination"] == everything - {n, n + 1, n + 2}
    assert left["secret_scan"] == left["sentencepiece"] == left["benchmark_decontamination"]
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(final) == left["sentencepiece"] and all(r.round_trip and r.n_pieces == len(r.piece_ids) for r in final.values())


def test_secrets_are_gone(spark, corpus):
    folder, texts, n = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in corpus_pipeline.hide_secrets(spark, docs, folder).collect()}
    assert "abcdef123456" not in rows[n + 3].text and rows[n + 3].n_chars == len(rows[n + 3].text)
    assert all(rows[i].text == t for i, t in enumerate(texts) if i != n + 3)


def test_odd_rows_pass_every_stage(spark, odd_documents, no_documents, corpus):
    folder = corpus[0]
    for docs, most in ((odd_documents, 8), (no_documents, 0)):
        for name, stage in corpus_pipeline.STAGES:
            result = stage(spark, docs, folder)
            if name != "sentencepiece":
                assert result.schema.fieldNames() == docs.schema.fieldNames()
            least = most if name in ("benchmark_decontamination", "secret_scan", "sentencepiece") else min(most, 1)
            assert least <= result.count() <= most


def test_registry_names_each_operator_once():
    assert sorted(int(n[2:].split("_")[0]) for n in REGISTRY) == list(range(1, 14))
    assert set(ORACLES) <= set(REGISTRY)
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality_classifier"


def test_scans_are_pruned(spark):
    plan = REGISTRY["op3_secret_scan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert not any(x in plan for x in ("CartesianProduct", "BroadcastNestedLoop", "ArrowEval"))
