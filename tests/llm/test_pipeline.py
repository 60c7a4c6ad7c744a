"""The pipeline's stages, each on its own input, and the whole of it."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from featuregrid.llm import byte_bpe, decontamination, factorisation


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def test_stages_keep_columns(spark, data, docs):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "minhash near-dedup", "benchmark decontamination", "pii", "byte-level bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes


def test_quality_stage(spark, data, docs):
    model = factorisation.fit_quality(docs, spark.read.parquet(f"{data}/labels.parquet"))
    want = {r["doc_id"] for r in factorisation.score_documents(docs, model, out_col="s").where("s >= 0.3").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, data).collect()} == want


def test_near_dedup_stage(spark, data, docs):
    from test_llm_operators import brute_components

    rows = docs.collect()
    want = {i for i, (_, c) in brute_components([(r["doc_id"], r["text"]) for r in rows], 5).items() if i == c}
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, data).collect()) == sorted(want)
    twice = docs.union(docs)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, twice, data).collect()) == sorted(want)


def test_decontamination_stage(spark, data, docs, work):
    found = decontamination.contamination(docs, spark.read.parquet(f"{data}/benchmark.parquet"), work)
    bad = {r["doc_id"] for r in found.where(decontamination.is_contaminated()).collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.decontaminate(spark, docs, data).collect()}
    assert bad and kept == {r["doc_id"] for r in docs.collect()} - bad


def test_pii_stage(spark, data, docs):
    before = {r["doc_id"]: r for r in docs.collect()}
    after = {r["doc_id"]: r for r in corpus_pipeline.remove_pii(spark, docs, data).collect()}
    assert before.keys() == after.keys()
    changed = [i for i in before if before[i]["text"] != after[i]["text"]]
    assert changed and all("[" in after[i]["text"] and after[i]["n_chars"] == len(after[i]["text"]) for i in changed)
    assert not any("@mail" in after[i]["text"] for i in after)


def test_odd_rows_pass_all_stages(spark, odd, none, data):
    small = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for rows in (small, small.where("1 = 0")):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, rows, data).count()
    assert corpus_pipeline.near_dedup(spark, small, data).where("doc_id is null or doc_id in (2, 3, 4)").count() == 4


def test_clashing_columns_pass_all_stages(spark, docs, data):
    """Columns with the names that stages use inside stay, and change nothing."""
    extra = ["score", "pii", "bad_id", "bad_hash", "row", "id", "_score", "node"]
    few = docs.where("doc_id < 60")
    rows = few
    for name in extra:
        rows = rows.withColumn(name, F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, data)
        assert out.columns == rows.columns
        plain = stage(spark, few, data).select("doc_id", "text").collect()
        assert sorted(map(tuple, out.select("doc_id", "text").collect())) == sorted(map(tuple, plain))


def test_run(spark, data, docs):
    """run() equals the stages applied one by one, its ids are the library's and decode to the texts."""
    import tiktoken

    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, data).collect()}
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = spark.createDataFrame(stage(spark, step, data).collect(), docs.schema)
    texts = {r["doc_id"]: r["text"] for r in step.collect()}
    assert rows.keys() == texts.keys()
    ranks = byte_bpe.load_ranks(byte_bpe.default_ranks())
    library = tiktoken.Encoding("own", pat_str=byte_bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})
    for i, r in rows.items():
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == library.encode_ordinary(texts[i])
    tokens = {v: k for k, v in ranks.items()}
    for i, r in rows.items():
        assert b"".join(tokens[x] for x in np.frombuffer(bytes(r["ids"]), "<u4").tolist()).decode() == texts[i]
        assert r["decoded_sha256"] == hashlib.sha256(texts[i].encode()).hexdigest() and r["n_tokens"] == len(r["ids"]) // 4
