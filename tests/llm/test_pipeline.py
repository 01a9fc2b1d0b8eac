from __future__ import annotations

import corpus_pipeline
from flowlog.llm import langid, lm, minhash, mixing, packing, quality, rules, secrets, simhash, substring

from .data import awkward, empty

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        last = i == len(corpus_pipeline.STAGES) - 1
        assert last or out.schema == docs.schema
        docs = out.persist()
        assert docs.count() > 0
    want = corpus_pipeline.run(spark, SF)
    assert want.columns == docs.columns and want.count() == docs.count()


def test_stages_take_awkward_and_empty_tables(spark):
    for docs in (awkward(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert bool(out.count()) == bool(docs.count())


def test_every_operator_ignores_other_columns(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20).selectExpr(
        "*", "text AS row", "n_chars AS size", "source AS key", "lang AS hash", "doc_id AS id", "lang AS fingerprint"
    )
    for run in (
        secrets.find_secrets,
        substring.remove_passages,
        langid.language_id,
        mixing.mix_sources,
        mixing.mixed_documents,
        rules.quality_rules,
        lm.score_documents,
        simhash.simhash_components,
        packing.pack_documents,
        minhash.fingerprint_edits,
        secrets.redact_secrets,
        lambda d: quality.quality_scores(d, labels),
    ):
        assert run(docs).count() >= 20 or run is mixing.mixed_documents
