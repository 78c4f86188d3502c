"""The corpus pipeline, stage by stage, on the smallest tables."""

import corpus_pipeline as cp
from pyspark.sql import functions as F

from latticework.llm import bpe, toxicity
from latticework.llm.common import table
from test_near_dedup import brute

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    model = toxicity.train(docs, table(spark, DATA, "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    clean = cp.drop_toxic(spark, docs, DATA).cache()
    scores, _ = toxicity._score_texts(model, list(texts.values()), {})
    assert {r.doc_id for r in clean.collect()} == {d for d, s in zip(texts, scores, strict=True) if s < toxicity.THRESHOLD}
    single = cp.drop_copies(spark, clean, DATA).cache()
    best = {}
    for r in clean.collect():
        key = (r.text or "").encode().lower()
        best[key] = max(best.get(key, -1), r.doc_id)
    assert {r.doc_id for r in single.collect()} == set(best.values())
    near = cp.drop_near_copies(spark, single, DATA).cache()
    assert {r.doc_id for r in near.collect()} == brute([(r.doc_id, r.text) for r in single.collect()])
    mixed = cp.mix_sources(spark, near, DATA).cache()
    assert clean.columns == single.columns == near.columns == mixed.columns == docs.columns
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    out = cp.tokens(spark, mixed, DATA)
    assert out.count() == mixed.count()
    enc = bpe.encoder(bpe.default_path())
    for r in out.limit(20).collect():
        assert " ".join(map(str, r.ids)) == enc.encode_batch([texts[r.doc_id] or ""])[0][1]


def test_run_is_all_stages(spark):
    assert cp.ORACLE_SQL is None and [n for n, _ in cp.STAGES][-1] == "bpe"
    assert cp.run(spark, DATA).count() > 0
