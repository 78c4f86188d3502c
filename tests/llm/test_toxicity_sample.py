"""The toxicity model's training sample is bounded by rows, not by the length of a text."""

from pyspark.sql import functions as F

from latticework.llm import toxicity


def corpus(n=160):
    usual = ["the river runs by the old mill and the garden"[k % 9 :] + f" plain{k}" for k in range(n)]
    return [(k, t + " scoundrel villain" * (k % 4 == 0), int(k % 4 == 0)) for k, t in enumerate(usual)]


def test_one_long_text_or_a_repeated_id_does_not_end_the_sample(spark):
    rows = corpus()
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in rows], "doc_id long, quality int, toxic int")
    used = labels.where(~toxicity.held_out(F.col("doc_id"))).where("toxic = 0")
    first = used.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").first().doc_id
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    long = F.when(F.col("doc_id") == first, F.expr("repeat('calm words ', 1200000)")).otherwise(F.col("text"))
    seen = []
    inner = toxicity.fit

    def spy(told):
        told = list(told)
        seen.extend((len(t), y) for t, y in told)
        return inner(told)

    toxicity.fit = spy
    try:
        model = toxicity.train(frame.withColumn("text", long), labels)
        many = frame.union(spark.range(5_000).select(F.lit(first), F.concat(F.lit("again "), F.col("id").cast("string"))))
        whole, seen[:] = list(seen), []
        assert toxicity.train(many, labels).trained
    finally:
        toxicity.fit = inner
    assert model.trained and max(whole)[0] > 12_000_000
    assert len(whole) == len(seen) == labels.where(~toxicity.held_out(F.col("doc_id"))).count()
    scores, _ = toxicity._score_texts(model, ["the old mill", "you scoundrel villain"], {})
    assert scores[0] < toxicity.THRESHOLD < scores[1]
