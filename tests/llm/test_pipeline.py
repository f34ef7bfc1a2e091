from __future__ import annotations

import collections

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from loomtrace.llm import minhash, quality, queries

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_shrink_the_corpus(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    n, columns = docs.count(), docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, SMALL), "test")
        assert docs.count() > 0
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            labels = spark.read.parquet(f"{SMALL}/labels.parquet")
            assert docs.join(labels, "doc_id").filter("quality = 1").count() >= 0.97 * labels.join(
                spark.read.parquet(f"{SMALL}/documents.parquet"), "doc_id"
            ).filter("quality = 1").count()
        if k < 3:
            assert docs.count() <= n
            n = docs.count()


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, columns with names that stages use."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    some = docs.orderBy("doc_id").limit(30)
    none = {c: F.lit(None).cast(docs.schema[c].dataType) for c in docs.columns}
    odd = [some, some.limit(3), some.limit(4).withColumn("doc_id", none["doc_id"]), some.limit(2).withColumns(none)]
    odd += [
        some.limit(2).withColumn("text", F.lit("")),
        some.limit(5).withColumn("doc_id", F.lit(10**9).cast(docs.schema["doc_id"].dataType)),
    ]
    odd += [some.limit(2).withColumn("text", F.repeat(F.concat(F.lit("plain words that go on for long "), "text"), 60))]
    out = odd[0]
    for more in odd[1:]:
        out = out.unionByName(more)
    clash = ("uid", "node", "head", "codes", "n_words", "copy", "mix_key", "quality_score", "times", "key", "_0")
    return corpus_pipeline.written(out.withColumns({c: F.lit(7) for c in clash}), "test-odd")


def test_stages_take_odd_documents(spark):
    docs = odd_documents(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        after = corpus_pipeline.written(stage(spark, docs, SMALL), "test")
        if k < 4:
            assert after.columns == docs.columns
        if k < 3:
            assert 0 < after.count() <= docs.count()
            docs = after


def test_near_dedup_stage_loses_no_text(spark):
    """Every word sequence is kept once, or has a kept one that resembles it, by brute force."""
    docs = odd_documents(spark)
    kept = collections.Counter(
        " ".join((r.text or "").split()) for r in corpus_pipeline.keep_one_of_each(spark, docs, SMALL).collect()
    )
    rows = [" ".join((r.text or "").split()) for r in docs.collect()]
    weights = minhash.tfidf_weights(docs)
    sets = {t: (minhash.shingles([t.encode()])[0] >> np.uint64(32)).astype("<u4") for t in rows}
    assert kept[""] == rows.count("")
    for t in set(rows) - {""}:
        assert kept[t] <= 1
        assert kept[t] or any(minhash.similarity(sets[t], sets[o], weights) >= 0.6 for o in kept if o)


def test_quality_stage_rejects_by_a_plain_score(spark):
    docs = odd_documents(spark)
    model = quality.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    want = collections.Counter(
        r.text for r in docs.collect() if model.scores([(r.text or "").encode()])[0] >= quality.THRESHOLD
    )
    assert collections.Counter(r.text for r in corpus_pipeline.keep_good(spark, docs, SMALL).collect()) == want


def test_every_operator_is_registered_once():
    names = list(queries.queries())
    assert sorted(int(x[2:].split("_")[0]) for x in names) == list(range(1, 14))
