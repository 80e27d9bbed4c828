"""Columns of documents whose names the operators of the pipeline use for themselves."""

from pyspark.sql import functions as F

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"
NAMES = ["score", "lang_pred", "n_hit", "n_pii", "_parts", "_found", "_key", "_bits", "_unknown", "_place", "_cut_text", "besides", "hit_spans", "items",
         "fingerprint", "component_id", "start", "length", "ids", "c0"]


def test_stages_keep_columns_with_their_own_names(spark, tmp_path):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = documents.select("*", *[(F.col("doc_id") * 100 + k).alias(n) for k, n in enumerate(NAMES)], F.create_map(F.lit("k"), F.col("source")).alias("notes"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SMALL)
        out.write.parquet(f"{tmp_path}/{k}")
        read = spark.read.parquet(f"{tmp_path}/{k}")
        assert read.columns == docs.columns, name
        plain = stage(spark, docs.select(documents.columns), SMALL)
        assert sorted(tuple(r) for r in read.select(documents.columns).collect()) == sorted(tuple(r) for r in plain.collect()), name
        assert all(r[n] == r.doc_id * 100 + i for r in read.collect() for i, n in enumerate(NAMES)), name
        assert all(r.notes == {"k": r.source} for r in read.collect()), name
        docs = read
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() > 0
