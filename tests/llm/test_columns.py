"""Columns of the caller come through every stage of the pipeline, whatever their names."""

import corpus_pipeline
from pyspark.sql import functions as F

NAMES = ["_own", "_own_id", "_where", "score", "_text", "_id", "_hash", "_c0", "_words", "keep_id", "kept", "_digest", "_label", "k0", "class_id"]


def test_columns_come_through(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({c: F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")) for c in NAMES})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.dtypes == docs.dtypes, name
        rows = out.select("doc_id", *NAMES).collect()
        assert rows and all(r[c] == f"{c} {r.doc_id}" for r in rows for c in NAMES), name
