import hashlib

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages_on_a_small_corpus(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    kept, now = [docs], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).cache()
        assert now.columns == docs.columns and now.dtypes == docs.dtypes
        kept.append(now)
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in kept]
    assert all(a > b for a, b in zip(ids, ids[1:]))
    # quality: what goes is labelled 0 where a label is known
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{tmp_path}/labels.parquet").collect()}
    gone = [quality[i] for i in ids[0] - ids[1] if i in quality]
    stayed = [quality[i] for i in ids[1] if i in quality]
    assert sum(gone) <= 0.05 * len(gone) and sum(q == 0 for q in stayed) <= 0.05 * len(stayed)
    # exact: one row of each text without white space, the longest
    best = {}
    for r in kept[1].collect():
        key = "".join(c for c in r.text if c not in "\t\n\x0b\x0c\r ")
        if key not in best or (len(r.text), -r.doc_id) > (len(best[key].text), -best[key].doc_id):
            best[key] = r
    assert ids[2] == {r.doc_id for r in best.values()}
    # tokens: every kept document, decoded to its own bytes
    out = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    want = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in now.collect()}
    assert {r.doc_id: r.decoded_sha256 for r in out} == want
    whole = corpus_pipeline.run(spark, str(tmp_path)).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).first()
    assert (whole.n, whole.t) == (len(out), sum(r.n_tokens for r in out))
