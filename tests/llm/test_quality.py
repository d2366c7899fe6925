import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwarden.llm.common import held_out
from sparkwarden.llm.quality import FEATURES, PASSAGE, AttentionModel, passages, score, train


def test_passages_cover_whole_texts():
    texts = [b"", b"one two", b"w " * (3 * PASSAGE), b"   "]
    data = np.frombuffer(b"".join(texts), np.uint8)
    x, bounds = passages(data, np.cumsum([0, *map(len, texts)]))
    assert bounds.tolist() == [0, 1, 2, 5, 6] and x.shape == (6, FEATURES) and not x[0].any() and not x[5].any()
    alone, _ = passages(np.frombuffer(texts[2], np.uint8), np.array([0, len(texts[2])]))
    assert np.allclose(alone, x[2:5])


def test_gradients():
    rng = np.random.default_rng(0)
    x, cut = rng.standard_normal((12, 6)).astype(np.float64), np.array([0, 5, 6, 12])
    y, w = np.array([1.0, 0, 1]), np.ones(3)
    m = AttentionModel(0.5).fit(x.astype(np.float32), cut, y, w, hidden=4, gate=3, epochs=1)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    loss = lambda: -np.mean([np.log(o if t else 1 - o) for o, t in zip(m._forward(x, cut)[-1], y)])
    for k, g in m._gradients(x, cut, y, w).items():
        i = tuple(0 for _ in m.p[k].shape)
        keep, h = m.p[k][i], 1e-5
        m.p[k][i] = keep + h
        up = loss()
        m.p[k][i] = keep - h
        down = loss()
        m.p[k][i] = keep
        assert g[i] == pytest.approx((up - down) / (2 * h), rel=1e-2, abs=1e-5)


def test_held_out_accuracy_and_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = train(docs, labels, ~held_out(F.col("_id")), per_label=300)
    got = score(docs, model, keep=["doc_id"]).join(labels, "doc_id").where(held_out(F.col("doc_id"))).select("score", "quality").collect()
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in got]) > 0.95
    odd = spark.createDataFrame([(None, None, 1.0), (1, "", 2.0), (1, "", 2.0), (2, "x" * 100000, None)], "doc_id long, text string, score double")
    out = score(odd.select("doc_id", "text"), model).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    nothing = train(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in score(odd, nothing, keep=["doc_id"]).collect()} == {0.5}
