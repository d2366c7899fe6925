import numpy as np
from pyspark.sql import functions as F

from sparkwarden.llm.common import held_out
from sparkwarden.llm.language_id import CodeModel, codewords, identify, ngram_counts, train


def test_codewords_differ():
    for n in (1, 2, 4, 9):
        m = codewords(n)
        assert len({tuple(r) for r in m.tolist()}) == n
        assert all((r > 0).any() and (r < 0).any() for r in m.T.tolist() for r in [np.array(r)]) or n == 1


def test_counts_stay_within_a_text():
    one = np.frombuffer(b"abc", np.uint8)
    two = np.frombuffer(b"abcabc", np.uint8)
    a, b = ngram_counts(one, np.array([0, 3])), ngram_counts(two, np.array([0, 3, 3, 6]))
    assert np.allclose(b[0], a[0]) and np.allclose(b[2], a[0]) and not b[1].any()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", "en"), (-3, "12 34!", "en"), (None, "the and of", None)], "doc_id long, text string, lang string")
    every = docs.select("doc_id", "text", "lang").unionByName(odd)
    model = train(every, ~held_out(F.col("doc_id")))
    got = {r.doc_id: r for r in identify(every, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (-1, -2, -3))
    test = docs.where(held_out(F.col("doc_id"))).select("doc_id", "lang").collect()
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in test]) > 0.97
    assert train(every.limit(0), F.lit(True)) is None
    assert {r.lang_pred for r in identify(odd, None).collect()} == {"und"}


def test_any_number_of_languages(spark):
    """Each language has letters of its own; more languages than the sample has rows for two texts of each."""
    rows = [(10 * i + k, f"{chr(0x4E00 + i) * 3} {chr(0x4E00 + i) * 2} {k}", f"l{i}") for i in range(250) for k in range(3)]
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, lang string").withColumn("_draw", F.lit(1)).withColumn("_letters", F.lit(0))
    model = train(df, F.lit(True), per_language=2)
    assert len(model.languages) == 250
    got = identify(df, model).collect()
    want = {r[0]: r[2] for r in rows}
    assert len(got) == 755 and np.mean([r.lang_pred == want[r.doc_id] for r in got]) > 0.9
    assert len({(r.doc_id, r.lang_pred, r.score) for r in got}) == 750  # repeated rows get equal rows
    assert identify(df.limit(0), model).count() == 0


def test_primal_and_dual_agree():
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((12, 6)).astype(np.float32), np.arange(12) % 3
    primal, wide = CodeModel(["a", "b", "c"], x, y), CodeModel(["a", "b", "c"], np.hstack([x, np.zeros((12, 20), np.float32)]), y)
    assert np.allclose(primal.weights, wide.weights[:6], atol=1e-4) and np.allclose(primal.bit_weight, wide.bit_weight) and np.isclose(primal.scale, wide.scale)


def test_long_text(spark):
    df = spark.createDataFrame([(1, "the and of " * 200000, "en"), (2, "le la les des " * 50, "fr")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in identify(df, train(df, F.lit(True))).collect()}
    assert got == {1: "en", 2: "fr"}
