"""Counts and the base score against plain loops; seating against enumeration; probabilities that sum to one."""

import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkwarden.llm import language_model as m

END = object()


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", low), END]


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    follow = {w: rng.sample(range(60), 3) for w in range(60)}
    out = []
    for _ in range(n):
        w, text = rng.randrange(60), []
        for _ in range(rng.randrange(30)):
            text.append(rng.choice(["w", "W"]) + str(w))
            w = rng.choice(follow[w])
        out.append(" ".join(text))
    return [*out, None, "", " \n", "new words only", "x " * 3000, out[0], out[0]]


def used(_id):
    return F.crc32(_id.cast("string")) % 7 != 2


@pytest.mark.parametrize("part_tokens,chunk_bytes", [(4_000_000, 24 << 20), (700, 2000)])
def test_counts_and_base(spark, monkeypatch, part_tokens, chunk_bytes):
    monkeypatch.setattr(m, "PART_TOKENS", part_tokens)
    texts = corpus()
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(None, "w1 w2", "s")], "doc_id long, text string, score string").repartition(3)
    df.write.parquet(path := m.save(df, "texts").inputFiles()[0].rpartition("/")[0] + "-again")
    df = spark.read.parquet(path)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "w1 w2")]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    got = m.score(df, used(F.col("_id"))).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        w, r = words(t), by[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert r.score < 0 and r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))
    outside = [r for r in got if r.held_out]
    assert sum(r.score for r in outside) > 0.75 * sum(r.base_score for r in outside)
    assert sorted(map(str, m.score(df, used(F.col("_id"))).collect())) == sorted(map(str, got))
    assert m.score(df.limit(0), used(F.col("_id"))).count() == 0
    assert {round(r.score, 9) for r in m.score(df.where("doc_id < 3"), F.lit(False)).collect()} == {0.0}


def test_probabilities_sum_to_one(spark, monkeypatch):
    """Over every word (and an unknown one) behind a context, from the scores of texts that differ in that word only."""
    texts = corpus(150)
    every = sorted({w for t in texts for w in words(t) if w is not END})
    for part_tokens in (4_000_000, 300):
        monkeypatch.setattr(m, "PART_TOKENS", part_tokens)
        trial = [(10_000 + i, f"w7 {w}") for i, w in enumerate([*every, "unknown"])] + [(20_000, "w7")]
        df = m.save(spark.createDataFrame([*enumerate(texts), *trial], "doc_id long, text string"), "texts")
        n, hot = m._deal(docs := df.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), (F.col("doc_id") < 10_000).alias("_usable")))
        assert bool(hot) == (part_tokens == 300)
        parts = m.save(m._parts(m._packed(docs, n, hot)), "parts")
        known, world = m.learn(parts, n)
        total = 0.0
        wanted = {int(x) for x in m.tokens(np.frombuffer(" ".join(every).encode(), np.uint8), np.array([0, len(" ".join(every))]))[0]}
        r7 = int(m.tokens(np.frombuffer(b"w7 x", np.uint8), np.array([0, 4]))[1][1])
        unknown = int(m.tokens(np.frombuffer(b"unknown", np.uint8), np.array([0, 7]))[0][0])
        seen = set()
        for row in parts.where("_part >= 0").collect():
            part = m.Part.of_row(row.asDict())
            p, _ = m._probabilities(part, known, world)
            for k in np.flatnonzero(part.rest == r7):
                w = int(part.words[part.of[k]])
                assert w in wanted or w == unknown
                seen.add(w)
                total += p[k]
        assert seen == wanted | {unknown}
        assert total == pytest.approx(1, abs=1e-6)


def test_seating_is_the_exact_conditional():
    d, theta, others, p, c = 0.6, 1.5, 4, 0.07, 5
    weight = Counter()
    for way in itertools.product(range(c), repeat=c):  # tables of the customers in order of first use
        if all(x <= max(way[:i], default=-1) + 1 for i, x in enumerate(way)):
            sizes, w = Counter(), 1.0
            for x in way:
                w *= (sizes[x] - d) if sizes[x] else (theta + d * (others + len(sizes))) * p
                sizes[x] += 1
            weight[len(sizes)] += w
    n = 200_000
    t = m.seat(np.full(n, c), np.full(n, others), np.full(n, p), d, theta, np.random.default_rng(1), m.stirling(d))
    share = np.bincount(t, minlength=c + 1)[1:] / n
    want = np.array([weight[k] for k in range(1, c + 1)]) / sum(weight.values())
    assert np.abs(share - want).max() < 0.005
    many = m.seat(np.full(500, 5000), np.full(500, others), np.full(500, p), d, theta, np.random.default_rng(1), m.stirling(d))
    assert 1 <= many.min() and many.max() < 500 and m.seat(np.array([0, 1]), np.zeros(2), np.ones(2), d, theta, np.random.default_rng(1), m.stirling(d)).tolist() == [0, 1]


def test_memory_of_a_chunk():
    """What a task holds of its texts at once (without the texts themselves), however many they are."""
    rng = np.random.default_rng(3)
    texts = pa.array([" ".join(map(str, rng.integers(0, 50_000, 400).tolist())) for _ in range(8000)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(8000)), texts, pa.array(np.ones(8000, bool))], names=["_id", "_text", "_usable"])
    tracemalloc.start()
    try:
        tokens = sum(len(c[2]) for c in m._chunks(iter([batch]), 2))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert tokens == 8000 * 401 and most < 65e6
