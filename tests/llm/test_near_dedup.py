import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkwarden.llm import near_dedup
from sparkwarden.llm.common import shingles, word_hashes
from sparkwarden.llm.graph import components
from sparkwarden.llm.near_dedup import aligned, labelled, near_duplicates


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=40), st.data())
def test_alignment_against_full_table(a, data):
    b = list(a)
    for _ in range(data.draw(st.integers(0, 4))):
        i = data.draw(st.integers(0, len(b) - 1))
        b[i : i + 1] = data.draw(st.lists(st.integers(0, 6), max_size=2))
        b = b or [0]
    common = lcs(a, b)
    truth = common / (len(a) + len(b) - common)
    got = aligned(np.array(a, np.uint64), np.array(b, np.uint64), 0.8)
    assert abs(got - (truth if truth >= 0.8 - 1e-12 else 0)) < 1e-12


def test_occurrences():
    x = np.array([5, 7, 5, 5, 7], np.uint64)
    assert len(set(labelled(x).tolist())) == 5


def kmers(text):
    raw = text.encode()
    return shingles(word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0], 5)


def test_classes_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for group in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 30, 120, 300]))]
        for _ in range(rng.choice([1, 2, 6, 12])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, "..."), (None, rows[0][1].upper() + " !"), (0, rows[0][1])]
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, _id long").repartition(5)
    got = near_duplicates(df).collect()
    assert len(got) == len(rows)
    keyed = [(i, kmers(t)) for i, t in rows if i is not None and t and t != "..."]
    parent = {i: i for i, _ in keyed}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(keyed):
        for j, b in keyed[:x]:
            if len(a) and len(b) and aligned(a, b, 0.8):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    mine = {r.doc_id: r.class_id for r in got}
    assert {i: mine[i] for i in parent} == {i: root(i) for i in parent}
    assert [mine[i] for i in (1000, 1001, 1002)] == [1000, 1001, 1002]
    assert mine[None] == mine[0]
    assert near_duplicates(df.limit(0)).count() == 0


def test_repeat_keeps_the_labels_of_first_occurrences():
    x = np.arange(1, 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert set(labelled(x).tolist()) <= set(labelled(np.append(x, x[:2])).tolist())


def test_close_texts_inside_a_large_looser_family(spark):
    rng = random.Random(12)
    n, template = 200, [f"t{i}" for i in range(200)]

    def changed(places):
        words = list(template)
        for i in places:
            words[i] = f"x{rng.getrandbits(60)}"
        return words

    # A change spoils five k-mers: 5 leave two texts at about 0.63, 2 at about 0.82.
    every = range(5, n - 5, 5)
    loose = [changed(rng.sample(every, 5)) for _ in range(1500)]
    close = [changed(rng.sample(every, 2)) for _ in range(12)]
    rows = [(i, " ".join(w)) for i, w in enumerate(loose + close)]
    sequences = [kmers(t) for _, t in rows[1500:]]
    assert all(aligned(a, b, 0.8) for i, a in enumerate(sequences) for b in sequences[:i])
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert len({got[i] for i in range(1500, 1512)}) == 1


def test_rounds_of_the_exact_comparison(spark, monkeypatch):
    """Texts that no link has joined yet: the exact comparison finds every class, in few rounds, and changes labels a text a
    row (twice as many leaders a round and a join of all k-mers made the driver's memory and the rows grow)."""
    rng = random.Random(14)
    template = [f"t{i}" for i in range(200)]

    def changed(words, n):
        words = list(words)
        for i in rng.sample(range(5, 195, 5), n):
            words[i] = f"x{rng.getrandbits(60)}"
        return words

    seeds = [changed(template, 8) for _ in range(40)]
    texts = [" ".join(changed(seeds[i % 40], 1)) for i in range(120)]
    rows = [(bytes([i]), t, bytes([i])) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "_words binary, _text string, _label binary")
    tables = []
    monkeypatch.setattr(near_dedup, "save", lambda x, name, real=near_dedup.save: tables.append(name) or real(x, name))
    links = near_dedup.exact_links(df, spark.createDataFrame([], "a binary, b binary, similarity double"), 0.8)
    joined = components(links.select("a", "b")).collect()
    label = {r.node[0]: r.label[0] for r in joined}
    assert label == {i: i % 40 for i in range(120)}
    assert {r.node: r.label for r in components(links.selectExpr("_a as a", "_b as b")).collect()} == {r.node: r.label for r in joined}
    assert tables.count("leaders") <= 5


def test_rows_of_kmers_without_a_near_enough_text_leave(spark, monkeypatch):
    """k-mers that texts share only where too few are left of either: their rows were carried from round to round."""
    rng = random.Random(15)
    template = [f"t{i}" for i in range(200)]

    def changed(words, n):
        words = list(words)
        for i in rng.sample(range(5, 195, 5), n):
            words[i] = f"x{rng.getrandbits(60)}"
        return words

    seeds = [changed(template, 8) for _ in range(60)]
    rows = [(bytes([i]), " ".join(changed(seeds[i % 60], 1)), bytes([i])) for i in range(120)]
    df = spark.createDataFrame(rows, "_words binary, _text string, _label binary")
    tables = []

    def kept(x, name, real=near_dedup.save):
        tables.append((name, real(x, name)))
        return tables[-1][1]

    monkeypatch.setattr(near_dedup, "save", kept)
    links = near_dedup.exact_links(df, spark.createDataFrame([], "a binary, b binary, similarity double"), 0.8)
    assert {r.node[0]: r.label[0] for r in components(links.select("a", "b")).collect()} == {i: i % 60 for i in range(120)}
    held = [x.count() for name, x in tables if name == "rare-kmers"]
    assert held[1] < held[0] / 2


def test_apart_keeps_each_row_that_may_meet(spark):
    rng = random.Random(16)
    rows = []
    for i in range(3000):
        n = rng.randint(5, 30)
        rows.append((rng.randrange(400), i, rng.randrange(4), n, rng.randint(int(0.8 * n), n)))
    df = spark.createDataFrame(rows, "_kmer bigint, _words bigint, _label bigint, _n int, _left int")
    may = lambda x, y: x[0] == y[0] and x[2] != y[2] and min(x[4], y[4]) * 1.8 >= 0.8 * (x[3] + y[3]) - 1e-6
    wanted = {x[1] for x in rows for y in rows if may(x, y)}
    got = {r._words for r in near_dedup._apart(df, 0.8).collect()}
    assert wanted <= got and len(got) < 0.9 * len(rows)
