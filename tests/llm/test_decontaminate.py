import random

from pyspark.sql import Row

from sparkwarden.llm.decontaminate import SuffixAutomaton, find, without


def brute(words, items, window):
    hit, found = set(), set()
    for name, item in items:
        m = min(window, len(item))
        for i in range(len(item) - m + 1) if item else ():
            for j in range(len(words) - m + 1):
                if words[j : j + m] == item[i : i + m]:
                    hit |= set(range(j, j + m))
                    found.add(name)
    return hit, found


def test_automaton_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        letters = "ab" if rng.random() < 0.5 else "abcdef"
        items = [(str(k), [rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 14]))]) for k in range(rng.randint(0, 5))]
        words = [rng.choice(letters + "x") for _ in range(rng.randint(0, 40))]
        for window in (2, 4):
            a = SuffixAutomaton(window)
            for name, item in items:
                a.add(name, " ".join(item).encode())
            spans, found = a.finish().match([w.encode() for w in words])
            assert (({i for x, y in spans for i in range(x, y)}), found) == brute(words, items, window)


def test_find_cases(spark):
    docs = spark.createDataFrame([(1, "x One, two three! y", 9), (2, None, 9), (3, "", 9), (1, "x One, two three! y", 9), (None, "alpha beta gamma delta é", 9)], "doc_id long, text string, spans int").repartition(3)
    bench = spark.createDataFrame([("b", "one TWO three"), ("a", "one two three"), ("c", None), ("d", "..."), ("e", "beta gamma delta É epsilon"), (None, "alpha beta gamma")], "item_id string, text string")
    for block in (10**6, 3):
        got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, tuple(r["items"])) for r in find(docs, bench, window=3, block_words=block).collect())
        assert got == [("1", 5, 3, 2, ("a", "b")), ("1", 5, 3, 2, ("a", "b")), ("2", 0, 0, 0, ()), ("3", 0, 0, 0, ()), ("None", 5, 4, 1, ("e",))]
    assert find(docs.limit(0), bench).count() == 0
    assert find(docs, bench.limit(0)).agg({"n_hit": "sum"}).collect() == [Row(**{"sum(n_hit)": 0})]


def test_without():
    assert without("x One, two three! y", [(1, 4)]) == "x ! y"
    assert without(None, []) is None
