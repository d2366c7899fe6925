import random

from sparkwarden.operators import mentions as m


def plain(words, titles):
    found = [(i, i + len(t), n) for n, t in titles for i in range(len(words)) if t and words[i : i + len(t)] == t]
    found = {(a, b): min(n for x, y, n in found if (x, y) == (a, b)) for a, b, _ in found}
    return sorted((a, b, n) for (a, b), n in found.items() if not any(x <= a and b <= y and (x, y) != (a, b) for x, y in found))


def test_against_all_places(spark):
    rng = random.Random(5)
    words = ["work", "at", "height", "Health", "and", "safety", "act", "x"]
    titles = [(i, " ".join(rng.choices(words, k=rng.randint(1, 4)))) for i in range(40)] + [(99, None), (98, "--"), (97, "Safety, ACT")]
    texts = [(i, ", ".join(rng.choices([*words, "other"], k=rng.randrange(40)))) for i in range(60)] + [(100, None), (101, ""), (102, "nothing here")]
    want = sorted((i, *r) for i, t in texts for r in plain(m.words_of(t), [(n, m.words_of(t)) for n, t in titles]))
    t, k = spark.createDataFrame(texts, "doc long, body string"), spark.createDataFrame(titles, "law long, title string")
    for block in (m.BLOCK_CHARACTERS, 200):
        got = m.mentions(t.repartition(3), k, "body", "title", "doc", "law", block).collect()
        assert sorted((r.doc, r.first_word, r.end_word, r.law) for r in got) == want
        by = {}
        for r in sorted(got, key=lambda r: (r.doc, r.place)):
            by.setdefault(r.doc, []).append((r.place, r.first_word))
        assert all([p for p, _ in v] == list(range(1, len(v) + 1)) and v == sorted(v) for v in by.values())
    assert m.mentions(t.limit(0), k, "body", "title", "doc", "law").count() == 0 == m.mentions(t, k.limit(0), "body", "title", "doc", "law").count()
