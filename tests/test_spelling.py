"""The array kernel of Jaro against another engine, and candidate pairs against all pairs."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwarden.functions import spelling
from sparkwarden.operators import entities as E


def names(n, seed, letters="abcdeé ", longest=14):
    rng = random.Random(seed)
    return ["".join(rng.choices(letters, k=rng.randrange(longest))) for _ in range(n)]


def test_kernel():
    a, b = names(3000, 1) + ["", "", "x", "martha", "q" * 500], names(3000, 2) + ["", "x", "", "marhta", "q" * 499 + "r"]
    con = duckdb.connect()
    plain = [con.execute("SELECT jaro_similarity(?, ?)", [x, y]).fetchone()[0] if x.isascii() and y.isascii() else None for x, y in zip(a, b)]
    got = spelling.jaro_of(a, b)
    assert all(w is None or x == y or abs(g - w) < 1e-9 for g, w, x, y in zip(got, plain, a, b))
    assert all(g == 1 for g, x, y in zip(got, a, b) if x == y) and len(spelling.jaro_of([], [])) == 0
    wide = str.maketrans("abcdeé ", "αβγδε一二")  # other letters, the same pattern
    assert np.allclose(spelling.jaro_of([x.translate(wide) for x in a], [x.translate(wide) for x in b]), got)


@pytest.mark.parametrize("least", [0.7, 0.85, 0.95])
def test_candidates_hold_every_pair(spark, least):
    a, b = names(150, 3, longest=12) + ["a", "ab", "", None], names(150, 4, longest=12) + ["a", "b", "ba", "", None]
    frames = [spark.createDataFrame([(i % 2, x) for i, x in enumerate(n)] + [(None, "abc")], "k int, t string") for n in (a, b)]
    got = {(r.k, r.t, r.other) for r in E.similar_spellings(*frames, "k", "t", least).collect()}
    every = [(i % 2, x, y) for i, x in enumerate(a) for j, y in enumerate(b) if i % 2 == j % 2 and x and y]
    score = dict(zip(every, spelling.jaro_of([x for _, x, _ in every], [y for *_, y in every])))
    assert {p for p, s in score.items() if s >= least} <= got <= set(score)
    assert len(got) < len(score) * (0.7 if least < 0.8 else 0.25)
    best = E.fuzzy_best(*(f.withColumn("id", F.monotonically_increasing_id()) for f in frames), "k", "t", least).collect()
    want = {(k, x): max(s for (k2, x2, _), s in score.items() if (k2, x2) == (k, x)) for k, x, _ in score}
    assert {(r.k, r.t): round(r.score, 9) for r in best} == {p: round(s, 9) for p, s in want.items() if s >= least}


def test_search(spark):
    texts = ["small ring", "smal ring", "ring", "", None, "small rings", "other", "gnir llams"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    found = {r.t: r.score for r in E.spelled_like(df, "t", "small ring", 0.7).collect()}
    want = {x: s for x, s in zip(texts, spelling.jaro_of([x or "" for x in texts], ["small ring"] * len(texts))) if s >= 0.7}
    assert set(found) == set(want) and all(abs(found[x] - want[x]) < 1e-9 for x in want)
    assert E.similar_spellings(df.limit(0).withColumn("k", F.lit(1)), df.withColumn("k", F.lit(1)), "k", "t", 0.8).count() == 0
    with pytest.raises(ValueError):
        E.similar_spellings(df, df, "t", "t", 0.5)
