import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkwarden.llm import substring_dedup
from sparkwarden.llm.common import mix, shingles
from sparkwarden.llm.near_dedup import banded_lcs
from sparkwarden.llm.substring_dedup import cells, common_runs, compact_windows, passages_of, repeated_passages, run_width


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=40), st.integers(1, 8))
def test_windows_against_recursion(values, width):
    want = []

    def node(l, r):
        if r - l + 1 < width or l > r:
            return
        c = min(range(l, r + 1), key=lambda i: (values[i], i))
        want.append((l, c, r))
        node(l, c - 1)
        node(c + 1, r)

    node(0, len(values) - 1)
    l, c, r, of = compact_windows(np.array(values, np.uint64) << np.uint64(40), width)
    assert sorted(zip(l.tolist(), c.tolist(), r.tolist())) == sorted(want)
    assert [int(c[j]) for j in of] == [min(range(i, i + width), key=lambda x: (values[x], x)) for i in range(len(values) - width + 1)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 9), max_size=12), min_size=1, max_size=5), st.integers(1, 4))
def test_joined_texts_have_the_cells_of_each(texts, width):
    flat = np.array([x for t in texts for x in [*t, 0]], np.uint64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    key, l, r, start, till = cells(flat, range(2), width, ends - 1)
    want = []
    for t, end in zip(texts, ends.tolist()):
        at = end - 1 - len(t)
        k, a, b, s, e = cells(np.array(t, np.uint64), range(2), width)
        want += zip(k.tolist(), (a + at).tolist(), (b + at).tolist(), (s + at).tolist(), (e + at).tolist())
    assert list(zip(key.tolist(), l.tolist(), r.tolist(), start.tolist(), till.tolist())) == want


def test_equal_passages_share_signatures():
    rng = np.random.default_rng(1)
    for _ in range(50):
        p = rng.integers(0, 1 << 62, 50, dtype=np.uint64)
        a = np.concatenate([rng.integers(0, 1 << 62, rng.integers(0, 90), dtype=np.uint64), p])
        b = np.concatenate([p, rng.integers(0, 1 << 62, rng.integers(0, 90), dtype=np.uint64)])
        x, y = (set(cells(t, range(3), 46)[0].tolist()) for t in (a, b))
        assert x & y


def test_passages(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    shared, close, short, boiler = text(60), text(70), text(40), text(30)
    changed = list(close)
    changed[20] = word()
    rows = []
    for i in range(40):
        body = text(rng.randint(0, 150)) + boiler + text(80)
        if i in (3, 11, 30):
            body += shared + text(20)
        if i in (5, 6):
            body += (close if i == 5 else changed) + text(10)
        if i in (8, 9):
            body += short + text(9)
        rows.append((i, " ".join(body)))
    rows += [(100, " ".join(text(5))), (101, None), (102, ""), (None, rows[0][1]), (0, rows[0][1]), (103, rows[0][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, similarity int").repartition(4)
    got = repeated_passages(df).collect()
    pairs = {frozenset((r.doc_id, r.other_id)) for r in got}
    links = {i: i for i in (3, 11, 30, 5, 6, 0, None, 103)}

    def root(i):
        while links[i] != i:
            i = links[i]
        return i

    assert all(p <= {3, 11, 30} or p <= {5, 6} or p <= {0, None, 103} for p in pairs), pairs
    for p in pairs:
        a, b = tuple(p)
        links[root(a)] = root(b)
    assert root(3) == root(11) == root(30) and root(5) == root(6) and root(0) == root(None) == root(103)
    words = {i: t.split() for i, t in rows if t}
    for r in got:
        if {r.doc_id, r.other_id} <= {3, 11, 30}:
            assert words[r.doc_id][r.first_word : r.end_word] == shared == words[r.other_id][r.other_first_word : r.other_end_word]
    assert repeated_passages(df.limit(0)).count() == 0


def test_recall_of_passages_with_one_edit(spark):
    rng = random.Random(31)
    text = lambda n: [f"w{rng.getrandbits(40)}" for _ in range(n)]
    rows = []
    for i in range(150):
        a = text(50)
        b = list(a)
        b[rng.randint(5, 44)] = text(1)[0]  # 41 of 51 shingles in common
        rows += [(2 * i, " ".join(text(40) + a + text(40))), (2 * i + 1, " ".join(text(60) + b + text(20)))]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {min(r.doc_id, r.other_id) // 2 for r in got if r.doc_id // 2 == r.other_id // 2} == set(range(150))


def _good_windows(a, b, width, least=0.8):
    """Starts in a of the windows that some window of b resembles, by trying all pairs."""
    out, need = set(), 2 * width * least / (1 + least) - 1e-9
    for i in range(len(a) - width + 1):
        inside = np.append(0, np.cumsum(np.isin(b, a[i : i + width])))
        for j in np.flatnonzero(inside[width:] - inside[:-width] >= need).tolist():
            x, y = a[i : i + width].tolist(), b[j : j + width].tolist()
            if sum((Counter(x) & Counter(y)).values()) >= need and banded_lcs(x, y, width) >= need:
                out.add(i)
                break
    return out


def _hashed(words):
    return shingles(mix(np.array(words, np.uint64) + np.uint64(77)), 5)


def test_pairs_against_brute_force():
    rng, missed, total = random.Random(5), 0, 0
    for trial in range(60):
        passage, alphabet = (30, 50)[trial % 2], rng.choice([2, 5, 50, 10**6])
        word = lambda: rng.randrange(alphabet)  # noqa: B023, E731
        common = [word() for _ in range(rng.randint(passage, 2 * passage))]

        def copy():
            p = list(common)  # noqa: B023
            for _ in range(rng.randint(0, 2)):
                k, what = rng.randrange(len(p)), rng.random()
                p[k : k + (what < 0.7)] = [] if what < 0.3 else [rng.randrange(10**6)]
            return p

        a, b = (_hashed([word() for _ in range(rng.randint(0, 30))] + [x for _ in range(rng.randint(1, 2)) for x in [*copy(), *(word() for _ in range(rng.randint(0, 20)))]]) for _ in range(2))
        got = passages_of(a, b, passage)
        for x, y, p, q, s, n in got:
            assert n >= 1 and y - x >= passage and q - p >= passage and s >= 0.8 - 1e-9 and y <= len(a) + 4 and q <= len(b) + 4
        assert all(g[0] < h[0] and g[1] < h[1] for g, h in zip(got, got[1:]))
        spare = passage - 4 - run_width(passage, 0.8)[1]  # a passage ends with words in common, a window need not
        want = _good_windows(a, b, passage - 4)
        total += len(want)
        missed += sum(not any(x <= i + spare and i + passage - spare <= y for x, y, *_ in got) for i in want) if alphabet > 2 else 0
    assert total > 300 and missed <= 0.005 * total


def test_one_row_for_a_passage_and_for_text_in_circles():
    rng = np.random.default_rng(2)
    one, two = rng.integers(0, 1 << 62, 400), rng.integers(0, 1 << 62, 300)
    a, b = np.concatenate([two[:100], one]), np.concatenate([one, two[200:]])
    assert passages_of(_hashed(a), _hashed(b)) == [(100, 500, 0, 400, 1.0, 1)]
    (x, y, p, q, s, parts), = passages_of(_hashed([1] * 500), _hashed([1] * 60 + list(range(9, 80))))
    assert (x, y, p, q, s) == (0, 500, 0, 60, 1.0) and parts > 5
    assert passages_of(_hashed([1] * 500), _hashed([1] * 40 + list(range(9, 80)))) == []
    b[200] = 5  # one word changed
    (x, y, p, q, s, _), = passages_of(_hashed(a), _hashed(b))
    assert (x, y, p, q) == (100, 500, 0, 400) and s == 391 / 401


def test_every_place_of_a_passage_is_aligned():
    """A passage stands in the other text several times, in different wording: the middle ones are looked at too."""
    rng = np.random.default_rng(6)
    new = lambda n: rng.integers(0, 1 << 62, n).tolist()
    run, head, tail = new(25), new(40), new(40)
    a = new(30) + head + run + tail + new(30)
    places = [new(40) + run + new(40), head + run + new(40), new(40) + run + new(40), new(40) + run + tail, new(60) + run + new(20)]
    b = [w for p in places for w in [*new(17), *p]]
    got = passages_of(_hashed(a), _hashed(b))
    covered = {k for x, y, *_ in got for k in range(x, y)}
    assert set(range(30, 30 + 105)) <= covered
    starts = np.cumsum([0] + [17 + len(p) for p in places])
    assert {int(np.searchsorted(starts, p, "right")) - 1 for *_, p, _, _, _ in got} == {1, 3}


def test_a_passage_at_any_of_very_many_places():
    """A stretch of 25 words stands in both texts again and again; at one place in the middle a passage goes on behind it."""
    rng = np.random.default_rng(16)
    new = lambda n: rng.integers(0, 1 << 62, n).tolist()
    run, tail = new(25), new(24)
    a = [w for _ in range(99) for w in run + new(6)] + run + new(1) + tail + new(30)
    b = [w for k in range(200) for w in [*run, *(new(1) + tail if k == 150 else []), *new(6)]]
    (x, y, p, q, s, parts), = passages_of(_hashed(a), _hashed(b))
    assert (x, y, p, q, parts) == (99 * 31, 99 * 31 + 50, 150 * 31, 150 * 31 + 50, 1) and s >= 0.8 - 1e-9


def test_common_runs_are_all_there():
    rng = random.Random(17)
    for _ in range(60):
        alphabet = rng.choice([1, 2, 3, 50])
        part = [rng.randrange(alphabet) for _ in range(rng.randint(20, 60))]
        a, b = (_hashed([x for _ in range(rng.randint(1, 4)) for x in [*part, *(rng.randrange(alphabet) for _ in range(rng.randint(0, 9)))]]) for _ in range(2))
        want = {}
        for i in range(len(a)):
            for j in range(len(b)):
                if a[i] == b[j] and not (i and j and a[i - 1] == b[j - 1]):
                    n = 1
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                        n += 1
                    if n >= 21:
                        want[i, j] = n
        assert list(common_runs(a, b, 21)) == [(*k, n) for k, n in sorted(want.items())]


def test_rows_against_brute_force(spark):
    """Texts with lines that many share, copies in one text, near copies and circles: every window of 50 words that another
    text resembles lies in a reported passage."""
    rng = random.Random(8)
    word = lambda: f"w{rng.getrandbits(40)}"
    new = lambda n: [word() for _ in range(n)]
    lines, long, round_ = [new(n) for n in (26, 30, 40)], [new(n) for n in (55, 90, 140)], [["la"], new(6)]
    rows = []
    for _ in range(20):
        t = new(rng.randint(0, 20))
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            p = list(rng.choice(lines if kind < 0.5 else long) if kind < 0.85 else rng.choice(round_) * rng.randint(10, 60))
            if rng.random() < 0.4 and kind < 0.85:
                p[rng.randrange(len(p))] = word()
            t += p + new(rng.choice([0, 3, 12, 30]))
        rows.append(t)
    # The leader of the line has it alone; others share a passage around the line, parted by an edit beside it.
    for _ in range(6):
        tail = new(19)
        rows += [lines[1] + new(1) + tail + new(20), lines[1] + new(1) + tail + new(25)]
    got = repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string").repartition(4)).collect()
    spans, flat = {}, {}
    for r in got:
        assert r.end_word - r.first_word >= 50 and r.other_end_word - r.other_first_word >= 50 and r.similarity >= 0.8 - 1e-9 and r.doc_id != r.other_id
        spans.setdefault(r.doc_id, []).append((r.first_word, r.end_word))
        spans.setdefault(r.other_id, []).append((r.other_first_word, r.other_end_word))
    codes: dict[str, int] = {}
    flat = [_hashed([codes.setdefault(w, len(codes)) for w in t]) if len(t) > 4 else np.zeros(0, np.uint64) for t in rows]
    missed = total = 0
    for i, a in enumerate(flat):
        want = set().union(*(_good_windows(a, b, 46) for j, b in enumerate(flat) if j != i))
        total += len(want)
        missed += sum(not any(x <= k + 5 and k + 45 <= y for x, y in spans.get(i, ())) for k in want)
    assert total > 300 and missed <= 0.005 * total
    assert {i for i in range(20, 32)} <= set(spans)


def test_repeats_with_nothing_beside_them_are_not_looked_around(monkeypatch):
    """m x n places of a repeated line were each aligned on both sides, though no other token is shared."""
    rng = np.random.default_rng(7)
    line = rng.integers(1, 1 << 62, 50).astype(np.uint64)
    a, b = (np.concatenate([np.concatenate([line, rng.integers(1, 1 << 62, 80).astype(np.uint64)]) for _ in range(n)]) for n in (20, 30))
    calls = []
    monkeypatch.setattr(substring_dedup, "_beside", lambda *x, real=substring_dedup._beside: calls.append(1) or real(*x))
    found = substring_dedup.passages_of(a, b)
    assert [(x[0], x[1], x[2], x[3], x[4]) for x in found] == [(130 * i, 130 * i + 54, 0, 54, 1.0) for i in range(20)]
    assert len(calls) < 100


def test_quick_test_of_what_stands_beside_changes_nothing():
    rng = np.random.default_rng(8)
    for _ in range(60):
        lines = [rng.integers(1, 1 << 62, int(rng.integers(20, 60))).astype(np.uint64) for _ in range(4)]
        a, b = (np.concatenate([np.concatenate([lines[rng.integers(4)], rng.integers(1, 60, int(rng.integers(0, 12))).astype(np.uint64)]) for _ in range(int(rng.integers(2, 9)))]) for _ in range(2))
        shared = substring_dedup._shared(a, b)
        for chain in substring_dedup._chains(substring_dedup.common_runs(a, b, 21), 46):
            assert substring_dedup._passages(chain, a, b, 46, 0.8, shared) == substring_dedup._passages(chain, a, b, 46, 0.8)


def test_lines_that_stand_again_and_again_are_looked_at_together(monkeypatch):
    """Runs in no chain went through _chains() and _passages() one by one, and so did chains in circles that lie in a passage
    found before: m x n of them."""
    rng = np.random.default_rng(9)
    new = lambda n: rng.integers(1, 1 << 62, n).astype(np.uint64)
    line, ring, beside = new(30), new(30), new(4)
    a = np.concatenate([x for _ in range(20) for x in (line, new(80))] + [new(80), *[ring] * 12])
    b = np.concatenate([x for _ in range(30) for x in (line, beside, new(80))] + [new(80), *[ring] * 12])
    calls = []
    monkeypatch.setattr(substring_dedup, "_passages", lambda *x, real=substring_dedup._passages: calls.append(1) or real(*x))
    assert [(x, y, p, q, s) for x, y, p, q, s, _ in passages_of(a, b)] == [(2280, 2644, 3500, 3864, 1.0)]
    assert len(calls) < 100


def test_runs_in_no_chain_are_found_as_one_by_one(monkeypatch):
    rng = np.random.default_rng(10)
    for _ in range(80):
        lines = [rng.integers(1, 1 << 62, int(rng.integers(20, 60))).astype(np.uint64) for _ in range(4)]
        a, b = (np.concatenate([np.concatenate([lines[rng.integers(4)], rng.integers(1, 60, int(rng.integers(0, 120))).astype(np.uint64)]) for _ in range(int(rng.integers(2, 14)))]) for _ in range(2))
        monkeypatch.setattr(substring_dedup, "MANY", 5)
        got = passages_of(a, b)
        monkeypatch.setattr(substring_dedup, "PAIRS", 8)  # runs near another block are not taken for alone
        assert [x[:5] for x in passages_of(a, b)] == [x[:5] for x in got]
        monkeypatch.setattr(substring_dedup, "MANY", 1 << 30)
        monkeypatch.setattr(substring_dedup._Cover, "holds", lambda *x: False)
        assert passages_of(a, b) == got
        monkeypatch.undo()
