"""Operator 2: repeated passages by compact windows.

Tokens are five-word shingles.  For one hash function, the Cartesian tree over a text's token hashes gives its compact
windows (l, c, r): every subsequence within l..r that holds c and is long enough has its minimum at c.  Only tokens that
are the minimum of some shortest subsequence head such a window, so sliding minima find them without building the whole
tree.  Interval-joining the windows of several hash functions in a text gives cells, whose subsequences agree in all
those minima: their joint value is the cell's signature.

The shortest subsequence is a run, not a passage.  Two passages of `PASSAGE` words with a similarity of 0.8 lack five of
46 shingles at most, room for one inner edit, so they have 21 shingles (25 words) in a row in common; longer passages have
longer runs.  Equal runs have equal minima, hence equal signatures: no candidate depends on chance.

Texts that share a signature meet; each is compared with the signature's leader (the least text), not with all others.
Comparison aligns the two shingle sequences from their common runs: a passage is a maximal chain of window pairs of
`PASSAGE` words, each of similarity 0.8 or more, where similarity = aligned / (length + length - aligned) in shingles.  A
signature's place is settled where one passage covers all runs of its cell.  The places that are not, with the windows
around them that no passage covers, meet again under their six rarest shingles: windows of 0.8 share one of them (prefix
filter), and what many texts say alike is never rare.  There a group elects leaders again and again, twice as many each
time, until each member has a passage at the place or has been compared with all others, so nothing is lost to a leader that has the run without the
passage.

Defined cases: a null text and texts of fewer words than a passage have none; repeats inside one text are not reported;
equal texts are compared once, and each but the one with the least id has a row for its whole text; ids may be null (the
largest) or repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.llm.common import bucket_counts, join_unique, mix, save, save_by_key, shingles, slices, window_hashes, word_hashes

K, PASSAGE, SIMILARITY = 5, 50, 0.8
#: Hash functions in a signature.
FUNCTIONS = 2
#: Common runs (and passages found) of two texts that are held at once.
PAIRS = 1 << 18
#: Runs of two texts that are looked at together, not one by one.
MANY = 5
#: How far places may shift between a run and what is aligned beside it.
SHIFT = 3
#: Bits of a shingle by which its occurrences are counted (the counts only order the shingles).
_COUNT_BITS = 20
_RNG = np.random.default_rng(20240502)  # its own: draws must not depend on what else a worker has imported
_XOR = _RNG.integers(0, 1 << 63, 16, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0xD6E8FEB86659FD93)


def run_width(passage: int, least: float) -> tuple[int, int, int]:
    """(shingles of a passage, how many of them two such passages share at least, how many of those stand in a row)."""
    width = passage - K + 1
    enough = int(np.ceil(2 * width * least / (1 + least) - 1e-9))
    return width, enough, -(-enough // ((width - enough) // (K - 1) + 1))  # an inner edit costs K - 1 shingles at least


def compact_windows(values: np.ndarray, width: int, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all nodes of the Cartesian trees over values that span width places or more, ordered by c, and the
    number of the node that each subsequence of width places belongs to (-1: none); of equal values the leftmost is the
    smaller.  breaks: places between texts, which are in no window (each text has a tree of its own).
    """
    n = len(values)
    if n < width:
        return (np.zeros(0, np.int64),) * 4
    bits = np.uint64(max(1, (n - 1).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    m = (values & ~low) | np.arange(n, dtype=np.uint64)
    if breaks is not None:
        m |= low + np.uint64(1)  # a break is smaller than every token
        m[breaks] &= low
    packed, span = m, 1
    while 2 * span <= width:
        m, span = np.minimum(m[:-span], m[span:]), 2 * span
    if span < width:
        m = np.minimum(m[: n - width + 1], m[width - span :])
    least = (m & low).astype(np.int64)
    c = np.unique(least[np.append(True, least[1:] != least[:-1])])
    # Nearest smaller values among the heads: a node's ancestors span more than it does, so they are heads too.
    v, left, right, stack = packed[c].tolist(), [0] * len(c), [n - 1] * len(c), []
    at = c.tolist()
    for i, x in enumerate(v):
        while stack and v[stack[-1]] > x:
            right[stack.pop()] = at[i] - 1
        left[i] = at[stack[-1]] + 1 if stack else 0
        stack.append(i)
    number = np.zeros(n, np.int64)
    number[c] = np.arange(len(c))
    if breaks is not None:
        number[breaks] = -1
    return np.array(left, np.int64), c, np.array(right, np.int64), number[least]


def cells(tokens: np.ndarray, functions: range, width: int, breaks: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(signature, l, r, start, end): the joint windows of several hash functions, from the shortest subsequences they hold.

    A subsequence of width places that starts at i lies in one compact window of each function; where any of these
    changes along i, another cell begins; a cell has those that start at start to end - 1.
    """
    n = len(tokens)
    if n < width:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 4
    starts = n - width + 1
    signature = np.full(starts, len(functions), np.uint64)
    left, right, inside = np.zeros(starts, np.int64), np.full(starts, n - 1, np.int64), np.ones(starts, bool)
    for k in functions:
        l, c, r, of = compact_windows((tokens ^ _XOR[k]) * _ODD[k], width, breaks)
        signature = mix(signature * _P + tokens[c[of]] + _ODD[k])
        left, right, inside = np.maximum(left, l[of]), np.minimum(right, r[of]), inside & (of >= 0)
    new = np.flatnonzero(np.append(True, (signature[1:] != signature[:-1]) | (left[1:] != left[:-1]) | (inside[1:] != inside[:-1])))
    end = np.append(new[1:], starts)[inside[new]]
    new = new[inside[new]]
    return signature[new], left[new], right[new], new, end


def joined_shingles(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several texts in a row, one place for each word, and the places that begin none (the last of each text)."""
    tokens = np.append(shingles(hashes, K), np.zeros(K - 1, np.uint64))
    return tokens, np.unique(np.maximum(first[1:, None] - np.arange(1, K), np.repeat(first[:-1, None], K - 1, 1))[np.diff(first) > 0])


def signed_cells(df: DataFrame, functions: int, passage: int, run: int) -> DataFrame:
    """df: (_u, _text).  (_u, _key, _at, _till): the cells of each text that can hold a passage; its runs begin at words
    _at to _till.  Cells of one signature in a row are one.  A row with a null _key has the number of words as _at."""

    def work(batches):
        for rows, data, offsets in slices(batches):
            hashes, _, _, first = word_hashes(data, offsets)
            size = np.diff(first)
            if not len(size) or size.max() < passage:
                continue
            u = rows.column(rows.schema.get_field_index("_u")).to_numpy(zero_copy_only=False)
            tokens, breaks = joined_shingles(hashes, first)
            key, _, _, start, end = cells(tokens, range(functions), run, breaks)
            owner = np.searchsorted(first, start, "right") - 1
            long = size[owner] >= passage
            key, start, end, owner = key[long], start[long], end[long], owner[long]
            head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (start[1:] != end[:-1]) | (owner[1:] != owner[:-1])))
            end = end[np.append(head[1:] - 1, len(end) - 1)]
            key, start, owner = key[head], start[head], owner[head]
            whole = np.flatnonzero(size >= passage)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(u[np.concatenate([owner, whole])], pa.int64()),
                    pa.array(np.concatenate([key.view(np.int64), np.zeros(len(whole), np.int64)]), pa.int64(), mask=np.arange(len(key) + len(whole)) >= len(key)),
                    pa.array(np.concatenate([start - first[owner], size[whole]]), pa.int32()),
                    pa.array(np.concatenate([end - 1 - first[owner], size[whole]]), pa.int32()),
                ],
                names=["_u", "_key", "_at", "_till"],
            )

    return df.mapInArrow(work, "_u bigint, _key bigint, _at int, _till int")


# ---------------------------------------------------------------- comparing two texts


class _Text:
    """A text's shingles with what is looked up in them, made when first needed: leaders are compared with many texts."""

    def __init__(self, tokens: np.ndarray, width: int):
        self.tokens, self.width = tokens, width

    @functools.cached_property
    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """The values of the tokens, and which each place has."""
        return np.unique(self.tokens, return_inverse=True)

    @functools.cached_property
    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
        """Hashes of width tokens, their order, in order, and whether any repeats."""
        hashes = window_hashes(self.tokens, self.width)
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        return hashes, order, ranked, bool((ranked[1:] == ranked[:-1]).any())

    @functools.cached_property
    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The values of windows; those with another behind them; all places by window and what stands before; these as numbers."""
        other, _, ranked, _ = self.windows
        value = ranked[np.append(True, ranked[1:] != ranked[:-1])]
        rank = np.searchsorted(value, other)
        behind = np.zeros(len(value), bool)
        behind[rank[:-1]] = True
        before = value[behind]
        prior = np.append(len(before), (np.cumsum(behind) - 1)[rank[:-1]])  # nothing stands before the first place; it differs from all
        order = np.lexsort((prior, rank))
        return value, before, order, (rank * (len(before) + 1) + prior)[order]

    @functools.cached_property
    def levels(self) -> list[np.ndarray]:
        """levels[k] hashes 2 ** k windows; grown by _lengths()."""
        return [self.windows[0]]


def _begun(mine: np.ndarray, other: _Text) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) with mine[i] == other's window j that no equal pair precedes, ordered by both, in chunks of about PAIRS.

    The places of a value are ordered by what stands before them, so those that go on with an earlier pair are one stretch
    and are stepped over unseen: the work grows with the pairs that begin, however often a text goes round in circles."""
    value, before, order, key = other.places
    wide = len(before) + 1
    spot = np.minimum(np.searchsorted(value, mine), len(value) - 1)
    at = np.flatnonzero(value[spot] == mine)
    spot = spot[at]
    first, last = np.searchsorted(key, spot * wide), np.searchsorted(key, (spot + 1) * wide)
    skip, upto = first.copy(), first.copy()
    if len(before):
        ahead = mine[np.maximum(at - 1, 0)]
        p = np.minimum(np.searchsorted(before, ahead), len(before) - 1)
        same = (at > 0) & (before[p] == ahead)
        skip[same], upto[same] = (np.searchsorted(key, (spot * wide + p)[same], side) for side in ("left", "right"))
    head, size = skip - first, last - first - (upto - skip)
    total, s = np.append(0, np.cumsum(size)), 0
    while s < len(at):
        e = max(s + 1, int(np.searchsorted(total, total[s] + PAIRS, "right")) - 1)
        n = size[s:e]
        k = np.arange(int(n.sum())) - np.repeat(total[s:e] - total[s], n)
        place = np.repeat(first[s:e], n) + k + np.where(k < np.repeat(head[s:e], n), 0, np.repeat((upto - skip)[s:e], n))
        i, j = np.repeat(at[s:e], n), order[place]
        by = np.lexsort((j, i))
        yield i[by], j[by]
        s = e


def _lengths(one: list[np.ndarray], two: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How far each pair of places goes on alike.  Level k of a text hashes 2 ** k places; grown as far as pairs need."""
    k, left = 0, np.arange(len(i))
    while True:
        x, y = one[k], two[k]
        left = left[(i[left] < len(x)) & (j[left] < len(y))]
        left = left[x[i[left]] == y[j[left]]]
        if not len(left):
            break
        k += 1
        for z in (one, two):
            if k == len(z):
                half = 1 << k - 1
                z.append(mix(z[-1][: max(0, len(z[-1]) - half)] * _P + z[-1][half:]))
    out = np.zeros(len(i), np.int64)
    for k in range(k - 1, -1, -1):
        x, y = one[k], two[k]
        there = np.flatnonzero((i + out < len(x)) & (j + out < len(y)))
        out[there[x[(i + out)[there]] == y[(j + out)[there]]]] += 1 << k
    return out


def _run_blocks(a: np.ndarray, b: _Text) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All maximal runs that a and b have in common, of b's width or more, in order: (starts in a, starts in b, lengths), in
    chunks of about PAIRS.  All runs with one start in a are in one chunk."""
    width = b.width
    mine = window_hashes(a, width)
    if not len(mine) or len(b.tokens) < width:
        return
    _, order, ranked, several = b.windows
    if not several:  # each stretch of a has one place at most
        spot = np.minimum(np.searchsorted(ranked, mine), len(ranked) - 1)
        at = np.flatnonzero(ranked[spot] == mine)
        place = order[spot[at]]
        if len(at):
            cut = np.flatnonzero(np.concatenate([[True], (at[1:] - at[:-1] != 1) | (place[1:] - place[:-1] != 1), [True]]))
            yield at[cut[:-1]], place[cut[:-1]], np.diff(cut) + width - 1
        return
    levels = [mine]
    for i, j in _begun(mine, b):
        if len(i):
            yield i, j, _lengths(levels, b.levels, i, j) + width - 1


def common_runs(a: np.ndarray, b: np.ndarray, width: int) -> Iterator[tuple[int, int, int]]:
    """The runs of _run_blocks one by one."""
    for block in _run_blocks(a, _Text(b, width)):
        yield from zip(*(x.tolist() for x in block), strict=True)


_NONE = np.zeros(0, np.int64)
_SHIFTS = np.array([0, *(s * k for k in range(1, SHIFT + 1) for s in (1, -1))])


def _beside(a: np.ndarray, b: np.ndarray, x: int, y: int, p: int, q: int, lags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a[x:y] that b[p:q] has at one of these lags (the first that fits), and where."""
    if x >= y or p >= q or set(a[x:y].tolist()).isdisjoint(b[p:q].tolist()):
        return _NONE, _NONE
    at = np.arange(x, y)
    there = at[:, None] + lags
    fits = (there >= p) & (there < q)
    fits &= a[x:y, None] == b[np.where(fits, there, p)]
    hit = fits.any(1)
    return at[hit], there[hit, fits[hit].argmax(1)]


def _chains(runs: Iterable[tuple[int, int, int]], reach: int) -> Iterator[list[tuple[int, int, int]]]:
    """Runs (in order) that follow each other in both texts within reach, as lists.  Open chains are found by where they end;
    a run goes on with the one that it is least shifted against, and where it might go on with others too (or loses places
    to it that make a window), it is a chain of its own besides."""
    cell, first = reach + 2 * K, 0
    live: dict[int, dict[int, list[list[tuple[int, int, int]]]]] = {}  # by cells of the ends in both texts

    def end(c):
        return (c[-1][0] + c[-1][2]) // cell, (c[-1][1] + c[-1][2]) // cell

    for i, j, n in runs:
        while first < (i - reach) // cell:
            for column in live.pop(first, {}).values():
                yield from column
            first += 1
        fit, most = [], min(n, 2 * K)
        columns = range((j - reach) // cell, (j + 2 * K) // cell + 1)
        for u in range((i - reach) // cell, (i + 2 * K) // cell + 1):
            if not (row := live.get(u)):
                continue
            for v in columns:
                for c in row.get(v, ()):
                    x, y, m = c[-1]
                    p, q = x + m - i, y + m - j
                    if p >= most or q >= most or p < -reach or q < -reach:
                        continue
                    over = max(0, p, q)  # repeated words at an edit belong to both runs
                    if over < m and over - q <= reach:
                        fit.append((abs(j - i - y + x), -c[0][0], -c[0][1], over, c))
        if not fit:
            c = [(i, j, n)]
        else:
            *_, over, c = min(fit, key=lambda f: f[:4])
            if len(fit) > 1 or over and n >= reach:
                yield [(i, j, n)]
            u, v = end(c)
            live[u][v] = [x for x in live[u][v] if x is not c]
            c.append((i + over, j + over, n - over))
        u, v = end(c)
        live.setdefault(u, {}).setdefault(v, []).append(c)
    for u in sorted(live):
        for column in live[u].values():
            yield from column


def _wide(x: int, y: int, width: int, n: int) -> tuple[int, int]:
    """x..y widened to width places of 0..n."""
    y = min(n, max(y, x + width))
    return max(0, min(x, y - width)), y


def _matched(a: np.ndarray, b: _Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of b's values each place of a has (-1: none), and whether each place of a and of b has a token of the other."""
    value, code = b.codes
    spot = np.minimum(np.searchsorted(value, a), len(value) - 1)
    fits, there = value[spot] == a, np.zeros(len(value), bool)
    there[spot[fits]] = True
    return np.where(fits, spot, -1), fits, there[code]


def _shared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of the first k places of each text have a token of the other, for all k."""
    return tuple(np.append(0, np.cumsum(x)) for x in _matched(a, _Text(b, 1))[1:])


class _Cover:
    """Ranges that lie in no other, by their beginnings (and thereby by their ends)."""

    def __init__(self):
        self.x, self.y = [], []

    def add(self, x: int, y: int) -> None:
        k = bisect_right(self.x, x)
        if k and self.y[k - 1] >= y:
            return
        k, e = bisect_left(self.x, x), bisect_right(self.y, y)
        self.x[k:e], self.y[k:e] = [x], [y]

    def holds(self, x: int, y: int) -> bool:
        """Whether a range that is longer holds x..y."""
        k = bisect_right(self.x, x) - 1
        return k >= 0 and self.y[k] >= y and (self.x[k] < x or self.y[k] > y)


def _passages(chain: list[tuple[int, int, int]], a: np.ndarray, b: np.ndarray, width: int, least: float, shared: tuple[np.ndarray, np.ndarray] | None = None, cover: _Cover | None = None) -> list[tuple[int, int, int, int, float]]:
    flank = width // 2 + SHIFT
    (i, j, _), (x, y, n) = chain[0], chain[-1]
    if len(chain) == 1 and shared:
        s, t = shared
        x, y = i + n, j + n
        left = s[i] == s[max(0, i - flank)] or t[j] == t[max(0, j - flank - SHIFT)]
        if left and (s[min(len(a), x + flank)] == s[x] or t[min(len(b), y + flank + SHIFT)] == t[y]):  # nothing is aligned beside it
            similarity = n / (2 * max(n, width) - n)
            return [(*_wide(i, x, width, len(a)), *_wide(j, y, width, len(b)), similarity)] if similarity >= least - 1e-9 else []
        x, y = i, j
    before = _beside(a, b, max(0, i - flank), i, max(0, j - flank - SHIFT), j, j - i + _SHIFTS)
    after = _beside(a, b, x + n, min(len(a), x + n + flank), y + n, min(len(b), y + n + flank + SHIFT), y - x + _SHIFTS)
    x, y = x + n, y + n
    gaps = [(u - i - n, v - j - n) for (i, j, n), (u, v, _) in zip(chain, chain[1:])]
    common = sum(n for *_, n in chain)
    most = common + len(before[0]) + len(after[0]) + sum(g for g, h in gaps if min(g, h) > K)
    if (1 + least) * most < 2 * least * width - 1e-9:
        return []  # too few places for a window
    if cover:
        lo, hi = int(before[0][0]) if len(before[0]) else i, int(after[0][-1]) + 1 if len(after[0]) else x
        wide = min(len(a), hi + width - int(2 * least * width / (1 + least)))  # as far as a window may be widened
        if cover.holds(lo if wide < len(a) else max(0, min(lo, len(a) - width)), wide):
            return []  # whatever is found here lies within another passage
    if not len(before[0]) and not len(after[0]):
        similarity = common / (max(x - i, width) + max(y - j, width) - common)
        # With one edit in each window at most, all windows along the chain are good if the whole is.
        if similarity >= least - 1e-9 and all(n >= width for *_, n in chain[1:-1]) and all(max(g) <= K for g in gaps):
            return [(*_wide(i, x, width, len(a)), *_wide(j, y, width, len(b)), similarity)]
    parts = [before]
    for (i, j, n), (i2, j2, _) in zip(chain, [*chain[1:], (None,) * 3]):
        parts.append((np.arange(i, i + n), np.arange(j, j + n)))
        if i2 is not None and min(i2 - i - n, j2 - j - n) > K:  # room for more than one edit
            parts.append(_beside(a, b, i + n, i2, j + n, j2, np.unique(np.concatenate([j - i + _SHIFTS, j2 - i2 + _SHIFTS]))))
    parts.append(after)
    q, p = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
    if (1 + least) * len(q) < 2 * least * width - 1e-9:
        return []
    rising = p > np.maximum.accumulate(np.append(-1, p[:-1]))
    q, p = q[rising], p[rising]
    lo, hi = [], []
    for one, other, size in ((q, p, len(a)), (p, q, len(b))):  # windows of width in one text, and what they hold of the other
        at = np.arange(max(0, int(one[0]) - width + 1), min(size - width, int(one[-1])) + 1)
        x, y = np.searchsorted(one, at), np.searchsorted(one, at + width)
        full = y > x
        x, y = x[full], y[full]
        good = y - x >= least * (width + np.maximum(other[y - 1] - other[x] + 1, width) - (y - x)) - 1e-9
        lo.append(x[good])
        hi.append(y[good])
    lo, hi = np.concatenate(lo), np.concatenate(hi)
    if not len(lo):
        return []
    order = np.lexsort((hi, lo))
    lo, hi = lo[order], hi[order]
    far = np.maximum.accumulate(hi)
    cut = np.flatnonzero(lo[1:] >= far[:-1]) + 1
    out = []
    for s, e in zip(np.append(0, cut).tolist(), np.append(cut, len(lo)).tolist(), strict=True):
        k, end = s, int(far[e - 1])
        while k < e:
            # From this window as far as the similarity of the whole allows, mostly to the end of the overlapping windows.
            x, y = int(lo[k]), np.arange(int(hi[k]), end + 1)
            n, m = np.maximum(q[y - 1] - q[x] + 1, width), np.maximum(p[y - 1] - p[x] + 1, width)
            similarity = (y - x) / (n + m - (y - x))
            last = int(np.flatnonzero(similarity >= least - 1e-9)[-1])
            h = int(y[last])
            one, two = _wide(int(q[x]), int(q[h - 1]) + 1, width, len(a)), _wide(int(p[x]), int(p[h - 1]) + 1, width, len(b))
            out.append((*one, *two, float(similarity[last])))
            k += 1
            while k < e and hi[k] <= h:
                k += 1
    return out


def _widest(found: list[tuple[int, int, int, int, float, int]]) -> list[tuple[int, int, int, int, float, int]]:
    """Of passages (x, y, p, q, similarity, chain) those whose x..y lies in no other's, by x; of equal ones the most similar,
    then the one that stands first in the other text."""
    out = []
    for f in sorted(found, key=lambda f: (f[0], -f[1], -f[4], f[2], f[3])):
        if not out or f[1] > out[-1][1]:
            out.append(f)
    return out


def _linked(i: np.ndarray, j: np.ndarray, n: np.ndarray, reach: int) -> np.ndarray:
    """Which of these runs may follow or be followed by another in a chain: a run ends near where the other begins."""
    cell = reach + 2 * K
    x, y = i + n, j + n
    wide = int(y.max()) // cell + 3
    key = x // cell * wide + y // cell
    order = np.argsort(key, kind="stable")
    key = key[order]
    out = np.zeros(len(i), bool)
    row, column = (i - reach) // cell, np.maximum((j - reach) // cell, 0)
    for u in (row, row + 1):  # ends that are near lie in two rows of cells, in two neighbouring cells of each
        first, last = (np.searchsorted(key, u * wide + v) for v in (column, column + 2))
        total, s = np.append(0, np.cumsum(last - first)), 0
        if total[-1] > 256 * len(i):
            return np.ones(len(i), bool)  # so dense that most are linked
        while s < len(i):
            e = max(s + 1, int(np.searchsorted(total, total[s] + PAIRS, "right")) - 1)
            size = last[s:e] - first[s:e]
            to = np.repeat(np.arange(s, e), size)
            of = order[np.arange(total[s], total[e]) + np.repeat(first[s:e] - total[s:e], size)]
            p, q, most = x[of] - i[to], y[of] - j[to], np.minimum(n[to], 2 * K)
            near = (p < most) & (q < most) & (p >= -reach) & (q >= -reach)
            out[of[near]] = out[to[near]] = True
            s = e
    return out


class _Beside:
    """What two texts have in common beside runs that are in no chain, looked up for many runs at once."""

    def __init__(self, a: np.ndarray, b: _Text, width: int):
        self.flank = flank = width // 2 + SHIFT
        mine, *both = _matched(a, b)
        self.shared = tuple(np.append(0, np.cumsum(x)) for x in both)
        gap = np.full(flank + SHIFT, -2)
        mine, other = np.concatenate([gap, mine, gap]), np.concatenate([gap - 1, b.codes[1], gap - 1])  # gaps fit nowhere
        self.mine = np.lib.stride_tricks.sliding_window_view(mine.astype(np.int32), flank)
        self.other = np.lib.stride_tricks.sliding_window_view(other.astype(np.int32), flank + SHIFT)

    def most(self, k: int, x: np.ndarray, side: int) -> np.ndarray:
        """How many of the places before (side -1) or from (1) these in text k the other text has anywhere."""
        s = self.shared[k]
        y = np.clip(x + side * (self.flank + SHIFT * k), 0, len(s) - 1)
        return np.abs(s[y] - s[x])

    def count(self, i: np.ndarray, j: np.ndarray, side: int) -> np.ndarray:
        """How many places _beside() has before (side -1) or from (1) these."""
        flank, pad, out = self.flank, self.flank + SHIFT, np.zeros(len(i), np.int64)
        for s in range(0, len(i), 4096):
            e = s + 4096
            if side < 0:  # the windows end at i and j; the last SHIFT places of mine would reach beyond j
                x, y = self.mine[i[s:e] + pad - flank], self.other[j[s:e]]
                hit = np.zeros(x.shape, bool)
                for lag in range(-SHIFT, SHIFT + 1):
                    hit[:, : flank - max(0, lag)] |= x[:, : flank - max(0, lag)] == y[:, SHIFT + lag : pad - max(0, -lag) if lag < 0 else pad]
            else:
                x, y = self.mine[i[s:e] + pad], self.other[j[s:e] + pad]
                hit = np.zeros(x.shape, bool)
                for lag in range(-SHIFT, SHIFT + 1):
                    hit[:, max(0, -lag) :] |= x[:, max(0, -lag) :] == y[:, max(0, lag) : flank + lag]
            out[s:e] = hit.sum(1)
        return out


def _alone(i: np.ndarray, j: np.ndarray, n: np.ndarray, beside: _Beside, a: np.ndarray, b: np.ndarray, width: int, least: float) -> Iterator[tuple[int, int, int, int, float, int]]:
    """The passages of runs that are chains of their own, as _passages() has them, with the number of the run; of those with
    nothing beside the run, the widest only."""
    x, y, need = i + n, j + n, 2 * least * width - 1e-9
    before, after = (np.minimum(beside.most(0, p, side), beside.most(1, q, side)) for p, q, side in ((i, j, -1), (x, y, 1)))
    of = np.flatnonzero((1 + least) * (n + before + after) >= need)
    i, j, n, x, y, before, after = (z[of] for z in (i, j, n, x, y, before, after))
    for p, q, most, side in ((i, j, before, -1), (x, y, after, 1)):
        some = np.flatnonzero(most)
        most[some] = beside.count(p[some], q[some], side)
    enough, bare = (1 + least) * (n + before + after) >= need, before + after == 0
    for k in np.flatnonzero(enough & ~bare).tolist():
        yield from ((*f, int(of[k])) for f in _passages([(int(i[k]), int(j[k]), int(n[k]))], a, b, width, least, beside.shared))
    i, j, n, x, y, of = (z[enough & bare] for z in (i, j, n, x, y, of))
    if not len(i):
        return
    ends = []
    for u, v, size in ((i, x, len(a)), (j, y, len(b))):  # as _wide()
        v = np.minimum(size, np.maximum(v, u + width))
        ends += [np.maximum(0, np.minimum(u, v - width)), v]
    x, y, p, q = ends
    similarity = n / (2 * np.maximum(n, width) - n)
    by = np.lexsort((q, p, -similarity, -y, x))
    far = y[by]
    by = by[np.append(True, far[1:] > np.maximum.accumulate(far)[:-1])]
    yield from zip(*(z[by].tolist() for z in (x, y, p, q, similarity, of)), strict=True)


def _batches(chains: Iterable[list[tuple[int, int, int]]]) -> Iterator[list[tuple[int, list[tuple[int, int, int]]]]]:
    """Chains with their numbers, about PAIRS runs at a time, the longest stretches first."""
    rows, runs = [], 0
    length = lambda f: f[1][0][0] - f[1][-1][0] - f[1][-1][2]
    for f in enumerate(chains):
        rows.append(f)
        runs += len(f[1])
        if runs > PAIRS:
            yield sorted(rows, key=length)
            rows, runs = [], 0
    yield sorted(rows, key=length)


def passages_of(a: np.ndarray, b: np.ndarray | _Text, passage: int = PASSAGE, least: float = SIMILARITY) -> list[tuple[int, int, int, int, float, int]]:
    """Maximal passages of shingle sequence a that b repeats: word ranges in a and in b (end excluded), similarity and parts.
    Both ranges have passage words or more, and none of a lies within another.  Where a repeats one part of b again and
    again without a gap, the range holds all of them, parts says how many, and similarity is the least of any."""
    width, _, run = run_width(passage, least)
    text = b if isinstance(b, _Text) else _Text(b, run)
    b = text.tokens
    if len(a) < width or len(b) < width:
        return []
    found: list[tuple[int, int, int, int, float, int]] = []
    most, beside, far, lone = PAIRS, None, -1, 0

    def runs():
        """Runs that may be in chains; the others' passages are found on the way, with numbers below zero."""
        nonlocal beside, far, lone
        for block in _run_blocks(a, text):
            i, j, n = block
            if len(i) >= MANY:
                beside = beside or _Beside(a, text, width)
                linked = _linked(i, j, n, width)
                if far >= 0 or len(i) > PAIRS // 2:  # near runs may be in the block before or after
                    linked |= (i - width <= far) | (i + n + width >= int(i[-1]))
                far = max(far, int((i + n).max()))
                free = np.flatnonzero(~linked)
                found.extend((*x, ~(lone + c)) for *x, c in _alone(*(z[free] for z in block), beside, a, b, width, least))
                lone += len(free)
                i, j, n = (z[linked] for z in block)
            else:
                far = max(far, int((i + n).max()))
            yield from zip(i.tolist(), j.tolist(), n.tolist(), strict=True)

    cover = _Cover()
    for rows in _batches(_chains(runs(), width)):
        for c, chain in rows:
            for f in _passages(chain, a, b, width, least, beside and beside.shared, cover):
                found.append((*f, c))
                cover.add(f[0], f[1])
        if len(found) > most:
            found[:] = _widest(found)
            most = 2 * len(found) + PAIRS
    out = []
    for x, y, p, q, similarity, c in _widest(found):
        parts = 1
        if out and c != out[-1][5] and x < out[-1][1] and p < out[-1][3] and q > out[-1][2]:
            u, _, v, w, s, c, parts = out.pop()  # a goes round in circles over the same part of b
            x, p, q, similarity, parts = u, min(p, v), max(q, w), min(similarity, s), parts + 1
        out.append((x, y, p, q, similarity, c, parts))
    return [(x, y + K - 1, p, q + K - 1, s, n) for x, y, p, q, s, _, n in out]


def _verify(pairs: DataFrame, texts: DataFrame, passage: int, least: float) -> DataFrame:
    """pairs: distinct (_u, _lead), a saved table; texts: in buckets of _u.  One row for each passage; a pair without any has
    one row with null places.  Only the pairs' own texts move, once, to their leaders' buckets."""
    lead = texts.select(F.col("_u").alias("_lead"), F.col("_text").alias("_tb"))
    lead = pairs.groupBy("_lead").agg(F.count("*").alias("_n")).join(lead, "_lead")
    both = join_unique(pairs.join(texts.select("_u", F.col("_text").alias("_ta")), "_u"), lead, "_lead", "_n", wide=True).select("_u", "_lead", "_ta", "_tb")
    names = ["_u", "_lead", "a1", "a2", "b1", "b2", "similarity", "parts"]

    def parted(data, offsets):
        hashes, _, _, first = word_hashes(data, offsets)
        return joined_shingles(hashes, first)[0], first.tolist()  # candidates have more words than K

    *_, width = run_width(passage, least)

    def run(batches):
        leader = text = None
        for rows, data, offsets in slices(batches, "_ta"):
            one, first = parted(data, offsets)
            us, leads = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            heads = [k for k, v in enumerate(leads) if v != (leads[k - 1] if k else leader)]  # rows come by leader
            leader, out, done = leads[-1], [], 0

            def compare(end):
                nonlocal done
                for k in range(done, end):
                    found = passages_of(one[first[k] : first[k + 1] - K + 1], text, passage, least)
                    out.extend((us[k], leads[k], *x) for x in found or [(None,) * 6])
                done = end

            for part, data2, offsets2 in slices([pa.RecordBatch.from_arrays([rows.column(3).take(pa.array(heads, pa.int64()))], names=["_tb"])], "_tb"):
                two, first2 = parted(data2, offsets2)
                for i in range(part.num_rows):
                    compare(heads.pop(0))
                    text = _Text(two[first2[i] : first2[i + 1] - K + 1], width)
            compare(len(us))
            kinds = [pa.int64()] * 6 + [pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)

    return both.mapInArrow(run, "_u bigint, _lead bigint, a1 bigint, a2 bigint, b1 bigint, b2 bigint, similarity double, parts bigint")


# ---------------------------------------------------------------- meeting


def _met(keyed: DataFrame, most: int = 1, large: bool = False) -> DataFrame:
    """keyed: (_key, _u, _at, _till).  Its rows with each of the key's leaders, the least texts that have the key, as _lead,
    where the leader is the lesser; _led: whether the text is a leader too.  large: keyed and its leaders grow with the texts,
    so they are joined by shuffle at every size."""
    groups = keyed.groupBy("_key").agg(F.min("_u").alias("_lead"), F.max("_u").alias("_last"), F.count("*").alias("_n")).where("_lead != _last")
    if most == 1:
        leaders = save(groups.select("_key", "_lead", "_n"), "leaders")
        met = join_unique(keyed, leaders.hint("shuffle_hash") if large else leaders, "_key", "_n").withColumn("_led", F.col("_u") == F.col("_lead"))
    else:
        place = F.row_number().over(Window.partitionBy("_key").orderBy("_u"))  # tasks pass on so many of a key at most
        first = keyed.select("_key", "_u").distinct().withColumn("_place", place).where(F.col("_place") <= most).drop("_place")
        leaders = save(first.join(groups.select("_key"), "_key").withColumnRenamed("_u", "_lead"), "leaders")
        led = keyed.join(leaders.select("_key", F.col("_lead").alias("_u"), F.lit(True).alias("_is")), ["_key", "_u"], "left").withColumn("_led", F.coalesce("_is", F.lit(False)))
        met = led.join(leaders, "_key")  # a row for each leader
    return met.select("_key", "_u", "_lead", "_at", "_till", "_led").where("_lead < _u")


def _unsettled(met: DataFrame, found: DataFrame, words: int) -> DataFrame:
    """Places of met, leaders' apart, that no passage with a leader covers, where another text has such a place too."""
    there = found.where("a1 is not null").select(F.col("_u").alias("_v"), F.col("_lead").alias("_w"), "a1", "a2")
    covers = (F.col("_u") == F.col("_v")) & (F.col("_lead") == F.col("_w")) & (F.col("a1") <= F.col("_at")) & (F.col("a2") >= F.col("_till") + words)
    names = ["_key", "_u", "_at", "_till"]
    settled = met.where("not _led").join(there, covers, "left_semi").select(*names)
    loose = save(met.where("not _led").select(*names).join(settled, names, "left_anti").distinct(), "unsettled")
    several = loose.groupBy("_key").agg(F.min("_u").alias("_x"), F.max("_u").alias("_y"), F.count("*").alias("_n")).where("_x != _y")
    return join_unique(loose, several.select("_key", "_n"), "_key", "_n").select(*names)


def _regions(loose: DataFrame, found: DataFrame, texts: DataFrame, passage: int, least: float) -> DataFrame:
    """(_u, _at, _shingles, _wanted): the stretches of each text with windows of passage words that hold a run of an
    unsettled place and lie in no passage, with the first word, the shingles and which of them begin such a window."""
    width, _, run = run_width(passage, least)
    spans = loose.groupBy("_u").agg(F.collect_set(F.struct("_at", "_till")).alias("_spans"))  # places of one text
    known = found.where("a1 is not null").join(loose.select("_u").distinct(), "_u", "left_semi")
    known = known.groupBy("_u").agg(F.collect_set(F.struct(F.col("a1").cast("int").alias("_at"), F.col("a2").cast("int").alias("_till"))).alias("_known"))
    rows = texts.join(spans, "_u").join(known, "_u", "left").select("_u", "_text", "_spans", "_known")

    def work(batches):
        for part, data, offsets in slices(batches):
            hashes, _, _, first = word_hashes(data, offsets)
            out = []
            for k, (u, spans, known) in enumerate(zip(*(part.column(c).to_pylist() for c in (0, 2, 3)), strict=True)):
                tokens = shingles(hashes[first[k] : first[k + 1]], K)
                n = len(tokens) - width + 1
                wanted = np.zeros(n, bool)
                for s in spans:
                    wanted[max(0, s["_at"] - width + run) : s["_till"] + 1] = True
                for s in known or ():
                    wanted[s["_at"] : max(0, s["_till"] - passage + 1)] = False
                edge = np.flatnonzero(np.diff(wanted, prepend=False, append=False))
                for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    if out and out[-1][0] == u and x < out[-1][1] + len(out[-1][2]) // 8:  # windows that overlap are one stretch
                        x0 = out[-1][1]
                        out[-1] = (u, x0, tokens[x0 : y + width - 1].tobytes(), wanted[x0:y].tobytes())
                    else:
                        out.append((u, x, tokens[x : y + width - 1].tobytes(), wanted[x:y].tobytes()))
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names=["_u", "_at", "_shingles", "_wanted"])

    return rows.mapInArrow(work, "_u bigint, _at int, _shingles binary, _wanted binary")


def _rare_shingles(regions: DataFrame, passage: int, least: float) -> DataFrame:
    """(_key, _u, _at, _till): the rarest shingles of each wanted window, as many as windows of that similarity need to share
    one of them, with their places (the last word as _till less the run that _unsettled() adds)."""
    width, enough, _ = run_width(passage, least)
    rare, shift = width - enough + 1, np.uint64(64 - _COUNT_BITS)
    arrays = lambda batches: (np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64) for b in batches)
    shared = regions.sparkSession.sparkContext.broadcast(bucket_counts(regions, arrays, _COUNT_BITS))

    def work(batches):
        for part in batches:
            keys, places, sizes = [], [], []
            for at, raw, flags in zip(*(part.column(i).to_pylist() for i in range(1, 4)), strict=True):
                tokens, starts = np.frombuffer(raw, np.uint64), np.flatnonzero(np.frombuffer(flags, bool))
                # One number orders alike in all texts: the count first, then the shingle itself.
                rank = np.argsort(np.lexsort((tokens, shared.value[(tokens >> shift).astype(np.int64)])))
                windows = np.lib.stride_tricks.sliding_window_view(rank, width)[starts]
                place = np.unique(np.argpartition(windows, rare - 1, 1)[:, :rare] + starts[:, None])
                keys.append(tokens[place].view(np.int64))
                places.append(place + at)
                sizes.append(len(place))
            if keys:
                u, place = part.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(np.concatenate(places), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), u, place, place], names=["_key", "_u", "_at", "_till"])

    return regions.mapInArrow(work, "_key bigint, _u bigint, _at int, _till int")


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE, least: float = SIMILARITY, functions: int = FUNCTIONS) -> DataFrame:
    """One row for each passage that a text repeats from a leader: id_col, first_word, end_word (excluded), other_id,
    other_first_word, other_end_word, similarity, parts (1, or how many passages in circles the row holds; similarity is then
    the least of any).  Every occurrence of a passage but its leader's has such a row.
    """
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where("_text is not null")
    docs = docs.withColumn("_u", F.xxhash64("_text"))
    *_, run = run_width(passage, least)
    signed = save(signed_cells(docs.select("_u", "_text"), functions, passage, run), "cells")
    met = save(_met(signed.where("_key is not null"), large=True).distinct(), "met")  # equal texts have equal rows
    pairs = save(met.select("_u", "_lead").distinct(), "pairs")
    ends = save(pairs.select(F.explode(F.array("_u", "_lead")).alias("_u")).distinct(), "ends")
    texts = save_by_key(docs.select("_u", "_text").join(ends.hint("shuffle_hash"), "_u", "left_semi").dropDuplicates(["_u"]), "candidate-texts", "_u")
    found = save(_verify(pairs, texts, passage, least), "verified")
    loose = save(_unsettled(met, found, run + K - 1), "unsettled")
    regions = save(_regions(loose, found, texts, passage, least), "regions")
    groups = save(_rare_shingles(regions, passage, least), "rare-shingles")
    most = 1
    while True:
        met, most = save(_met(groups, most), "met"), 2 * most
        pairs = save(met.select("_u", "_lead").distinct().join(found.select("_u", "_lead").distinct(), ["_u", "_lead"], "left_anti"), "pairs")
        found = found.unionByName(save(_verify(pairs, texts, passage, least), "verified"))
        groups = save(_unsettled(met, found, K), "rare-shingles")
        if groups.isEmpty():
            break
    # Equal texts: the least id stands for them.
    size = signed.where("_key is null").select("_u", F.col("_at").cast("bigint").alias("_words")).distinct()
    first = F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id")).alias("_first")
    own = docs.select("_u", "_id").join(size, "_u", "left_semi")
    one = save(own.groupBy("_u").agg(first, F.count("*").alias("_n")).select("_u", F.col("_first._id").alias("_first"), "_n"), "texts-by-id")
    several = one.where("_n > 1").join(size, "_u")
    copies = join_unique(own, several, "_u", "_n").where(~F.col("_id").eqNullSafe(F.col("_first"))).distinct()
    place = [F.lit(0).cast("bigint"), F.col("_words")]
    same = copies.select(F.col("_id").alias(id_col), place[0].alias("first_word"), place[1].alias("end_word"), F.col("_first").alias("other_id"), place[0].alias("other_first_word"), place[1].alias("other_end_word"), F.lit(1.0).alias("similarity"), F.lit(1).cast("bigint").alias("parts"))
    names = one.select("_u", F.col("_first").alias("_id"))
    named = found.where("a1 is not null").join(names, "_u").join(names.select(F.col("_u").alias("_lead"), F.col("_id").alias("_other")), "_lead")
    near = named.select(F.col("_id").alias(id_col), F.col("a1").alias("first_word"), F.col("a2").alias("end_word"), F.col("_other").alias("other_id"), F.col("b1").alias("other_first_word"), F.col("b2").alias("other_end_word"), "similarity", "parts")
    return near.unionByName(same)
