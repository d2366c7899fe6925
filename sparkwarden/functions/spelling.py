"""Jaro similarity over arrays of pairs, and the test of common characters that no pair above a threshold fails."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters (pairs times the longest text) that are worked on at once.
_CELLS = 1 << 20


def _codes(texts: list[str], width: int) -> np.ndarray:
    """Code points, a row for each text, 0 behind its end."""
    return np.array(texts, f"U{max(width, 1)}").view(np.uint32).reshape(len(texts), -1)


def jaro_of(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro similarity of each pair: a character of a takes the first equal one of b that is free and near enough.

    All pairs step through a together, so a step is a few array operations however many pairs there are.
    """
    out = np.zeros(len(a))
    n, m = (np.fromiter(map(len, x), np.int64, len(a)) for x in (a, b))
    order = np.argsort(np.maximum(n, m), kind="stable")
    at = 0
    while at < len(order):
        longest = max(1, int(max(n[order[at]], m[order[at]])))
        rows = order[at : at + max(1, _CELLS // (2 * longest))]
        rows = rows[np.maximum(n[rows], m[rows]) <= 2 * longest]  # texts of like lengths together
        out[rows] = _block([a[i] for i in rows], [b[i] for i in rows], n[rows], m[rows])
        at += len(rows)
    return out


def _block(a: list[str], b: list[str], n: np.ndarray, m: np.ndarray) -> np.ndarray:
    x, y = _codes(a, int(n.max())), _codes(b, int(m.max()))
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)[:, None]
    place = np.arange(y.shape[1])[None, :]
    free = place < m[:, None]
    hit = np.zeros(x.shape, bool)
    row = np.arange(len(a))
    for i in range(x.shape[1]):
        fits = free & (y == x[:, i, None]) & (np.abs(place - i) <= reach) & (i < n)[:, None]
        first = fits.argmax(1)
        found = fits[row, first]
        hit[found, i] = True
        free[row[found], first[found]] = False
    taken = (place < m[:, None]) & ~free
    common = hit.sum(1)
    # The common characters of both sides, in the order of each.
    u, v = (np.take_along_axis(z, np.argsort(~k, axis=1, kind="stable"), 1) for z, k in ((x, hit), (y, taken)))
    width = min(u.shape[1], v.shape[1])
    moved = ((u[:, :width] != v[:, :width]) & (np.arange(width) < common[:, None])).sum(1) // 2
    some = common > 0
    c = np.where(some, common, 1)
    score = (c / np.maximum(n, 1) + c / np.maximum(m, 1) + (c - moved) / c) / 3
    same = np.fromiter((s == t for s, t in zip(a, b, strict=True)), bool, len(a))
    return np.where(same, 1.0, np.where(some, score, 0.0))


@F.pandas_udf(T.DoubleType())
def jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro similarity; null where a side is null.  Two equal texts, empty ones too, have 1."""
    there = a.notna() & b.notna()
    out = pd.Series(np.full(len(a), np.nan), dtype="float64")
    if there.any():
        out[there.to_numpy()] = jaro_of(a[there].tolist(), b[there].tolist())
    return out.astype(object).where(there.to_numpy(), None)


def characters(c: Column) -> Column:
    """The characters of a text, told apart by occurrence: of `abba` these are a0, b0, b1, a1."""
    letters = F.split(c, "(?!^)")
    label = lambda x, i: F.concat(x, F.size(F.filter(F.slice(letters, F.lit(1), i), lambda y: y == x)).cast("string"))
    return F.when(F.length(c) > 0, F.transform(letters, label)).otherwise(F.array().cast("array<string>"))


def common_needed(n: Column, m: Column, least: float) -> Column:
    """How many characters texts of these lengths have in common at least if their similarity is least or more: with c common
    ones it is (c / n + c / m + 1) / 3 at most."""
    return F.ceil((3 * least - 1) * n * m / (n + m) - 1e-9)
