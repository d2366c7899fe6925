"""Operator 6: byte-level BPE encoding and decoding.

Pre-tokenisation uses no regular expression.  Every code point becomes a symbol (its class, with what the
neighbouring code points say), every symbol a function from scanner state to scanner state; functions compose
associatively, so the state before each code point comes from a blocked prefix scan over arrays, and a table says
at which code points a token begins.  The slices then go through cached pair merging.

Defined cases: a null or empty text has no tokens; very long texts and very long words work (pairs are merged with a
heap); every row is encoded by itself, so repeated rows, ties and empty tables need nothing special.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import slices

# Symbols: letter, number, other, apostrophe before a one- or two-letter contraction, a space that joins what follows,
# white space inside a run, other white space that ends a run, and the break between texts.
L, N, O, A1, A2, JOIN, INNER, LAST, BREAK = range(9)
# States: a token has just ended, after a joining space, in letters, in numbers, in others, in white space,
# and one or two letters of a contraction still to come.
END, JOINED, LETTERS, NUMBERS, OTHERS, SPACES, ONE_LEFT, TWO_LEFT = range(8)
#: Unicode's White_Space (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Stands between texts; above every code point.
SENTINEL = 0x110000
#: Words whose tokens are kept; the cache is emptied when full, which changes speed and no result.
CACHE_WORDS = 400_000


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a token begins at this code point."""
    if symbol == L:
        if state in (TWO_LEFT, ONE_LEFT):
            return (ONE_LEFT if state == TWO_LEFT else END), False
        return LETTERS, state not in (JOINED, LETTERS)
    if symbol == N:
        return NUMBERS, state not in (JOINED, NUMBERS)
    if symbol in (O, A1, A2):
        if state in (JOINED, OTHERS):
            return OTHERS, False
        return {O: OTHERS, A1: ONE_LEFT, A2: TWO_LEFT}[symbol], True
    if symbol == INNER:
        return SPACES, state != SPACES
    return {JOIN: JOINED, LAST: END, BREAK: END}[symbol], symbol != BREAK


@lru_cache(1)
def _tables() -> tuple[np.ndarray, ...]:
    """(code point class, next state, begins, function of a symbol, composition, function applied to END)."""
    classes = np.full(SENTINEL + 1, O, np.uint8)
    for cp in range(SENTINEL):
        if (kind := unicodedata.category(chr(cp))[0]) == "L":
            classes[cp] = L
        elif kind == "N":
            classes[cp] = N
    classes[WHITE_SPACE] = INNER
    classes[SENTINEL] = BREAK
    nxt, begins = np.zeros((8, 9), np.uint8), np.zeros((8, 9), bool)
    for s in range(8):
        for y in range(9):
            nxt[s, y], begins[s, y] = _step(s, y)
    functions = [tuple(range(8))]  # the identity first
    index = {functions[0]: 0}
    for f in functions:  # grows while it is read: the closure under composition
        for y in range(9):
            g = tuple(int(nxt[s, y]) for s in f)
            if g not in index:
                index[g] = len(functions)
                functions.append(g)
    compose = np.array([[index[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint8 if len(functions) < 256 else np.uint16)
    of_symbol = np.array([index[tuple(int(nxt[s, y]) for s in range(8))] for y in range(9)], compose.dtype)
    return classes, nxt, begins, of_symbol, compose, np.array([f[END] for f in functions], np.uint8)


def prefix_scan(f: np.ndarray, compose: np.ndarray, block: int = 64) -> np.ndarray:
    """Composition of all functions before each place (index 0 is the identity), by blocks: totals, their scan, then within."""
    n = len(f)
    if n <= block:
        out, acc = np.zeros(n, compose.dtype), 0
        for i in range(n):
            out[i], acc = acc, compose[acc, f[i]]
        return out
    rows = -(-n // block)
    columns = np.zeros((rows, block), compose.dtype)
    columns.ravel()[:n] = f
    columns = np.ascontiguousarray(columns.T)
    flat, m = compose.ravel(), len(compose)
    total = columns[0]
    for j in range(1, block):
        total = flat.take(total.astype(np.intp) * m + columns[j])
    acc = prefix_scan(total, compose, block)
    out = np.empty_like(columns)
    for j in range(block):
        out[j] = acc
        acc = flat.take(acc.astype(np.intp) * m + columns[j])
    return out.T.ravel()[:n]


def token_starts(cps: np.ndarray) -> np.ndarray:
    """Indices of code points at which a token begins; SENTINEL separates texts and is no token."""
    if not len(cps):
        return np.zeros(0, np.int64)
    classes, _, begins, of_symbol, compose, at_end = _tables()
    symbol = classes.take(cps)
    after = np.append(symbol[1:], BREAK)
    before_word = (symbol == INNER) & (after != INNER) & (after != BREAK)
    space = cps == 0x20
    quotes = np.flatnonzero(cps == 0x27)
    symbol[before_word] = LAST
    symbol[before_word & space] = JOIN
    if len(quotes):
        padded = np.append(cps, [SENTINEL, SENTINEL])
        one, two = padded[quotes + 1], padded[quotes + 2]
        pair = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)  # re, ve, ll
        symbol[quotes[np.isin(one, [0x73, 0x74, 0x6D, 0x64])]] = A1  # s, t, m, d
        symbol[quotes[pair]] = A2
    state = at_end.take(prefix_scan(of_symbol.take(symbol), compose))
    return np.flatnonzero(begins.ravel().take(state * np.uint8(9) + symbol))


def pieces_of(data: bytes, offsets: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """The pre-tokens of all texts in order: byte starts, byte ends, and where each text's begin in these lists (with the end)."""
    cps = np.frombuffer(data.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(cps) == len(data):
        at, cuts = np.arange(len(cps) + 1), offsets
    else:
        width = 1 + (cps > 0x7F) + (cps > 0x7FF) + (cps > 0xFFFF)
        width[(cps >= 0xDC80) & (cps <= 0xDCFF)] = 1  # a byte that is no UTF-8 is a code point of its own
        at = np.zeros(len(cps) + 1, np.int64)
        np.cumsum(width, out=at[1:])
        cuts = np.searchsorted(at, offsets)  # in code points
    starts = token_starts(np.insert(cps, cuts[1:], SENTINEL))
    # A break stands after each text, so text i has moved by i places.
    first = np.searchsorted(starts, np.append(cuts[:-1] + np.arange(len(cuts) - 1), len(cps) + len(cuts)))
    begin = at.take(starts - np.repeat(np.arange(len(cuts) - 1), np.diff(first)))
    end = np.append(begin[1:], len(data))[: len(begin)]
    return begin.tolist(), end.tolist(), first.tolist()


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of the lowest rank, the leftmost of equals, is joined until none is left."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) > 256:
        return _merge_long(piece, ranks)
    none = 1 << 40
    parts = [piece[i : i + 1] for i in range(len(piece))]
    rank = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
    while rank and (least := min(rank)) != none:
        i = rank.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del rank[i]
        if i < len(rank):
            rank[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            rank[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(piece)
    end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = right[i] if alive[i] else n
        if j >= n or end[j] != e:
            continue
        alive[j], end[i], right[i] = False, e, right[j]
        if right[i] < n:
            left[right[i]] = i
        for a in (left[i], i):
            if a >= 0 and right[a] < n and (r := ranks.get(piece[a : end[right[a]]])) is not None:
                heapq.heappush(heap, (r, a, end[right[a]]))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class _Words(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = array("I", merge(piece, self.ranks)).tobytes()
        if len(piece) <= 256:
            self[piece] = ids
        return ids


class Codec:
    """Encodes and decodes by the ranks of one tiktoken file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words = _Words(self.ranks)
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.bytes_of[i] = token
        self.lengths = np.array([len(x) for x in self.bytes_of], np.int64)

    def encode_slice(self, data: bytes, offsets: np.ndarray) -> Iterator[bytes]:
        """Ids of each text, as bytes."""
        begin, end, first = pieces_of(data, offsets)
        ids, cut = self.words.__getitem__, data.__getitem__
        for a, b in zip(first, first[1:], strict=False):
            yield b"".join(map(ids, map(cut, map(slice, begin[a:b], end[a:b]))))

    def encode(self, text: str | None) -> np.ndarray:
        data = (text or "").encode()
        return np.frombuffer(next(self.encode_slice(data, np.array([0, len(data)]))), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each token in the decoded text, with the end: any range of ids can be decoded or located."""
        return np.concatenate([[0], np.cumsum(self.lengths[ids])])


@lru_cache(4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row for each row of df: the id, n_tokens, the ids (little-endian 32-bit, as binary), and digests of the ids and of the decoded bytes.

    vocabulary: a tiktoken rank file that every executor has.  The id column keeps its type; the other columns go.
    """
    kept = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    id_type = kept.schema["_id"].dataType.simpleString()
    extra = ", ids binary" if with_ids else ""

    def run(batches):
        c = codec(vocabulary)
        for rows, data, offsets in slices(batches):
            n, ids_hash, back_hash, all_ids = [], [], [], []
            for raw in c.encode_slice(data.tobytes(), offsets):
                ids = np.frombuffer(raw, "<u4")
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(raw).hexdigest())
                back_hash.append(hashlib.sha256(c.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(raw)
            columns = [rows.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(back_hash, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(all_ids, pa.binary())] * with_ids, names=["_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    return kept.mapInArrow(run, f"_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{extra}").withColumnRenamed("_id", id_col)
