"""Operator 11: scores under a hierarchical Pitman-Yor language model.

A text is its lower-cased words and an end.  The restaurant of a context (the word before, or the beginning) seats the
tokens that follow it; every table that serves a word there is a customer of the restaurant that all contexts share as
their parent, whose own base is uniform over the training words and one unknown word.  Contexts are dealt by hash to
2 ** `CONTEXT_BITS` restaurants: with more distinct words before than that, several share one.

Seating is sampled by Gibbs: a sweep draws for each word in each restaurant how many tables it has, given all others, from
its exact conditional (generalised Stirling numbers) for up to `EXACT` customers; further customers of the word follow one
after another by the seating rule, the later ones in blocks of a 16th of those seated.  Scores use the mean over `SAMPLES`
sweeps of the predictive probability, each sweep with its own tables at every level, so probabilities sum to one.

Words are dealt to parts by hash, so a part knows all restaurants' tables of its words, and a word of very many tokens to
several parts by context.  What parts tell each other is, for each restaurant, its customers and tables: a fixed number of
sums.  Sweeps are drawn from seeds, so a later pass finds the same tables again.  The tokens themselves move once: a chunk of
texts sends each part its words, contexts and counts, by document, packed; parts send back sums for each document.

Defined cases: a null or empty text is its end alone; without training rows every word is unknown; a null id is trained on;
repeated rows are texts of their own; an empty table gives an empty result.  A task that is lost and run again must meet
its rows in the same order, as from files; other inputs are to be saved first.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import byte_table, mix, pack, runs, save, slices, span_hash, unpack

CONTEXT_BITS = 20
#: Tokens in a part, and bytes of text in a chunk: what a task holds at once.
PART_TOKENS, CHUNK_BYTES = 1_000_000, 4 << 20
EXACT, BURN, SAMPLES = 64, 2, 3
#: Sums of logarithms travel as whole numbers of these steps, which take fewer bytes.
STEP, STEP_BASE = 1e-7, 1e-9
THETA, THETA_ROOT = 1.0, 1.0
#: A word of so large a share of a chunk is counted for the deal; from half a part's tokens on it has parts of its own.
OFTEN = 1 << 14
_BLOCKS = 64
_SCALARS, _HOT = _BLOCKS, _BLOCKS + 1
_END, _BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_LOWER = byte_table(words=False)
_IN_WORD = np.ones(256, bool)
_IN_WORD[[*range(0x09, 0x0E), 0x20]] = False
_U = np.uint64


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes with each text's end, restaurants of their contexts, tokens of each text)."""
    low = _LOWER[data]
    starts, ends = runs(_IN_WORD[data], offsets)
    first = np.searchsorted(starts, offsets)
    size = np.diff(first) + 1
    last = np.cumsum(size) - 1
    out = np.empty(len(starts) + len(size), np.uint64)
    word = np.ones(len(out), bool)
    word[last] = False
    out[word], out[last] = span_hash(low, starts, ends), _END
    before = np.append(_BEGIN, out[:-1])
    before[last - size + 1] = _BEGIN
    return out, (mix(before + _U(1)) >> _U(64 - CONTEXT_BITS)).astype(np.uint32), size


def _firsts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def _chunks(batches, usable: int) -> Iterator[tuple]:
    """Texts in chunks of about CHUNK_BYTES: (ids, trained on, tokens, contexts, tokens of each text)."""
    held, size, texts = [], 0, 0
    for rows, data, offsets in slices(batches):
        held.append((rows.column(0), rows.column(usable).to_numpy(zero_copy_only=False), *tokens(data, offsets)))
        size, texts = size + len(data), texts + len(offsets)
        if size >= CHUNK_BYTES or texts >= 1 << 19:
            yield tuple(pa.chunked_array(x).combine_chunks() if i == 0 else np.concatenate(x) for i, x in enumerate(zip(*held, strict=True)))
            held, size, texts = [], 0, 0
    if held:
        yield tuple(pa.chunked_array(x).combine_chunks() if i == 0 else np.concatenate(x) for i, x in enumerate(zip(*held, strict=True)))


def _deal(docs: DataFrame) -> tuple[int, dict[int, int]]:
    """(number of parts, hashes of very frequent words with the number of parts that each has for itself)."""

    def count(batches):
        for _, _, words, _, _ in _chunks(batches, 2):
            h, n = np.unique(words, return_counts=True)
            often = n >= max(32, len(words) // OFTEN)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(h[often].view(np.int64), 0), pa.int64(), mask=np.arange(int(often.sum()) + 1) == often.sum()), pa.array(np.append(n[often], len(words)), pa.int64())], names=["_word", "_n"])

    counts = save(docs.mapInArrow(count, "_word bigint, _n bigint").groupBy("_word").agg(F.sum("_n").alias("_n")), "frequent-words")
    total = counts.where("_word is null").collect()
    hot = counts.where(f"_word is not null and 2 * _n > {PART_TOKENS}").collect()  # one word for each half part of tokens at most
    return max(1, -(-(total[0]["_n"] if total else 0) // PART_TOKENS)), {r["_word"]: -(-2 * r["_n"] // PART_TOKENS) for r in hot}


_MODEL = ["_words", "_types", "_rest", "_train"]
_RUNS = ["_runs", "_docs", "_times"]


def _take_ragged(values: list[np.ndarray], sizes: np.ndarray, order: np.ndarray) -> list[np.ndarray]:
    start, n = np.cumsum(sizes)[order] - sizes[order], sizes[order]
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - start, n)
    return [v[place] for v in values]


def _packed(docs: DataFrame, parts: int, hot: dict[int, int]) -> DataFrame:
    """docs: (_id, _text, _usable).  Rows for parts (_part >= 0), one for each chunk that has tokens of it, and one row for
    each chunk with its documents (_part < 0)."""
    hot_words = np.array(sorted(hot), np.int64).view(np.uint64)
    hot_size = np.array([hot[w] for w in sorted(hot)], np.int64)
    hot_part = parts + np.cumsum(hot_size) - hot_size
    order = np.argsort(hot_words)
    hot_words, hot_size, hot_part = hot_words[order], hot_size[order], hot_part[order]
    kind = docs.schema["_id"].dataType.simpleString()
    names = ["_part", "_chunk", *_MODEL, *_RUNS, "_ids", "_held", "_tokens"]

    def run(batches):
        task = TaskContext.get().partitionId()
        for number, (ids, usable, words, rest, size) in enumerate(_chunks(batches, 2)):
            chunk = task << 20 | number
            id_kind = ids.type
            # One number orders tokens by word, context and document.
            vocabulary, word = np.unique(words, return_inverse=True)
            bits = max(1, len(size).bit_length())
            key = word.astype(np.uint64) << _U(CONTEXT_BITS + bits) | rest.astype(np.uint64) << _U(bits) | np.repeat(np.arange(len(size), dtype=np.uint64), size)
            key.sort()
            at = _firsts(key)
            times = np.diff(np.append(at, len(key)))
            key = key[at]
            doc = (key & _U((1 << bits) - 1)).astype(np.uint32)
            kinds = key >> _U(bits)
            at = _firsts(kinds)
            n_runs = np.diff(np.append(at, len(kinds)))
            train = np.add.reduceat(times * usable[doc], at)
            kinds = kinds[at]
            of, rest = (kinds >> _U(CONTEXT_BITS)).astype(np.int64), (kinds & _U((1 << CONTEXT_BITS) - 1)).astype(np.uint32)
            part = (((vocabulary >> _U(32)) * _U(parts)) >> _U(32)).astype(np.int64)[of]
            if len(hot_words):
                spot = np.minimum(np.searchsorted(hot_words, vocabulary), len(hot_words) - 1)
                own = (hot_words[spot] == vocabulary)[of]
                part[own] = hot_part[spot[of[own]]] + rest[own].astype(np.int64) % hot_size[spot[of[own]]]
                order = np.argsort(part, kind="stable")
                doc, times = _take_ragged([doc, times], n_runs, order)
                part, of, rest, train, n_runs = (x[order] for x in (part, of, rest, train, n_runs))
            cut = [*_firsts(part).tolist(), len(part)]
            run_at = np.append(0, np.cumsum(n_runs))
            for a, b in zip(cut, cut[1:], strict=False):
                new = _firsts(of[a:b])
                w, p, q = of[a:b][new], int(run_at[a]), int(run_at[b])
                d = np.diff(doc[p:q], prepend=np.uint32(0))
                arrays = [np.diff(vocabulary[w], prepend=_U(0)), np.diff(np.append(new, b - a)).astype(np.uint32), rest[a:b], train[a:b].astype(np.uint32), n_runs[a:b].astype(np.uint32), d, times[p:q].astype(np.uint32)]
                empty = [pa.array([None], pa.list_(k)) for k in (id_kind, pa.bool_(), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([part[a]], pa.int64()), pa.array([chunk], pa.int64()), *(pa.array([pack(x)], pa.binary()) for x in arrays), *empty], names=names)
            whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            none = [pa.array([None], pa.binary())] * len(_MODEL + _RUNS)
            yield pa.RecordBatch.from_arrays([pa.array([-1 - chunk], pa.int64()), pa.array([chunk], pa.int64()), *none, whole(ids), whole(pa.array(~usable.astype(bool))), whole(pa.array(size, pa.int64()))], names=names)

    binary = ", ".join(f"{c} binary" for c in [*_MODEL, *_RUNS])
    return docs.mapInArrow(run, f"_part bigint, _chunk bigint, {binary}, _ids array<{kind}>, _held array<boolean>, _tokens array<bigint>")


class Part:
    """The words of a part (hashes in order), their kinds (a word in a restaurant) and the runs of each chunk (a kind in a document)."""

    def __init__(self, number: int, words, per_word, rest, train, chunks: list[tuple]):
        self.number, self.words, self.per_word, self.rest, self.train, self.chunks = number, words, per_word, rest, train, chunks
        self.of = np.repeat(np.arange(len(words)), per_word)  # word of each kind

    @classmethod
    def merged(cls, number: int, pieces: list[tuple]) -> Part:
        """pieces: (chunk, raw columns) of one part."""
        words, kinds, train, ragged = [], [], [], []
        for chunk, raw in pieces:
            w, n = np.cumsum(unpack(raw[0], np.uint64), dtype=np.uint64), unpack(raw[1], np.uint32)
            words.append(w)
            kinds.append((np.repeat(np.arange(len(w)), n), unpack(raw[2], np.uint32)))
            train.append(unpack(raw[3], np.uint32))
            ragged.append((chunk, *raw[4:7]))
        every, number_of = np.unique(np.concatenate(words), return_inverse=True)
        cut = np.append(0, np.cumsum([len(w) for w in words]))
        keys = [number_of[a:b].astype(np.uint64)[of] << _U(CONTEXT_BITS) | rest for a, b, (of, rest) in zip(cut, cut[1:], kinds, strict=False)]
        kind, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, np.concatenate(train), len(kind)).astype(np.int64)
        cut = np.append(0, np.cumsum([len(k) for k in keys]))
        chunks = [(c, place[a:b].astype(np.uint32), *x) for a, b, (c, *x) in zip(cut, cut[1:], ragged, strict=False)]
        return cls(number, every, np.bincount((kind >> _U(CONTEXT_BITS)).astype(np.int64), minlength=len(every)), (kind & _U((1 << CONTEXT_BITS) - 1)).astype(np.uint32), total, chunks)

    COLUMNS = "_part bigint, _words binary, _per_word binary, _rest binary, _train binary, _chunks array<bigint>, _kinds array<binary>, _runs array<binary>, _docs array<binary>, _times array<binary>"

    def row(self) -> dict:
        order = list(zip(*self.chunks, strict=True))
        return {"_part": self.number, "_words": pack(np.diff(self.words, prepend=_U(0))), "_per_word": pack(self.per_word.astype(np.uint32)), "_rest": pack(self.rest), "_train": pack(self.train), "_chunks": list(order[0]), "_kinds": [pack(np.diff(k, prepend=np.uint32(0))) for k in order[1]], "_runs": list(order[2]), "_docs": list(order[3]), "_times": list(order[4])}

    @classmethod
    def of_row(cls, r: dict, runs: bool = False) -> Part:
        chunks = list(zip(r["_chunks"], r["_kinds"], r["_runs"], r["_docs"], r["_times"], strict=True)) if runs else []
        return cls(r["_part"], np.cumsum(unpack(r["_words"], np.uint64), dtype=np.uint64), unpack(r["_per_word"], np.uint32), unpack(r["_rest"], np.uint32), unpack(r["_train"], np.int64), chunks)


def _parts(packed: DataFrame) -> DataFrame:
    """One row for each part, and the chunks' rows as they are."""
    ids, names = packed.schema["_ids"].dataType.simpleString(), [x.split()[0] for x in Part.COLUMNS.split(", ")]
    facts = ["_ids", "_held", "_tokens"]

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, number, kind = [], key[0].as_py(), None
        for b in batches:
            at, kind = b.schema.get_field_index, b.schema.field("_ids").type
            for i in range(b.num_rows):
                if number < 0:
                    none = [pa.array([None], t) for t in [pa.binary()] * 4]
                    lists = [pa.array([None], pa.list_(pa.binary()))] * 4
                    yield pa.RecordBatch.from_arrays([b.column(at("_part"))[i : i + 1], *none, pa.array([[b.column(at("_chunk"))[i].as_py()]], pa.list_(pa.int64())), *lists, *(b.column(at(c)).slice(i, 1) for c in facts)], names=[*names, *facts])
                else:
                    pieces.append((b.column(at("_chunk"))[i].as_py(), [b.column(at(c))[i].as_py() for c in _MODEL + _RUNS]))
        if pieces:
            row = Part.merged(number, sorted(pieces, key=lambda x: x[0])).row()
            types = [pa.int64(), *[pa.binary()] * 4, pa.list_(pa.int64()), *[pa.list_(pa.binary())] * 4]
            yield pa.RecordBatch.from_arrays([*(pa.array([row[c]], t) for c, t in zip(names, types, strict=True)), *(pa.array([None], t) for t in (kind, pa.list_(pa.bool_()), pa.list_(pa.int64())))], names=[*names, *facts])

    return packed.groupBy("_part").applyInArrow(merge, f"{Part.COLUMNS}, _ids {ids}, _held array<boolean>, _tokens array<bigint>")


# ---------------------------------------------------------------- seating


def stirling(d: float, most: int = EXACT) -> np.ndarray:
    """log S(c, t): in how many ways, weighed by a discount of d, c customers fill t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0
    t = np.arange(1, most + 1)
    for c in range(1, most):
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], np.log(np.maximum(c - d * t, 1e-300)) + out[c, 1:])
    return out


def seat(c: np.ndarray, others: np.ndarray, p: np.ndarray, d: float, theta: float, rng: np.random.Generator, log_s: np.ndarray) -> np.ndarray:
    """Tables of dishes with c customers each, drawn given the restaurants' other tables and the parent's probabilities."""
    t = np.minimum(c, 1).astype(np.int64)
    some = np.flatnonzero(c > 1)
    if not len(some):
        return t
    some = some[np.argsort(np.minimum(c[some], EXACT), kind="stable")]
    sizes = np.minimum(c[some], EXACT)
    cut = [*_firsts(sizes).tolist(), len(sizes)]
    for a, b in zip(cut, cut[1:], strict=False):
        k = int(sizes[a])
        for s in range(a, b, max(1, (1 << 20) // k)):
            i = some[s : min(b, s + max(1, (1 << 20) // k))]
            weight = np.log((theta + d * (others[i, None] + np.arange(k))).astype(np.float32)) + np.log(p[i]).astype(np.float32)[:, None]
            np.cumsum(weight, 1, out=weight)
            weight += log_s[k, 1 : k + 1].astype(np.float32)
            weight -= np.log(rng.standard_exponential(weight.shape, np.float32) + np.float32(1e-30))
            t[i] = weight.argmax(1) + 1
    i, j = some[c[some] > EXACT], EXACT
    while len(i):  # further customers by the seating rule, in blocks
        n = np.minimum(c[i] - j, max(1, j // 16))
        new = (theta + d * (others[i] + t[i])) * p[i]
        t[i] += rng.binomial(n, np.clip(new / (new + np.maximum(j - d * t[i], 1e-9)), 0, 1))
        j += max(1, j // 16)
        i = i[c[i] > j]
    return t


def discount(once: float, twice: float) -> float:
    """From how many have one customer and two."""
    return float(np.clip(once / (once + 2 * twice), 0.05, 0.95)) if once else 0.5


class World:
    """What all parts know: restaurants' customers and tables, totals, discounts, and the words that several parts share."""

    def __init__(self):
        self.customers = np.zeros(1 << CONTEXT_BITS, np.int64)
        self.tables = np.zeros((1, 1 << CONTEXT_BITS), np.int64)
        self.train = self.vocabulary = 0
        self.d = self.d_root = 0.5
        self.root = np.zeros((1, 2))  # customers and tables of the parent, of each sample
        self.hot: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}  # tokens, and customers and tables at the parent of each sample

    def base(self, c: np.ndarray) -> np.ndarray:
        return (c + 1) / (self.train + self.vocabulary + 1)

    def parent(self, k: int, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        n, t = self.root[k]
        return (customers - self.d_root * tables + (THETA_ROOT + self.d_root * t) / (self.vocabulary + 1)) / (THETA_ROOT + n)


def sweeps(part: Part, world: World, burn: int, samples: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """After burn sweeps, of each sample: tables of each kind, and at the parent customers and tables of each word."""
    rng = np.random.default_rng([20240511, part.number, burn, samples])
    log_s, log_root = stirling(world.d), stirling(world.d_root)
    seen = part.train > 0
    c, rest, of = part.train[seen], part.rest[seen], part.of[seen]
    tokens_of = np.bincount(part.of, part.train, len(part.words))
    hot = world.hot.get(int(part.words.view(np.int64)[0])) if len(part.words) == 1 else None
    p = world.base(tokens_of if hot is None else np.full(1, float(hot[0])))
    tables, at_root, kinds = np.minimum(c, 1), np.minimum(tokens_of, 1).astype(np.int64), np.zeros(len(seen), np.int64)
    for k in range(burn + samples):
        tables = seat(c, np.maximum(world.tables[0][rest].astype(np.int64) - tables, 0), p[of], world.d, THETA, rng, log_s)
        customers = np.bincount(of, tables, len(part.words)).astype(np.int64)
        at_root = seat(customers, np.maximum(world.root[0][1] - at_root, 0), np.full(len(customers), 1 / (world.vocabulary + 1)), world.d_root, THETA_ROOT, rng, log_root)
        if hot is None and world.root[0][0]:
            p = np.maximum(world.parent(0, customers, at_root), 1e-300)
        if k >= burn:
            kinds[seen] = tables
            yield kinds.copy(), customers, at_root


def _told(parts: DataFrame, values: int, tell) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sums over all parts: tell(part) yields (block, keys, values each), and what tasks say of a block is added by key.
    Blocks of restaurants, of scalars and of shared words: a bounded number of rows reaches the driver."""
    schema = "_block int, _keys binary, _values binary"

    def added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.stack([np.bincount(place, np.concatenate([v[i] for _, v in held]).astype(np.float64), len(keys)) for i in range(values)]).astype(np.int64)

    def row(block: int, keys: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([pack(np.diff(keys, prepend=_U(0)))], pa.binary()), pa.array([pack(total.ravel())], pa.binary())], names=["_block", "_keys", "_values"])

    def unrow(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k, v in zip(b.column(1), b.column(2), strict=True):
            yield np.cumsum(unpack(k.as_py(), np.uint64), dtype=np.uint64), unpack(v.as_py(), np.int64).reshape(values, -1)

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            for i in range(b.num_rows):
                for block, keys, total in tell(Part.of_row(b.slice(i, 1).to_pylist()[0])):
                    if len(keys):
                        held[block] = [added([*held.get(block, []), (keys, total)])]
        for block, [(keys, total)] in held.items():
            yield row(block, keys, total)

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            held = [added([*held, *unrow(b)])]
        yield row(key[0].as_py(), *held[0])

    model = parts.where("_part >= 0").selectExpr("_part", "_words", "_per_word", "_rest", "_train", "cast(array() as array<bigint>) as _chunks", *[f"cast(array() as array<binary>) as {c}" for c in ("_kinds", "_runs", "_docs", "_times")])
    rows = model.mapInArrow(run, schema).groupBy("_block").applyInArrow(add, schema).collect()
    return {r["_block"]: next(unrow(pa.RecordBatch.from_pylist([r.asDict()], pa.schema([("_block", pa.int32()), ("_keys", pa.binary()), ("_values", pa.binary())])))) for r in rows}


def _by_restaurant(rest: np.ndarray, *values: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    sums = np.stack([np.bincount(rest, v, 1 << CONTEXT_BITS) for v in values]).astype(np.int64)
    there = np.flatnonzero(sums.any(0))
    cut = np.searchsorted(there, np.arange(_BLOCKS + 1) << (CONTEXT_BITS - 6))
    for block, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
        yield block, there[a:b].astype(np.uint64), sums[:, there[a:b]]


def _whole(told: dict, values: int) -> np.ndarray:
    out = np.zeros((values, 1 << CONTEXT_BITS), np.int64)
    for block, (keys, sums) in told.items():
        if block < _BLOCKS:
            out[:, keys.astype(np.int64)] = sums
    return _narrow(out)


def _narrow(x: np.ndarray) -> np.ndarray:
    """As 32-bit numbers where they fit; every worker holds a copy."""
    return x.astype(np.int32) if x.size == 0 or x.max() < 1 << 31 else x


def _scalars(told: dict, n: int, values: int) -> np.ndarray:
    out = np.zeros((n, values), np.int64)
    if _SCALARS in told:
        keys, sums = told[_SCALARS]
        out[keys.astype(np.int64)] = sums.T
    return out


def learn(parts: DataFrame, shared: int) -> tuple[World, World]:
    """parts: a saved table; shared: the number of the first part that has one word only, with other parts.  What the last
    sweeps were drawn with, and what they made."""
    world = World()

    def count(part: Part):
        c, hot = part.train, part.number >= shared
        yield from _by_restaurant(part.rest, c, c > 0)
        by_word = np.bincount(part.of, c, len(part.words)).astype(np.int64)
        scalars = [c.sum(), 0 if hot else (by_word > 0).sum(), (c == 1).sum(), (c == 2).sum()]
        yield _SCALARS, np.arange(4, dtype=np.uint64), np.array([scalars, [0] * 4])
        if hot:
            yield _HOT, part.words, np.stack([by_word, by_word])

    told = _told(parts, 2, count)
    sums = _whole(told, 2)
    world.customers, world.tables = sums[0], sums[1:]  # one table for each kind at first
    world.train, world.vocabulary, once, twice = _scalars(told, 4, 2)[:, 0].tolist()
    world.d = discount(once, twice)
    for word, (n, _) in _shared(told):
        world.hot[word] = (n, np.zeros(1), np.zeros(1))
        world.vocabulary += n > 0
    known = world
    for burn, samples in ((BURN, 1), (1, SAMPLES)):
        known, world = world, _sampled(parts, shared, world, burn, samples)
    return known, world


def _shared(told: dict) -> list[tuple[int, list[int]]]:
    return list(zip(told[_HOT][0].view(np.int64).tolist(), told[_HOT][1].T.tolist(), strict=True)) if _HOT in told else []


def _sampled(parts: DataFrame, shared: int, known: World, burn: int, samples: int) -> World:
    """The world with the tables of these sweeps, which start from what is known."""
    told_all = parts.sparkSession.sparkContext.broadcast(known)  # restaurants: a fixed number; shared words: few

    def sweep(part: Part):
        drawn = list(sweeps(part, told_all.value, burn, samples))
        yield from _by_restaurant(part.rest, *(t for t, _, _ in drawn))
        if part.number >= shared:
            yield _HOT, part.words, np.stack([n for _, n, _ in drawn])
        else:
            yield _SCALARS, np.arange(4, dtype=np.uint64), np.array([[n.sum(), s.sum(), (n == 1).sum(), (n == 2).sum()] for _, n, s in drawn])

    told = _told(parts, samples, sweep)
    told_all.destroy()
    world = copy.copy(known)
    world.tables, totals, found = _whole(told, samples), _scalars(told, 4, samples), _shared(told)
    if not known.root[0].any():
        world.d_root = discount(*totals[2:, 0].tolist())
    world.root, world.hot = totals[:2].T.astype(float), {w: (n, np.zeros(samples), np.zeros(samples)) for w, (n, *_) in known.hot.items()}
    rng, log_root, n = np.random.default_rng(20240512), stirling(world.d_root), len(found)
    for k in range(samples if n else 0):
        customers = np.array([x[k] for _, x in found])
        tables = seat(customers, np.full(n, world.root[k, 1]), np.full(n, 1 / (world.vocabulary + 1)), world.d_root, THETA_ROOT, rng, log_root)
        world.root[k] += customers.sum(), tables.sum()
        for (w, _), c, t in zip(found, customers.tolist(), tables.tolist(), strict=True):
            world.hot[w][1][k], world.hot[w][2][k] = c, t
    return world


def _probabilities(part: Part, known: World, world: World) -> tuple[np.ndarray, np.ndarray]:
    """(mean predictive probability of each kind, tokens of its word in training).  known: what the last sweeps were drawn with."""
    tokens_of = np.bincount(part.of, part.train, len(part.words))
    hot = world.hot.get(int(part.words.view(np.int64)[0])) if len(part.words) == 1 else None
    p = np.zeros(len(part.rest))
    for k, (tables, customers, at_root) in enumerate(sweeps(part, known, 1, SAMPLES)):
        parent = world.parent(k, customers if hot is None else hot[1][k : k + 1], at_root if hot is None else hot[2][k : k + 1])
        total, open_ = world.customers[part.rest], world.tables[k][part.rest]
        p += (part.train - world.d * tables + (THETA + world.d * open_) * parent[part.of]) / (THETA + total)
    return p / SAMPLES, (tokens_of if hot is None else np.full(1, float(hot[0])))[part.of]


def score(df: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: the id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    usable: which ids (column _id) are learned from; held_out: all others.  base_score: log10 probability by add-one unigrams.
    """
    docs = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text")).withColumn("_usable", F.coalesce(usable, F.lit(True)))
    n, hot = _deal(docs)
    parts = save(_parts(_packed(docs, n, hot)), "token-parts")
    known, world = learn(parts, n)
    told = parts.sparkSession.sparkContext.broadcast((known, world))
    kind = parts.schema["_ids"].dataType.simpleString()
    names = ["_chunk", "_docs", "_score", "_base", "_known", "_ids", "_held", "_tokens"]

    def sums(batches):
        known, world = told.value
        for b in batches:
            for i in range(b.num_rows):
                part = Part.of_row(b.slice(i, 1).to_pylist()[0], runs=True)
                p, tokens_of = _probabilities(part, known, world)
                logs = np.log10(p), np.log10(world.base(tokens_of)), (tokens_of > 0).astype(np.float64)
                for chunk, kinds, n_runs, docs_, times in part.chunks:
                    at = np.repeat(np.cumsum(unpack(kinds, np.uint32), dtype=np.uint32), unpack(n_runs, np.uint32))
                    doc, n_times = np.cumsum(unpack(docs_, np.uint32), dtype=np.uint32), unpack(times, np.uint32)
                    there = np.unique(doc)
                    columns = [np.bincount(doc, n_times * x[at])[there] for x in logs]
                    whole = [np.rint(columns[0] / STEP).astype(np.int64), np.rint(columns[1] / STEP_BASE).astype(np.int64), columns[2].astype(np.uint32)]
                    raw = [pack(np.diff(there, prepend=np.uint32(0))), pack(-whole[0]), pack(-whole[1]), pack(whole[2])]
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *(pa.array([x], pa.binary()) for x in raw)], names=names[:5])

    binary = ", ".join(f"{c} binary" for c in names[1:5])
    partial = parts.where("_part >= 0").drop("_ids", "_held", "_tokens").mapInArrow(sums, f"_chunk bigint, {binary}")
    facts = parts.where("_part < 0").select(F.col("_chunks")[0].alias("_chunk"), "_ids", "_held", "_tokens")
    both = partial.selectExpr("*", f"cast(null as {kind}) as _ids", "cast(null as array<boolean>) as _held", "cast(null as array<bigint>) as _tokens").unionByName(facts.selectExpr("_chunk", *[f"cast(null as binary) as {c}" for c in names[1:5]], "_ids", "_held", "_tokens"))
    train = world.train

    def gather(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, fact, late = None, None, []
        for b in batches:
            at = b.schema.get_field_index
            for i in range(b.num_rows):
                if b.column(at("_docs"))[i].is_valid:
                    late.append([b.column(at(c))[i].as_py() for c in names[1:5]])
                else:
                    fact = [b.column(at(c))[i].values for c in names[5:]]
                    totals = np.zeros((3, len(fact[0])), np.int64)
            if totals is not None:
                for raw in late:
                    doc = np.cumsum(unpack(raw[0], np.uint32), dtype=np.uint32)
                    for total, x in zip(totals, (unpack(raw[1], np.int64), unpack(raw[2], np.int64), unpack(raw[3], np.uint32)), strict=True):
                        total[doc] += x
                late = []
        n_tokens, found, plain = fact[2].to_numpy(), totals[0] * -STEP, totals[1] * -STEP_BASE
        out = [fact[0], fact[1], fact[2], pa.array(totals[2]), pa.array(np.full(len(n_tokens), train, np.int64)), pa.array(plain), pa.array(found), pa.array(10 ** np.minimum(-found / n_tokens, 300))]
        yield pa.RecordBatch.from_arrays(out, names=["_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    id_kind = docs.schema["_id"].dataType.simpleString()
    out = both.groupBy("_chunk").applyInArrow(gather, f"_id {id_kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")
    return out.withColumnRenamed("_id", id_col)
