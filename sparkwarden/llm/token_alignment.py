"""Operator 12: alignment of the tokens that two tokenizers make of the same text, and corpus-wide counts of what is linked.

Both tokenizers cut space + text.  Where a token of each ends at the same byte, a group ends.  Groups are found by diagonal
run skipping: as long as token i of one ends where token i + shift of the other does, groups are one to one, and a run of
them is jumped by comparing slices of the two arrays of ends that double in length, then narrowing down by halves; where
the ends part, the group is resolved by moving on in whichever text is behind, and the shift is taken from where they meet.

The tokens themselves come from a cache of units: stretches that begin with a space at which both tokenizers always begin a
token.  A unit is encoded by the two libraries when it is met first; ids of a slice of text are gathered from the cache.

Linked pairs of ids are counted by documents: in each task, then by ranges of pairs.  There are at most as many pairs as
the two vocabularies allow, however large the corpus, so the counts go back to the documents as broadcasts, in blocks of
`BLOCK_PAIRS` pairs (one block unless there are more); what a document has in each block adds up.

Defined cases: a null or empty text, and one that a tokenizer does not give back byte by byte, has no tokens: numbers are 0
and the digest is ''; a text without spaces is one unit, however long; repeated rows count as documents of their own; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import pack, save, slices, unpack

#: Units whose ids are kept, in each of two generations; changes speed and no result.
CACHE_UNITS, CACHE_BYTES = 300_000, 64
#: Pairs of ids in one broadcast (12 bytes each), and parts by which they are counted.
BLOCK_PAIRS, PARTS = 8_000_000, 64
_SPACE = "▁"


class _Units(dict):
    """Unit of text -> its number in the two ragged arrays of ids (flat ids and ends)."""

    def __init__(self, encode, older: _Units | None = None):
        self.encode, self.older = encode, older
        self.flat, self.ends, self.good = (array("H"), array("H")), (array("q", [0]), array("q", [0])), bytearray()
        if older is not None:
            older.older = None

    def ids(self, k: int) -> tuple[array, array, bool]:
        return *(f[e[k] : e[k + 1]] for f, e in zip(self.flat, self.ends, strict=True)), bool(self.good[k])

    def learn(self, units: list[bytes]) -> None:
        """Encode what is met first, all at once; what the older generation has moves here."""
        new = list(set(units).difference(self))
        known = [None if self.older is None else self.older.get(u) for u in new]
        made = iter(self.encode([u for u, k in zip(new, known, strict=True) if k is None]))
        for unit, k in zip(new, known, strict=True):
            *both, good = next(made) if k is None else self.older.ids(k)
            for flat, ends, ids in zip(self.flat, self.ends, both, strict=True):
                flat.extend(ids)
                ends.append(len(flat))
            self[unit] = len(self.good)
            self.good.append(good)

    def forget(self, units: list[bytes]) -> None:
        """Long units are kept for their slice only."""
        for unit in {u for u in units if len(u) > CACHE_BYTES}:
            del self[unit]


class Pair:
    """Two tokenizers: a byte-level BPE file of the tokenizers library and a sentencepiece model."""

    def __init__(self, first: str, second: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(first, encoding="utf-8") as f:
            spec = json.load(f)
        library = Tokenizer.from_file(first)
        library.encode_special_tokens = True
        # Byte-level files spell bytes as printable characters: itself where printable, else from U+0100 on.
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(printable)]
        spelled = {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(rest)}
        byte_of = {c: b for b, c in spelled.items()}
        added = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        # Where each merge makes the next id, ids are ranks and a plain merger of ranks gives the library's ids.
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        in_order = all(spec["model"]["vocab"].get(x + y) == 256 + i for i, (x, y) in enumerate(merges)) and spec.get("normalizer") is None
        if in_order:
            import public_tokenizers

            plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.first = plain.encode_ordinary
        else:
            self.first = lambda text: library.encode(text, add_special_tokens=False).ids
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        as_byte = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace(_SPACE, " ").encode()
        size = max(library.get_vocab_size(), max(ranks.values()) + 1)
        self.bytes = [b""] * size, [as_byte(p) for p in pieces]
        for token, i in ranks.items():
            self.bytes[0][i] = token
        self.lengths = [np.array([len(x) for x in table], np.int64) for table in self.bytes]
        self.cut = not any(_SPACE in p.lstrip(_SPACE) for p in pieces)  # no piece goes on behind a space
        names = [b"%d%s" % (i, sep) for i in range(size) for sep in (b",", b"|")] + [b"%d%s" % (i, sep) for i in range(len(pieces)) for sep in (b",", b";")]
        self.names, self.second_names = pa.array(names, pa.binary()), 2 * size
        self.units = _Units(self.encode)

    def encode(self, units: list[bytes]) -> Iterator[tuple[list[int], list[int], bool]]:
        """Ids of texts that begin with a space (the second tokenizer adds its own), and whether both give it back."""
        texts = [u.decode("utf-8", "replace") for u in units]
        one, two = map(self.first, texts), self.second.encode([t[1:] for t in texts], num_threads=1) if texts else []
        bytes_a, bytes_b = (table.__getitem__ for table in self.bytes)
        for unit, a, b in zip(units, one, two, strict=True):
            yield a, b, b"".join(map(bytes_a, a)) == unit == b"".join(map(bytes_b, b))

    def unit_starts(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where units begin: at the texts' begins, and at spaces after another character where the white space in front, if
        any, ends (what follows is none), so that both tokenizers begin a token there."""
        at = np.zeros(len(data), bool)
        if self.cut and len(data) > 2:
            before, after = data[:-2], data[2:]
            word = (after > 0x20) & (after < 0x7F) | (after > 0xC2) & ((after < 0xE1) | (after > 0xE3))  # E1-E3 may begin wide spaces
            at[1:-1] = (data[1:-1] == 0x20) & (before != 0x20) & ((before > 0x20) & (before < 0x7F) | word)
        at[begins[1:] - 1] = False  # a text's last space is not a unit of its own
        at[begins] = True
        return np.flatnonzero(at)


@lru_cache(1)
def pair(first: str, second: str) -> Pair:
    return Pair(first, second)


def irregular(a: list[int], b: list[int]) -> list[tuple[int, int, int, int]]:
    """Ends of tokens of the same bytes, rising; the last are equal.  Groups that are not one to one, as (first token, last
    token) in a and in b."""
    n, i, shift, out = len(a), 0, 0, []
    while i < n:
        step = 4
        while i < n and a[i : i + step] == b[i + shift : i + shift + step]:
            i, step = i + step, 2 * step
        if i >= n:
            break
        while step := step // 2:
            if a[i : i + step] == b[i + shift : i + shift + step]:
                i += step
        p = i
        q = j = i + shift
        while (x := a[p]) != (y := b[q]):
            if x < y:
                p += 1
            else:
                q += 1
        out.append((i, p, j, q))
        i, shift = p + 1, q - p
    return out


def group_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last token of each group, in a and in b."""
    odd = np.array(irregular(a.tolist(), b.tolist()), np.int64).reshape(-1, 4)
    out = []
    for n, first, last in ((len(a), odd[:, 0], odd[:, 1]), (len(b), odd[:, 2], odd[:, 3])):
        inside = np.zeros(n + 1, np.int32)  # tokens of a group before its last
        np.add.at(inside, first, 1)
        np.add.at(inside, last, -1)
        out.append(np.flatnonzero(np.cumsum(inside[:n]) == 0))
    return out[0], out[1]


def _ragged(index: np.ndarray, flat: array, ends: array) -> tuple[np.ndarray, np.ndarray]:
    """Items of a ragged array at these numbers, and how many each has."""
    values, ends = np.frombuffer(flat, np.uint16) if len(flat) else np.zeros(0, np.uint16), np.frombuffer(ends, np.int64)
    start, size = ends[index], ends[index + 1] - ends[index]
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - start, size)
    return values[place], size


class Aligned:
    """The groups of a slice of texts: ids of both sides, their groups' last tokens, and where each text's groups begin."""

    def __init__(self, two: Pair, data: np.ndarray, offsets: np.ndarray):
        if len(two.units) > CACHE_UNITS:
            two.units = _Units(two.encode, two.units)
        size = np.diff(offsets)
        full = np.flatnonzero(size > 0)
        spaced = np.insert(data, offsets[:-1][full], 0x20)
        begins = offsets[:-1][full] + np.arange(len(full))
        starts = two.unit_starts(spaced, begins)
        raw = spaced.tobytes()
        cuts = [*starts.tolist(), len(raw)]
        units = list(map(raw.__getitem__, map(slice, cuts, cuts[1:])))
        two.units.learn(units)
        number = np.fromiter(map(two.units.__getitem__, units), np.int64, len(units))
        good = np.frombuffer(two.units.good, np.uint8)[number] if len(number) else number
        owner = np.searchsorted(begins, starts, "right") - 1
        bad = np.zeros(len(full), bool)
        bad[owner[good == 0]] = True
        number, owner = number[~bad[owner]], full[owner[~bad[owner]]]
        self.n = len(size)
        self.ids, self.counts = [], []
        for flat, ends in zip(two.units.flat, two.units.ends, strict=True):
            ids, n = _ragged(number, flat, ends)
            self.ids.append(ids)
            self.counts.append(np.bincount(owner, n, self.n).astype(np.int64))  # tokens of each text
        two.units.forget(units)
        ends = [np.cumsum(length[ids]) for length, ids in zip(two.lengths, self.ids, strict=True)]
        self.last = group_ends(*ends)
        self.bytes = ends[0][self.last[0]]
        self.sizes = [np.diff(x, prepend=-1) for x in self.last]
        self.groups = np.searchsorted(self.last[0], np.append(0, np.cumsum(self.counts[0])))  # first group of each text

    def per_text(self, of_group: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(of_group))
        return total[self.groups[1:]] - total[self.groups[:-1]]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pairs of each text, each once and in order; how often each is linked; how many each text has)."""
        na, nb = self.sizes
        n = na * nb
        g = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
        i, j = (self.last[0] - na + 1)[g] + within // nb[g], (self.last[1] - nb + 1)[g] + within % nb[g]
        text = np.repeat(np.arange(self.n), np.diff(self.groups))[g].astype(np.uint64)
        keys = text << np.uint64(32) | self.ids[0][i].astype(np.uint64) << np.uint64(16) | self.ids[1][j].astype(np.uint64)
        keys, times = np.unique(keys, return_counts=True)
        return keys.astype(np.uint32), times.astype(np.uint32), np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=self.n)

    def digests(self, two: Pair) -> list[str]:
        """Of `a1,a2|b1;a3|b2,b3`: decimal ids of each group in order; '' without tokens."""
        (a, b), (na, nb) = self.last, self.sizes
        spot = np.zeros(len(self.ids[0]) + len(self.ids[1]), np.int64)
        final = [np.zeros(len(x), np.int64) for x in self.ids]
        final[0][a], final[1][b] = 1, 1
        spot[np.arange(len(self.ids[0])) + np.repeat(b - nb + 1, na)] = 2 * self.ids[0].astype(np.int64) + final[0]
        spot[np.arange(len(self.ids[1])) + np.repeat(a + 1, nb)] = two.second_names + 2 * self.ids[1].astype(np.int64) + final[1]
        text = two.names.take(pa.array(spot))
        if not len(spot):
            return [""] * self.n
        at, raw = np.frombuffer(text.buffers()[1], np.int32), memoryview(text.buffers()[2])
        cut = np.append(0, np.cumsum(self.counts[0] + self.counts[1]))
        return [hashlib.sha256(raw[at[x] : at[y] - 1]).hexdigest() if y > x else "" for x, y in zip(cut.tolist(), cut[1:].tolist(), strict=False)]


FACTS = ["n_a", "n_b", "n_groups", "n_links"]


def _aligned(docs: DataFrame, first: str, second: str) -> DataFrame:
    """docs: (_id, _text).  One row for each slice of texts: the texts' ids and facts as lists, their pairs packed."""
    kind = docs.schema["_id"].dataType.simpleString()

    def run(batches):
        two, task, n = pair(first, second), TaskContext.get().partitionId(), 0
        for rows, data, offsets in slices(batches):
            x = Aligned(two, data, offsets)
            pairs, times, sizes = x.links()
            facts = [*x.counts, np.diff(x.groups), x.per_text(x.sizes[0] * x.sizes[1]), sizes]
            whole = lambda values: pa.ListArray.from_arrays(pa.array([0, x.n], pa.int32()), values)  # noqa: B023, E731
            columns = [pa.array([f"{task}-{n}"]), whole(rows.column(0)), *(whole(pa.array(f, pa.int64())) for f in facts), whole(pa.array(x.digests(two), pa.string())), pa.array([pack(np.diff(pairs, prepend=np.uint32(0)))], pa.binary()), pa.array([pack(times)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["_slice", "_ids", *FACTS, "_sizes", "groups_sha256", "_pairs", "_times"])
            n += 1

    facts = ", ".join(f"{c} array<bigint>" for c in [*FACTS, "_sizes"])
    return docs.mapInArrow(run, f"_slice string, _ids array<{kind}>, {facts}, groups_sha256 array<string>, _pairs binary, _times binary")


def _pairs_of(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, np.uint32), dtype=np.uint32)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    new = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[new], np.add.reduceat(n, new) if len(k) else n


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(_part, _keys, _counts, _n): in how many documents each linked pair occurs; all pairs of a first id are in one part."""
    schema = "_part int, _keys binary, _counts binary, _n bigint"

    def rows(keys: np.ndarray, counts: np.ndarray, parts: list[int]):
        for p in parts:
            own = slice(None) if len(parts) == 1 else ((keys >> np.uint32(16)) % np.uint32(PARTS)) == p
            k, n = keys[own], counts[own]
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([pack(np.diff(k, prepend=np.uint32(0)))], pa.binary()), pa.array([pack(n)], pa.binary()), pa.array([len(k)], pa.int64())], names=["_part", "_keys", "_counts", "_n"])

    def count(batches):
        keys, counts, held, limit = [], [], 0, 1 << 22
        for b in batches:
            for raw in b.column(0):
                k, n = np.unique(_pairs_of(raw.as_py()), return_counts=True)
                keys.append(k)
                counts.append(n.astype(np.int64))
                held += len(k)
                if held > limit:  # what is held grows with distinct pairs only
                    k, n = _merged(keys, counts)
                    keys, counts, held, limit = [k], [n], len(k), max(limit, 2 * len(k))
        yield from rows(*_merged(keys, counts), list(range(PARTS)))

    def add(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, part = [], [], None
        for b in batches:
            part = b.column(0)[0].as_py()
            keys += [_pairs_of(x) for x in b.column(1).to_pylist()]
            counts += [unpack(x, np.int64) for x in b.column(2).to_pylist()]
            if len(keys) > 64:
                keys, counts = ([x] for x in _merged(keys, counts))
        yield from rows(*_merged(keys, counts), [part])

    return aligned.select("_pairs").mapInArrow(count, schema).groupBy("_part").applyInArrow(add, schema)


def _counted(aligned: DataFrame, block: DataFrame) -> DataFrame:
    """One row for each document: _slice, _place, _id, facts, groups_sha256, n_best and count_sum of the block's pairs."""
    parts = block.orderBy("_part").collect()  # BLOCK_PAIRS pairs at most, or one part
    keys, counts = _merged([_pairs_of(r["_keys"]) for r in parts], [unpack(r["_counts"], np.int64) for r in parts])
    new = np.flatnonzero(np.append(True, (keys[1:] >> np.uint32(16)) != (keys[:-1] >> np.uint32(16)))) if len(keys) else np.zeros(0, np.int64)
    top = np.repeat(np.maximum.reduceat(counts, new), np.diff(np.append(new, len(keys)))) if len(keys) else counts
    shared = aligned.sparkSession.sparkContext.broadcast((keys, counts, counts == top))
    kind = aligned.schema["_ids"].dataType.elementType.simpleString()

    def run(batches):
        keys, counts, best = shared.value
        for b in batches:
            at = b.schema.get_field_index
            for i in range(b.num_rows):
                own, times = _pairs_of(b.column(at("_pairs"))[i].as_py()), unpack(b.column(at("_times"))[i].as_py(), np.uint32).astype(np.int64)
                sizes = b.column(at("_sizes"))[i].values.to_numpy()
                spot = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
                there = keys[spot] == own if len(keys) else np.zeros(len(own), bool)
                text = np.repeat(np.arange(len(sizes)), sizes)[there]
                spot, times = spot[there], times[there]
                total = np.zeros(len(sizes), np.int64)
                np.add.at(total, text, times * counts[spot])
                n_best = np.bincount(text, times * best[spot], len(sizes)).astype(np.int64)
                facts = [b.column(at(c))[i].values for c in ["_ids", *FACTS, "groups_sha256"]]
                name = pa.array([b.column(at("_slice"))[i].as_py()] * len(sizes), pa.string())
                yield pa.RecordBatch.from_arrays([name, pa.array(np.arange(len(sizes)), pa.int64()), *facts, pa.array(n_best), pa.array(total)], names=["_slice", "_place", "_id", *FACTS, "groups_sha256", "n_best", "count_sum"])

    return aligned.mapInArrow(run, f"_slice string, _place bigint, _id {kind}, {', '.join(f'{c} bigint' for c in FACTS)}, groups_sha256 string, n_best bigint, count_sum bigint")


def align(df: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """One row for each row of df: the id, n_a, n_b, n_groups, n_links, n_best (links whose pair is, of those of its first id,
    in the most documents; ties included), count_sum (over links: the documents of the pair), groups_sha256."""
    docs = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    aligned = save(_aligned(docs, first, second), "aligned")
    counts = save(pair_counts(aligned), "pair-counts")
    blocks, held = [[]], 0
    for part, n in sorted(counts.select("_part", "_n").collect()):  # PARTS rows
        if held and held + n > block_pairs:
            blocks, held = [*blocks, []], 0
        blocks[-1].append(part)
        held += n
    done = []
    for block in blocks:
        found = _counted(aligned, counts.where(F.col("_part").isin(block)))
        done.append(found if len(blocks) == 1 else save(found, "aligned-counts"))
    out = done[0]
    for more in done[1:]:
        more = more.select("_slice", "_place", F.col("n_best").alias("_b"), F.col("count_sum").alias("_c"))
        out = out.join(more, ["_slice", "_place"]).withColumns({"n_best": F.col("n_best") + F.col("_b"), "count_sum": F.col("count_sum") + F.col("_c")}).drop("_b", "_c")
    return out.select(F.col("_id").alias(id_col), *FACTS, "n_best", "count_sum", "groups_sha256")


def groups(df: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: the id and its groups in order, each with its end in bytes of space + text and the ids of both sides."""
    docs = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))

    def run(batches):
        two = pair(first, second)
        for rows, data, offsets in slices(batches):
            x = Aligned(two, data, offsets)
            lists = [pa.ListArray.from_arrays(pa.array(np.append(0, last + 1), pa.int32()), pa.array(ids.astype(np.int32))) for last, ids in zip(x.last, x.ids, strict=True)]
            begun = np.append(0, np.cumsum(x.per_text(np.diff(x.bytes, prepend=0))))[:-1]
            ends = pa.array(x.bytes - np.repeat(begun, np.diff(x.groups)), pa.int64())
            flat = pa.StructArray.from_arrays([ends, *lists], ["end", "a", "b"])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(x.groups, pa.int32()), flat)], names=["_id", "groups"])

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"_id {kind}, groups array<struct<end: bigint, a: array<int>, b: array<int>>>").withColumnRenamed("_id", id_col)
