"""Operator 4: benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every word sequence that occurs in an item.  A document's words are streamed through it; after each
word it gives the length of the longest suffix that occurs in an item.  Where that length reaches the window, the words
are hit; the suffix links say which items they come from.  Items with fewer words than a window count as a whole.

Items are read in blocks of a bounded number of words, one automaton a block.  The driver holds one block at a time: it is
broadcast, what it hits is written, and it is dropped before the next is read; what the blocks hit is merged by document.
With one block, documents are never shuffled.

Defined cases: words are runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters; a null or wordless text has no
words and no hits; a null or wordless item has no window; equal items are all named; an item with a null id has windows
that hit but is not named; repeated documents each get a row;
with an empty benchmark nothing is hit.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import WORD_BYTES, save, slices

WINDOW = 10
#: Item words in one automaton (about 300 bytes each in an executor's Python).
BLOCK_WORDS = 200_000
_SPACED = np.where(WORD_BYTES == 0, 0x20, WORD_BYTES).astype(np.uint8).tobytes()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_SPACED).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers.

    After add() of all items and finish(): vocabulary (word -> number), and match() over a document.
    """

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: dict[int, set[str | None]] = {}  # state -> items with a prefix that ends here
        self.short: dict[int, list[tuple[int, str | None]]] = {}  # state -> (words, item) of short items that end here
        self.least = window

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        c = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        self.link[q] = c
        return c

    def add(self, item: str | None, text: bytes) -> None:
        words, state = words_of(text), 0
        states = []
        for x in words:
            state = self._extend(state, self.vocabulary.setdefault(x, len(self.vocabulary)))
            states.append(state)
        if not words:
            return
        if len(words) < self.window:
            self.short.setdefault(state, []).append((len(words), item))
            self.least = min(self.least, len(words))
        else:
            for s in states[self.window - 1 :]:
                self.ends.setdefault(s, set()).add(item)

    def finish(self) -> SuffixAutomaton:
        order = sorted(range(len(self.next)), key=self.length.__getitem__)
        # A state's items are its own and those of the states whose links lead to it; only states that hold a window matter.
        for s in reversed(order):
            p = self.link[s]
            if p > 0 and self.length[p] >= self.window and s in self.ends:
                self.ends.setdefault(p, set()).update(self.ends[s])
        # top: the state that holds the last `window` words; whole: short items that are suffixes, through the links.
        self.top, self.whole = [0] * len(self.next), [()] * len(self.next)
        for s in order[1:]:
            p = self.link[s]
            self.top[s] = self.top[p] if self.length[p] >= self.window else s
            self.whole[s] = tuple(self.short.get(s, ())) + self.whole[p]
        return self

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans of words (start, end) and the items whose windows occur."""
        ids = list(map(self.vocabulary.get, words))
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        known = np.frombuffer(bytes(x is not None for x in ids), np.uint8)
        edges = np.flatnonzero(np.diff(known, prepend=0, append=0))
        nxt, link, length, window = self.next, self.link, self.length, self.window
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a < self.least:  # a match never crosses a word that no item has
                continue
            s = n = 0
            for i in range(a, b):
                w = ids[i]
                while s and w not in nxt[s]:
                    s = link[s]
                    n = length[s]
                s = nxt[s].get(w, 0)
                n = n + 1 if s else 0
                if n >= window:
                    items |= self.ends.get(self.top[s], set())
                    spans.append((i + 1 - n, i + 1))
                for m, item in self.whole[s]:
                    if m <= n:
                        items.add(item)
                        spans.append((i + 1 - m, i + 1))
        items.discard(None)
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _n_blocks(benchmark: DataFrame, text_col: str, block_words: int) -> int:
    # No text has more words than half its bytes, rounded up.
    total = benchmark.agg(F.coalesce(F.sum((F.octet_length(F.col(text_col).cast("string")) + 1) / 2), F.lit(0))).first()[0]
    return max(1, -(-int(total) // block_words))


def _block(benchmark: DataFrame, item_col: str, text_col: str, n: int, k: int) -> list[tuple[str | None, str]]:
    """Block k of n of the items: what the driver holds and broadcasts at once."""
    items = benchmark.select(F.col(item_col).cast("string").alias("_item"), F.col(text_col).cast("string").alias("_text")).where("_text is not null")
    return [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(n)) == k).collect()]


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row for each row of docs: id, n_words, n_hit, n_items, items (sorted as strings), spans (hit words, array of (start, end)).

    keep: further columns of docs that pass through unchanged (then their names must not be those of the results).
    """
    keep = keep or []
    text = text_col if text_col in keep else "_text"  # a text that is kept travels once
    kept = docs.select(F.col(id_col).alias("_id"), *([] if text in keep else [F.col(text_col).cast("string").alias("_text")]), *keep)
    result = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<a:bigint,b:bigint>>"
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_text"] + [result])
    n_blocks = _n_blocks(benchmark, item_text_col, block_words)
    broadcast = docs.sparkSession.sparkContext.broadcast

    def scan(shared, text=text):
        def run(batches):
            automaton = _built(shared, window)
            for rows, data, offsets in slices(batches, text):
                raw, out = data.tobytes(), []
                for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
                    words = words_of(raw[a:b])
                    spans, items = automaton.match(words)
                    out.append((len(words), sum(y - x for x, y in spans), sorted(items), [{"a": x, "b": y} for x, y in spans]))
                columns = [c for c, name in zip(rows.columns, rows.schema.names, strict=True) if name != "_text"]
                names = [name for name in rows.schema.names if name != "_text"]
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=[*names, "n_words", "n_hit", "items", "spans"])

        return run

    if n_blocks == 1:
        found = kept.mapInArrow(scan(broadcast(_block(benchmark, item_col, item_text_col, 1, 0))), schema)
    else:
        # Number the rows once; the first block's rows are all rows, those of the others only the hits.
        numbered = save(kept.withColumn("_row", F.monotonically_increasing_id()), "decontaminate")
        parts = []
        for k in range(n_blocks):
            block = broadcast(_block(benchmark, item_col, item_text_col, n_blocks, k))
            rows = numbered if not k else numbered.select("_row", F.col("_id"), F.col(text).alias("_text"))
            part = rows.mapInArrow(scan(block, "_text" if k else text), ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text"] + [result]))
            parts.append(save(part if not k else part.where("n_hit > 0").select("_row", "items", "spans"), "decontaminate"))
            block.destroy()
        every = parts[0].where("n_hit > 0").select("_row", "items", "spans")
        for part in parts[1:]:
            every = every.unionByName(part)
        grouped = every.groupBy("_row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
        joined = F.expr(
            "aggregate(spans, cast(array() as array<struct<a:bigint,b:bigint>>), (s, x) -> if(size(s) > 0 and element_at(s, -1).b >= x.a,"
            " concat(slice(s, 1, size(s) - 1), array(named_struct('a', element_at(s, -1).a, 'b', greatest(element_at(s, -1).b, x.b)))), concat(s, array(x))))"
        )
        hits = grouped.select("_row", F.col("items").alias("_items"), joined.alias("_spans"))
        found = parts[0].join(hits, "_row", "left").withColumns({"items": F.coalesce("_items", "items"), "spans": F.coalesce("_spans", "spans")})
        found = found.withColumn("n_hit", F.expr("aggregate(spans, 0L, (s, x) -> s + x.b - x.a)"))
    columns = [*([] if id_col in keep else [F.col("_id").alias(id_col)]), *keep, "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items", "spans"]
    return found.select(*columns)


_last: list = []


def _built(shared, window: int) -> SuffixAutomaton:
    """The automaton of a broadcast block; a worker keeps the last one it built."""
    items = shared.value
    digest = hashlib.sha256(repr((window, items)).encode()).digest()
    if not _last or _last[0] != digest:
        automaton = SuffixAutomaton(window)
        for item, text in items:
            automaton.add(item, text.encode())
        _last[:] = [digest, automaton.finish()]
    return _last[1]


def contaminated(coverage: float = 0.0) -> Column:
    """By coverage limit: hit words above that share of the words."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") >= F.lit(coverage) * F.col("n_words"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.0, **options) -> DataFrame:
    """The rows of docs, with their columns, whose share of hit words is not above the coverage limit."""
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)])
    at = lambda c: f"_c{names.index(c)}"  # noqa: E731  private names, since results are added
    found = find(plain, benchmark, id_col=at(options.pop("id_col", "doc_id")), text_col=at(options.pop("text_col", "text")), keep=plain.columns, **options)
    return found.where(~contaminated(coverage)).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])


def cut_spans(df: DataFrame, spans_col: str = "spans", text_col: str = "text") -> DataFrame:
    """Remove the hit words with what stands between them from the text of each row of find(keep=[text_col])."""
    names = df.columns

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(names.index(text_col)).to_pylist(), batch.column(names.index(spans_col)).to_pylist(), strict=True):
                out.append(without(text, [(s["a"], s["b"]) for s in spans or []]))
            columns = list(batch.columns)
            columns[names.index(text_col)] = pa.array(out, batch.schema.field(names.index(text_col)).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, df.schema)


def without(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    if not text or not spans:
        return text
    raw = text.encode()
    low = WORD_BYTES[np.frombuffer(raw, np.uint8)] != 0
    edges = np.flatnonzero(np.diff(low.astype(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, raw[at:]]).decode()
