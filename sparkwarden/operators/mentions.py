"""Where known titles are mentioned in running texts: one pass over a text for all titles, the longest match first."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.plans.storage import keep

#: Titles of one broadcast (characters), and what a word is.
BLOCK_CHARACTERS = 8_000_000
_WORD = re.compile(r"[^\W_]+")
_END = ""  # no word is empty, so this key marks a title's end in the trie


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def trie_of(titles: list[tuple[int, str]]) -> dict:
    """Nested dictionaries from word to word; of equal titles the least id counts."""
    root: dict = {}
    for number, title in sorted(titles, reverse=True):
        node = root
        words = words_of(title)
        for w in words:
            node = node.setdefault(w, {})
        if words:
            node[_END] = number
    return root


def found_in(words: list[str], trie: dict) -> list[tuple[int, int, int]]:
    """(first word, end, title) of the longest title that begins at each word."""
    out = []
    for i, w in enumerate(words):
        node, j, best = trie.get(w), i + 1, None
        while node is not None:
            if _END in node:
                best = (i, j, node[_END])
            node = node.get(words[j]) if j < len(words) else None
            j += 1
        if best:
            out.append(best)
    return out


def mentions(texts: DataFrame, titles: DataFrame, text: str, title: str, id_: str, title_id: str, block: int = BLOCK_CHARACTERS) -> DataFrame:
    """(id_, first_word, end_word, title_id, place): the mentions that lie in no longer one, numbered by place in the text.

    Titles are dealt by their first word to blocks of bounded size, each broadcast and looked up by itself; matches that lie
    inside others are dropped after all blocks.  Case and what parts words do not matter; nulls mention nothing.
    """
    known = titles.where(F.col(title).isNotNull() & F.col(title_id).isNotNull()).select(F.col(title_id).cast("bigint").alias("_i"), F.col(title).alias("_t"))
    size = known.agg(F.coalesce(F.sum(F.length("_t") + 8), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // block))
    part = F.pmod(F.xxhash64(F.regexp_extract(F.lower("_t"), r"[\p{L}\p{N}]+", 0)), F.lit(blocks))
    own = texts.select(F.col(id_).alias("_id"), F.col(text).alias("_text"))
    kind = own.schema["_id"].dataType.simpleString()

    def scan(shared):
        def run(batches):
            trie = trie_of(shared.value)
            for b in batches:
                rows = [(k, *m) for k, t in enumerate(b.column(1).to_pylist()) for m in found_in(words_of(t), trie)]
                owner = b.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([owner, *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3))], names=["_id", "first_word", "end_word", "_title"])

        return run

    every = None
    for k in range(blocks):
        shared = texts.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in known.where(part == k).collect()])  # block characters
        found = own.mapInArrow(scan(shared), f"_id {kind}, first_word bigint, end_word bigint, _title bigint")
        found = found if blocks == 1 else keep(found, "mentions")
        every = found if every is None else every.unionByName(found)
    # In order of places, a mention lies in a longer one if an earlier one ends as late: of one text's mentions, no more.
    order = F.array_sort(F.collect_list(F.struct("first_word", (-F.col("end_word")).alias("e"), "_title")))
    zero = F.struct(F.lit(0).cast("bigint").alias("far"), F.array().cast("array<struct<first_word: bigint, end_word: bigint, _title: bigint>>").alias("kept"))

    def step(s, m):
        outside = -m["e"] > s["far"]
        row = F.array(F.struct(m["first_word"].alias("first_word"), (-m["e"]).alias("end_word"), m["_title"].alias("_title")))
        return F.struct(F.greatest(s["far"], -m["e"]).alias("far"), F.when(outside, F.concat(s["kept"], row)).otherwise(s["kept"]).alias("kept"))

    grouped = every.groupBy("_id").agg(F.aggregate(order, zero, step, lambda s: s["kept"]).alias("_m"))
    return grouped.select(F.col("_id").alias(id_), F.posexplode("_m").alias("_p", "_x")).select(id_, "_x.first_word", "_x.end_word", F.col("_x._title").alias(title_id), (F.col("_p") + 1).alias("place"))
