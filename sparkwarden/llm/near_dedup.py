"""Operator 5: near-duplicate documents by Order MinHash and banded alignment.

k-mers are five consecutive words, labelled with how often they have occurred so far.  Each hash function takes the
`MINIMA` smallest labelled k-mers of a text and keeps them in text order: one sketch.  Texts that agree in all sketches
of a band meet in a bucket.  A bucket does not emit its pairs: each member is compared with the bucket's leader, so
candidates grow with the members.  A candidate pair is verified by aligning the two k-mer sequences within a band:
similarity = aligned / (length + length - aligned), an order-sensitive Jaccard similarity, and 0.8 or more links them.

A bucket whose members do not all link to its leader is looser than one class, so its texts go to the next level, with
longer bands and another leader for every bucket, where such texts part and true pairs meet again.  What still met where
a pair failed after the last level is compared exactly: a pair of 0.8 or more shares one of the rarest fifth of its
labelled k-mers, so texts of different classes that share one are compared, leaders first and more of them each round,
until each k-mer's texts are one class or all compared.  Links make classes by connected components.

Texts with equal words are one text from the start (counted map-side), so large groups of copies cost one signature.

Defined cases: null, empty and wordless texts are each a class of their own; a text with fewer than five words is one
k-mer; ids may repeat or be null (the text decides, and equal rows share a class); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.llm.common import bucket_counts, join_unique, mix, save, save_by_key, shingles, slices, word_hashes
from sparkwarden.llm.exact_dedup import rows_that_stay
from sparkwarden.llm.graph import components

K, MINIMA, SIMILARITY = 5, 2, 0.8
#: (sketches in a band, bands) of each level.  At similarity 0.8 a sketch agrees with about 0.64, so a level misses a
#: pair with about 0.0002 and 0.0002.
LEVELS = ((2, 16), (4, 48))
_CHUNK = 4096
#: Bits of a labelled k-mer by which its occurrences are counted (the counts only order the k-mers).
_COUNT_BITS = 20
#: By how much the leaders of a k-mer grow from round to round of the exact comparison.
MORE = 4
_MOST = max(r * b for r, b in LEVELS)
_RNG = np.random.default_rng(20240505)  # its own: draws must not depend on what else a worker has imported
_XOR = _RNG.integers(0, 1 << 63, _MOST, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 63, _MOST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P, _Q, _R = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def labelled(kmers: np.ndarray) -> np.ndarray:
    """k-mers told apart by occurrence: the second 'a b c d e' of a text differs from the first."""
    order = np.argsort(kmers, kind="stable")
    same = kmers[order][1:] == kmers[order][:-1]
    if not same.any():
        return kmers
    first = np.maximum.accumulate(np.where(np.append(False, same), 0, np.arange(len(kmers))))
    seen = np.zeros(len(kmers), np.uint64)
    seen[order] = (np.arange(len(kmers)) - first).astype(np.uint64)
    return np.where(seen > 0, mix(kmers + seen * _R), kmers)  # a first occurrence has the same label in every text


def sketches(kmers: np.ndarray, n: int) -> np.ndarray:
    """Order MinHash: for n hash functions, the smallest labelled k-mers, in text order, as one number each."""
    x = labelled(kmers)
    value, place = [], []
    for at in range(0, len(x), _CHUNK):
        v = (x[None, at : at + _CHUNK] ^ _XOR[:n, None]) * _ODD[:n, None]
        for _ in range(min(MINIMA, v.shape[1])):
            i = v.argmin(1)[:, None]
            value.append(np.take_along_axis(v, i, 1))
            place.append(i + at)
            np.put_along_axis(v, i, np.uint64(0xFFFFFFFFFFFFFFFF), 1)
    value, place = np.hstack(value), np.hstack(place)
    if value.shape[1] > MINIMA:
        place = np.take_along_axis(place, np.argpartition(value, MINIMA - 1, 1)[:, :MINIMA], 1)
    place.sort(1)
    out = np.zeros(n, np.uint64)
    for j in range(place.shape[1]):
        out = mix(out * _P + kmers[place[:, j]])
    return out


def band_keys(kmers: np.ndarray, rows: int, bands: int) -> np.ndarray:
    s = sketches(kmers, rows * bands).reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64) * _Q + np.uint64(rows)
    for j in range(rows):
        out = mix(out * _P + s[:, j])
    return out.view(np.int64)


def signatures(df: DataFrame, rows: int, bands: int) -> DataFrame:
    """df: (..., _text).  The other columns, with _words (digest of the words; null without words) and _bands."""
    names = [c for c in df.columns if c != "_text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "_text"] + ["_words binary", "_bands array<bigint>"])

    def run(batches):
        for rows_, data, offsets in slices(batches):
            hashes, _, _, first = word_hashes(data, offsets)
            digests, keys = [], []
            for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
                w = hashes[a:b]
                digests.append(hashlib.md5(w.tobytes(), usedforsecurity=False).digest() if b > a else None)
                keys.append(band_keys(shingles(w, K), rows, bands) if b > a else np.zeros(0, np.int64))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(flat, pa.int64()))
            columns = [rows_.column(rows_.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.binary()), lists], names=[*names, "_words", "_bands"])

    return df.mapInArrow(run, schema)


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two k-mer sequences by alignment within a band; 0 where it is below least.

    The longest common subsequence is found bit-parallel, a column of the alignment for each k-mer of b; at a similarity
    of least or more no path leaves the band of diagonals that `spare` steps allow, and only its cells count.
    """
    n, m = len(a), len(b)
    if min(n, m) < least * max(n, m):
        return 0.0
    need = least * (n + m) / (1 + least)
    spare = int(n + m - 2 * need + 1e-9)
    short = min(n, m)
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[n - short :][::-1][: short - head] != b[m - short :][::-1][: short - head])
    tail = int(differ[0]) if len(differ) else short - head
    a, b, common = a[head : n - tail], b[head : m - tail], head + tail
    if common + min(len(a), len(b)) < need:
        return 0.0
    if len(a) and len(b):
        x, nx = np.unique(a, return_counts=True)
        y, ny = np.unique(b, return_counts=True)
        _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        if common + int(np.minimum(nx[i], ny[j]).sum()) < need:
            return 0.0
        common += banded_lcs(a.tolist(), b.tolist(), spare)
    return common / (n + m - common) if common >= need - 1e-9 else 0.0


def banded_lcs(a: list[int], b: list[int], spare: int) -> int:
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, width = full, (1 << 2 * spare + 1) - 1
    for j, y in enumerate(b):
        if match := places.get(y):
            band = width << j - spare if j >= spare else width >> spare - j
            if u := v & match & band:
                v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """pairs: (a, b, ...), a and b of _words; texts: (_words, _text), in buckets of _words.  Adds similarity (0 below least)."""
    mine = texts.select(F.col("_words").alias("a"), F.col("_text").alias("_ta"))
    other = texts.select(F.col("_words").alias("b"), F.col("_text").alias("_tb"))
    other = pairs.groupBy("b").agg(F.count("*").alias("_n")).join(other, "b")  # the lesser text is often a leader
    names = pairs.columns
    both = join_unique(pairs.join(mine, "a"), other, "b", "_n", wide=True).select(*names, "_ta", "_tb")

    def run(batches):
        for rows, data, offsets in slices(batches, "_ta"):
            one, _, _, first = word_hashes(data, offsets)
            at = 0
            for part, data2, offsets2 in slices([rows], "_tb"):
                two, _, _, first2 = word_hashes(data2, offsets2)
                out = [aligned(shingles(one[first[at + i] : first[at + i + 1]], K), shingles(two[first2[i] : first2[i + 1]], K), least) for i in range(part.num_rows)]
                at += part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(out, pa.float64())], names=[*names, "similarity"])

    return both.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + ", similarity double")


def candidates(keyed: DataFrame, own_leaders: bool) -> DataFrame:
    """keyed: (_words, _bands).  Distinct (a, b): a member of a bucket and its leader."""
    e = keyed.select("_words", F.explode("_bands").alias("_key"))
    leader = F.min_by("_words", F.xxhash64("_words", "_key")) if own_leaders else F.min("_words")
    leaders = e.groupBy("_key").agg(leader.alias("_leader"), F.count("*").alias("_n")).where("_n > 1").select("_key", "_leader")
    return e.join(leaders, "_key").where("_words != _leader").select(F.greatest("_words", "_leader").alias("a"), F.least("_words", "_leader").alias("b")).distinct()


def _loose(met: DataFrame) -> DataFrame:
    """met: (a, b, similarity) of members and leaders.  All that met where a pair failed: whoever stands in such a pair,
    and all that were compared with the same text."""
    failed = met.where("similarity = 0").select(F.explode(F.array("a", "b")).alias("_end")).distinct()
    near = met.select(F.col("a").alias("_end"), F.col("b").alias("_words")).unionByName(met.select(F.col("b").alias("_end"), F.col("a").alias("_words")))
    return near.join(failed, "_end", "left_semi").select("_words").unionByName(failed.select(F.col("_end").alias("_words"))).distinct()


def _kmer_lists(batches):
    for rows, data, offsets in slices(batches):
        hashes, _, _, first = word_hashes(data, offsets)
        yield rows, [labelled(shingles(hashes[a:b], K)) for a, b in zip(first.tolist(), first[1:].tolist(), strict=False)]


def _rare_heads(texts: DataFrame, least: float) -> DataFrame:
    """texts: (_words, _text, _label).  (_words, _label, _kmer, _n, _left): the rarest labelled k-mers of each text, as many as
    two texts of similarity least need to share one, with the number of all and of those from there on.

    Labelled k-mers are ordered alike in all texts, rarest first.  With a Jaccard similarity of least or more (an aligned
    one never exceeds it) two texts share one of their first n - ceil(least * n) + 1, and at the first that they share
    enough must be left in both.
    """
    arrays = lambda batches: (np.concatenate(lists) for _, lists in _kmer_lists(batches) if lists)
    shared = texts.sparkSession.sparkContext.broadcast(bucket_counts(texts, arrays, _COUNT_BITS))
    label = texts.schema["_label"].dataType.simpleString()

    def run(batches):
        counts, shift = shared.value, np.uint64(64 - _COUNT_BITS)
        for rows, lists in _kmer_lists(batches):
            heads = [x[np.lexsort((x, counts[(x >> shift).astype(np.int64)]))][: len(x) - int(np.ceil(least * len(x) - 1e-9)) + 1] for x in lists]
            sizes = np.array([len(h) for h in heads], np.int64)
            owner = pa.array(np.repeat(np.arange(len(heads)), sizes))
            place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            n = np.repeat(np.array([len(x) for x in lists], np.int64), sizes)
            columns = [rows.column(rows.schema.get_field_index(c)).take(owner) for c in ("_words", "_label")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(heads).view(np.int64)), pa.array(n, pa.int32()), pa.array(n - place, pa.int32())], names=["_words", "_label", "_kmer", "_n", "_left"])

    return texts.select("_words", "_text", "_label").mapInArrow(run, f"_words binary, _label {label}, _kmer bigint, _n int, _left int")


def _apart(heads: DataFrame, least: float) -> DataFrame:
    """The rows whose k-mer texts of several labels have, as far as their places leave enough for such a text.

    Two texts may be near by a k-mer if each one's n is within the other's reach, (1 + least) / least * left - n; the shorter of
    them is within its own.  So a row stays if the shortest of those is within its reach and the widest reach covers it.
    """
    reach = F.col("_left") * ((1 + least) / least) - F.col("_n") + 1e-6
    own = F.when(reach >= F.col("_n"), F.col("_n"))
    ends = [F.min(own).alias("_short"), F.max(reach).alias("_wide"), F.min("_label").alias("_x"), F.max("_label").alias("_y")]
    able = heads.join(heads.groupBy("_kmer").agg(*ends).where("_x != _y and _short is not null").drop("_x", "_y"), "_kmer")
    able = save(able.where((reach >= F.col("_short")) & (F.col("_wide") >= F.col("_n"))).select(*heads.columns), "rare-kmers")
    several = able.groupBy("_kmer").agg(F.min("_label").alias("_x"), F.max("_label").alias("_y")).where("_x != _y")
    return able.join(several.select("_kmer"), "_kmer", "left_semi")


def exact_links(texts: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """texts: (_words, _text, _label); found: (a, b, similarity) of pairs that were compared.  Links (a, b, _a, _b) between texts
    of different labels, with those, such that with the labels every pair of similarity least or more stands in one component.

    Texts meet under their rarest k-mers.  A k-mer elects leaders, `MORE` times as many each round, which all its texts of
    other labels are compared with; links join labels, leaders leave, and it ends when no k-mer has two labels left.  The
    rows of k-mers carry the labels; where links change some, a text is one row for that.
    """
    heads = save(_apart(save(_rare_heads(texts, least), "rare-kmers"), least), "rare-kmers")
    found, links, most = found.select("a", "b"), [], 1
    while not heads.isEmpty():
        place = F.row_number().over(Window.partitionBy("_kmer").orderBy("_words"))
        names = {c: f"{c}2" for c in ("_words", "_label", "_n", "_left")}
        leaders = save(heads.withColumn("_place", place).where(F.col("_place") <= most).drop("_place").withColumnsRenamed(names), "leaders")
        enough = F.least("_left", "_left2") * (1 + least) >= least * (F.col("_n") + F.col("_n2")) - 1e-6
        met = heads.join(leaders, "_kmer").where((F.col("_words") != F.col("_words2")) & (F.col("_label") != F.col("_label2")) & enough)
        first = F.col("_words") > F.col("_words2")
        ends = [F.when(first, F.col(x)).otherwise(F.col(y)) for x, y in (("_words", "_words2"), ("_words2", "_words"), ("_label", "_label2"), ("_label2", "_label"))]
        pairs = save(met.select(*(e.alias(x) for e, x in zip(ends, ("a", "b", "_a", "_b"), strict=True))).distinct().join(found, ["a", "b"], "left_anti"), "candidates")
        checked = save(verify(pairs, texts, least), "verified")
        found = found.unionByName(checked.select("a", "b"))
        new = checked.where("similarity > 0").select("a", "b", "_a", "_b")
        heads = heads.join(leaders.select("_kmer", F.col("_words2").alias("_words")), ["_kmer", "_words"], "left_anti")
        if not new.isEmpty():
            links.append(new)
            moved = components(new.select(F.col("_a").alias("a"), F.col("_b").alias("b"))).withColumnsRenamed({"node": "_label", "label": "_next"})
            own = heads.groupBy("_words", "_label").agg(F.collect_list(F.struct("_kmer", "_n", "_left")).alias("_rows"))  # k-mers of one text
            heads = own.join(moved, "_label", "left").select("_words", F.coalesce("_next", "_label").alias("_label"), F.inline("_rows"))
        heads, most = save(_apart(heads, least), "rare-kmers"), MORE * most
    own = [F.col(c).alias(x) for c, x in (("_words", "a"), ("_words", "b"), ("_label", "_a"), ("_label", "_b"))]
    return reduce(DataFrame.unionByName, links) if links else texts.select(*own).limit(0)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, levels: tuple[tuple[int, int], ...] = LEVELS) -> DataFrame:
    """One row for each row of df: the id, class_id (the least id of its class), n_links (verified links of its text), kept
    (whether it is its class's row that stays: the least id, of equal ids the least text hash)."""
    return _classes(df, id_col, text_col, least, levels).select(F.col("_id").alias(id_col), "class_id", "n_links", "kept")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, levels: tuple[tuple[int, int], ...] = LEVELS) -> DataFrame:
    """One row of each class, with its columns."""
    stay = _classes(df, id_col, text_col, least, levels).where("kept").select("_id", "_hash").distinct()
    return rows_that_stay(df, stay, [F.col(id_col), F.xxhash64(F.col(text_col).cast("string"))], ["_id", "_hash"])


def _classes(df: DataFrame, id_col: str, text_col: str, least: float, levels: tuple[tuple[int, int], ...]) -> DataFrame:
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.xxhash64(F.col(text_col).cast("string")).alias("_hash"))
    signed = save(signatures(docs, *levels[0]), "signatures")
    one = signed.where("_words is not null").groupBy("_words").agg(F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_hash")).alias("_rep"), F.any_value("_bands").alias("_bands"))
    unique = save(one, "unique-texts")

    pairs = save(candidates(unique, False), "candidates")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("_words")).distinct()
    wanted = ends.join(unique.select("_words", "_rep"), "_words").select("_words", F.col("_rep._id").alias("_i"), F.col("_rep._hash").alias("_h"))
    held = docs.join(wanted, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")))
    texts = save_by_key(held.select("_words", "_text").dropDuplicates(["_words"]), "candidate-texts", "_words")
    checked = save(verify(pairs, texts, least), "verified")
    found, met = [checked], checked
    for rows, bands in levels[1:]:
        keyed = save(signatures(texts.join(_loose(met), "_words", "left_semi").withColumnRenamed("_words", "_own"), rows, bands), "signatures")
        again = save(candidates(keyed, True), "candidates")
        known = reduce(DataFrame.unionByName, found)
        found.append(save(verify(save(again.join(known, ["a", "b"], "left_anti"), "candidates"), texts, least), "verified"))
        met = reduce(DataFrame.unionByName, found).join(again, ["a", "b"], "left_semi")
    linked = save(reduce(DataFrame.unionByName, found).where("similarity > 0").select("a", "b"), "near-links")
    label = components(linked)
    # Exactly: what met where a pair failed at the last level, but for pairs that links have brought together already.
    rest = texts.join(_loose(met), "_words", "left_semi").join(label.withColumnRenamed("node", "_words"), "_words", "left")
    rest = save_by_key(rest.select("_words", "_text", F.coalesce("label", "_words").alias("_label")), "loose-texts", "_words")
    late = exact_links(rest, reduce(DataFrame.unionByName, found), least)
    links = linked.unionByName(late.select("a", "b"))
    # The classes so far are the nodes that the late links connect (by the labels that they had when they were linked).
    joined = late.select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    merged = components(joined)
    label = label.unionByName(joined.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(label, "node", "left_anti").select("node", F.col("node").alias("label")))
    label = label.join(merged.select(F.col("node").alias("label"), F.col("label").alias("_next")), "label", "left").select("node", F.coalesce("_next", "label").alias("label"))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    of = label.join(degree, "node").join(unique.select(F.col("_words").alias("node"), "_rep"), "node")
    first = of.groupBy("label").agg(F.min("_rep").alias("_class"))
    linked = of.join(first, "label").select(F.col("node").alias("_words"), "_class", "n_links")
    by_text = unique.select("_words", "_rep").join(linked, "_words", "left").select("_words", F.coalesce("_class", "_rep").alias("_class"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    out = signed.select("_id", "_hash", "_words").join(by_text, "_words", "left")
    alone = F.col("_words").isNull()
    kept = alone | (F.col("_id").eqNullSafe(F.col("_class._id")) & (F.col("_hash") == F.col("_class._hash")))
    class_id = F.when(alone, F.col("_id")).otherwise(F.col("_class._id"))
    return out.select("_id", "_hash", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), kept.alias("kept"))
