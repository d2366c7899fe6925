"""Shared helpers of the training-data operators: tables, the shared work folder, and text as NumPy arrays.

Every operator takes the columns it needs under private names first, so extra or clashing columns of its
input never matter.  A null text is an empty text everywhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into arrays at once (a longer text is a slice of its own).
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir); a local one only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = set_dir.get() if set_dir.isDefined() else None
    if root is None:
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints/sparkwarden")
        root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it again, so lost executors cost no earlier stage."""
    path = work_dir(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def save_by_key(df: DataFrame, name: str, key: str) -> DataFrame:
    """As save, in buckets of a key (a table of the warehouse): later joins on the key move the other side only."""
    spark, table = df.sparkSession, f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(n, key).sortBy(key).option("path", work_dir(spark, name)).saveAsTable(table)
    return spark.table(table)


def held_out(doc_id: Column) -> Column:
    """The evaluation third: crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


#: Rows of one key that one task may meet in a join, how many more frequent keys are broadcast, and parts of a key beyond.
HOT_ROWS, HOT_KEYS, SALTS = 10_000, 10_000, 64


def join_unique(left: DataFrame, right: DataFrame, key: str, n: str, how: str = "inner", wide: bool = False) -> DataFrame:
    """Join (inner or left) with a right side that has each key once, and in column n (dropped) how many rows of left have it.

    Keys of more than HOT_ROWS rows are joined apart, so that no task meets all rows of such a key: up to HOT_KEYS of them
    by broadcast (that many rows; not if wide, where a row's size has no bound), else salted, SALTS parts for each key.
    """
    few = right.where(F.col(n) > HOT_ROWS).select(key).limit(HOT_KEYS + 1).count()
    if not few:
        return left.join(right.drop(n), key, how)
    hot, cold = right.where(F.col(n) > HOT_ROWS).drop(n), right.where(F.col(n) <= HOT_ROWS).drop(n)
    if few <= HOT_KEYS and not wide:
        often = left.join(F.broadcast(hot), key)
    else:
        there = left.join(F.broadcast(hot.select(key)), key, "left_semi") if few <= HOT_KEYS else left
        salted = there.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        parts = F.explode(F.array([F.lit(i) for i in range(SALTS)])).alias("_salt")
        often = salted.join(hot.select("*", parts), [key, "_salt"]).drop("_salt")
    if how == "left":
        keys = hot.select(key)
        left = left.join(F.broadcast(keys) if few <= HOT_KEYS else keys, key, "left_anti")
    return often.unionByName(left.join(cold, key, how))


def bucket_counts(df: DataFrame, arrays: Callable[[Iterable[pa.RecordBatch]], Iterable[np.ndarray]], bits: int, parts: int = 64) -> np.ndarray:
    """How often hashes with the same first bits occur in df: a fixed number of counts, whatever the number of rows.
    arrays: the uint64 hashes of Arrow batches."""
    schema, shift, n = "_part int, _counts binary", np.uint64(64 - bits), 1 << bits

    def run(batches):
        total = np.zeros(n, np.uint32)
        for x in arrays(batches):
            np.add.at(total, (x >> shift).astype(np.int64), np.uint32(1))
        blocks = total.reshape(parts, -1)
        for i in range(parts if total.any() else 0):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([blocks[i].tobytes()], pa.binary())], names=["_part", "_counts"])

    def add(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros(n // parts, np.uint64), None
        for b in batches:
            part = b.column(0)[:1]
            for x in b.column(1).to_pylist():
                total += np.frombuffer(x, np.uint32)
        yield pa.RecordBatch.from_arrays([part, pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())], names=["_part", "_counts"])

    out = np.zeros((parts, n // parts), np.uint32)
    for r in df.mapInArrow(run, schema).groupBy("_part").applyInArrow(add, schema).collect():
        out[r["_part"]] = np.frombuffer(r["_counts"], np.uint32)
    return out.ravel()


def pack(x: np.ndarray) -> bytes:
    """An array as compressed bytes: first all first bytes of its numbers, then all second ones, and so on."""
    return zstandard.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)


def unpack(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(size, -1).T).tobytes(), kind)


# ---------------------------------------------------------------- text as arrays


def slices(batches: Iterable[pa.RecordBatch], text: str = "_text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut Arrow batches into runs of rows with about SLICE_BYTES of text: (rows, UTF-8 bytes, offsets of the texts)."""
    for batch in batches:
        column = pc.fill_null(batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()), "")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def byte_table(words: bool = True) -> np.ndarray:
    """Lower-cases A-Z; with words, every byte outside 0-9, a-z and the non-ASCII ones becomes 0."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    if words:
        keep = np.zeros(256, bool)
        keep[48:58] = keep[97:123] = keep[65:91] = keep[128:] = True
        t[~keep] = 0
    return t


WORD_BYTES = byte_table()
_RNG = np.random.default_rng(20240117)
_BYTE_KEYS = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SHINGLE_KEYS = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64; kept and grown by doubling."""
    p = _powers.get(base)
    if p is None or len(p) <= n:
        p = np.full(max(n + 1, 1 << 16), base, np.uint64)
        p[0] = 1
        p = _powers[base] = np.multiply.accumulate(p)
    return p


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that stay within one text."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = member.copy()
    first[1:] &= ~member[:-1]
    cut = offsets[(offsets > 0) & (offsets < n)]
    first[cut] = member[cut]
    last = member.copy()
    last[:-1] &= ~member[1:]
    last[cut - 1] = member[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for many spans at once, alike in every process (a keyed polynomial from prefix sums)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, q = _power(_BASE, len(data)), _power(_INVERSE, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_KEYS[data] * p[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text (A-Z lower-cased; digits, a-z and non-ASCII make words): hashes, byte starts, byte ends, first word of each text."""
    low = WORD_BYTES[data]
    starts, ends = runs(low != 0, offsets)
    return span_hash(low, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of each k consecutive words of one text; a shorter text, if not empty, is one shingle."""
    if not len(words):
        return words
    k = min(k, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        out += words[j : j + len(out)] * _SHINGLE_KEYS[j]
    return mix(out + np.uint64(k))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each width consecutive words, for any width (a polynomial from prefix sums)."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _power(_BASE, n)[:n], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * _power(_INVERSE, n)[: n - width + 1])
