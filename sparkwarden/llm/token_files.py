"""Operator 10: token ids as Arrow files of equal-length sequences.

Documents are range-partitioned and sorted by id; each task encodes its documents and writes one shard, an Arrow IPC
file whose record batches hold two fixed-size lists: `ids` (uint16 where the vocabulary fits, else int32) and `mask`
(bits, 0 only in the padding of the shard's last sequence).  A companion file holds where each document begins.  Because every sequence has the same
length, sequence k of a shard is reached by arithmetic and read as a view of the mapped file, with no copy.

A task writes under its attempt's own name and reports that name in the manifest, so a task that is lost or run twice
leaves at most files that nothing refers to.

Defined cases: whole-number ids are kept as such, others as strings; a null or empty text has only the end id; equal ids keep all their rows, next to each other, ordered by
text; a null id sorts first; an empty table gives no shard.
"""

from __future__ import annotations

import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from sparkwarden.llm.bpe import pieces_of
from sparkwarden.llm.common import save, slices, work_dir

#: Ids in a sequence, and sequences in a record batch.
SEQUENCE, BATCH = 2048, 128
#: Words whose ids are kept between slices of text; emptied when full, which changes speed and no result.
CACHE_WORDS = 400_000
MANIFEST = "shard int, path string, docs_path string, first_id {id}, n_docs bigint, n_ids bigint, n_sequences bigint"


class _Words(dict):
    """Pre-token -> its ids, from the library's model, which is asked once for each pre-token that is not kept."""

    def __init__(self, library, code: str):
        self.model, self.code = library.model, code
        # The library's BPE model reads bytes as printable characters: itself where printable, else from U+0100 on.
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(printable)]
        self.characters = {b: b for b in printable} | {b: 0x100 + i for i, b in enumerate(rest)}

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = array(self.code, [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.characters))]).tobytes()
        if len(piece) <= 256:
            self[piece] = ids
        return ids


class Encoder:
    """Whole texts to ids with a byte-level BPE model of the tokenizers library.

    added: the strings of the file's added tokens get those tokens' ids, as by the library's encode; else they are
    ordinary text.  Only texts that hold such a string go through the library as a whole.
    """

    def __init__(self, vocabulary: str, added: bool = False):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(vocabulary)
        self.code = "H" if library.get_vocab_size() <= 1 << 16 else "i"
        self.words = _Words(library, self.code)
        self.library, self.added = library, [t.content.encode() for t in library.get_added_tokens_decoder().values()] if added else []

    def encode_slice(self, data: bytes, offsets: np.ndarray):
        begin, end, first = pieces_of(data, offsets)
        ids, cut = self.words.__getitem__, data.__getitem__
        special = [any(data.find(x, p, q) >= 0 for x in self.added) for p, q in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
        for i, (a, b) in enumerate(zip(first, first[1:], strict=False)):
            if special[i]:
                yield array(self.code, self.library.encode(data[offsets[i] : offsets[i + 1]].decode(), add_special_tokens=False).ids).tobytes()
            else:
                yield b"".join(map(ids, map(cut, map(slice, begin[a:b], end[a:b]))))


@lru_cache(2)
def encoder(vocabulary: str, added: bool = False) -> Encoder:
    return Encoder(vocabulary, added)


class _Shard:
    """Writes one shard; holds one batch of sequences at most."""

    def __init__(self, folder: str, name: str, sequence: int, batch: int, code: str, id_kind: pa.DataType):
        self.fs, base = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        self.fs.create_dir(base, recursive=True)
        self.sequence, self.block = sequence, sequence * batch
        self.kind = np.dtype(code)
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.kind), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.docs_schema = pa.schema([("doc_id", id_kind), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.outs = [self.fs.open_output_stream(f"{base}/{name}{x}.arrow") for x in ("", ".docs")]
        self.paths = [f"{folder}/{name}{x}.arrow" for x in ("", ".docs")]
        self.file, self.docs_file = pa.ipc.new_file(self.outs[0], self.schema), pa.ipc.new_file(self.outs[1], self.docs_schema)
        self.held, self.n_held, self.docs, self.n_docs, self.n_ids, self.n_sequences, self.first_id = [], 0, [], 0, 0, 0, None

    def add(self, doc_id: int | str | None, raw: bytes) -> None:
        n = len(raw) // self.kind.itemsize
        if not self.n_docs:
            self.first_id = doc_id
        self.docs.append((doc_id, self.n_ids, n))
        self.n_docs, self.n_ids, self.n_held = self.n_docs + 1, self.n_ids + n, self.n_held + n
        self.held.append(raw)
        if self.n_held >= self.block:
            flat = np.frombuffer(b"".join(self.held), self.kind)
            whole = len(flat) - len(flat) % self.block
            for at in range(0, whole, self.block):
                self._write(flat[at : at + self.block])
            self.held, self.n_held = [flat[whole:].tobytes()], len(flat) - whole
        if len(self.docs) >= 65536:
            self._write_docs()

    def _write(self, flat: np.ndarray) -> None:
        n = -(-len(flat) // self.sequence)
        ids, mask = np.zeros(n * self.sequence, self.kind), np.zeros(n * self.sequence, bool)
        ids[: len(flat)], mask[: len(flat)] = flat, 1
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (ids, mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.n_sequences += n

    def _write_docs(self) -> None:
        columns = [pa.array(x, k) for x, k in zip(zip(*self.docs, strict=True), self.docs_schema.types, strict=True)]
        self.docs_file.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.docs_schema))
        self.docs = []

    def close(self) -> None:
        if self.n_held:
            self._write(np.frombuffer(b"".join(self.held), self.kind))
        if self.docs:
            self._write_docs()
        for x in (self.file, self.docs_file, *self.outs):
            x.close()


def write_token_files(df: DataFrame, vocabulary: str, folder: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, batch: int = BATCH, added: bool = False) -> DataFrame:
    """Encode every row of df, append end_id to each document and write the shards to folder (default: the shared work
    folder).  Returns the manifest, one row for each shard in document order, with global_start: ids in all shards before it.
    added: strings of the vocabulary's added tokens get those tokens' ids (the library's default).
    """
    spark = df.sparkSession
    out = folder or work_dir(spark, "token-files")
    # Range partitions are sampled by the random key too, so that many rows of one id spread over several shards.
    id_type = "bigint" if isinstance(df.schema[id_col].dataType, IntegralType) else "string"
    id_kind, schema = {"bigint": pa.int64(), "string": pa.string()}[id_type], MANIFEST.format(id=id_type)
    kept = df.select(F.col(id_col).cast(id_type).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kept = kept.withColumn("_tie", F.xxhash64("_text"))
    ordered = kept.repartitionByRange("_id", "_tie").sortWithinPartitions("_id", "_tie", "_text").select("_id", "_text")

    def run(batches):
        task, shard = TaskContext.get(), None
        encode = encoder(vocabulary, added)
        end = array(encode.code, [end_id]).tobytes()
        for rows, data, offsets in slices(batches):
            if shard is None:
                shard = _Shard(out, f"shard-{task.partitionId():05d}-{task.taskAttemptId()}", sequence, batch, encode.code, id_kind)
            for doc_id, raw in zip(rows.column(0).to_pylist(), encode.encode_slice(data.tobytes(), offsets), strict=True):
                shard.add(doc_id, raw + end)
        if shard is not None:
            shard.close()
            values = [task.partitionId(), *shard.paths, shard.first_id, shard.n_docs, shard.n_ids, shard.n_sequences]
            kinds = [pa.int32(), pa.string(), pa.string(), id_kind] + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    manifest = save(ordered.mapInArrow(run, schema), "token-manifest")
    return with_starts(spark, manifest)


def with_starts(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Add global_start.  The manifest has one row for each shard, so that many go through the driver: a bound set by the
    number of write tasks and not by documents."""
    rows, start, out = sorted(manifest.collect(), key=lambda r: r["shard"]), 0, []
    for r in rows:
        out.append((*r, start))
        start += r["n_ids"]
    return spark.createDataFrame(out, f"{MANIFEST.format(id=manifest.schema['first_id'].dataType.simpleString())}, global_start bigint")


def open_file(path: str) -> pa.ipc.RecordBatchFileReader:
    """Memory-mapped where the file system is local."""
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return pa.ipc.open_file(pa.memory_map(at) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(at))


class SequenceFile:
    """Random access to the sequences of one shard: file[k] gives (ids, mask), views of the mapped file (ids as NumPy array,
    mask as Arrow bits)."""

    def __init__(self, path: str):
        self.reader = open_file(path)
        self.per_batch = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 1
        n = self.reader.num_record_batches
        self.length = (n - 1) * self.per_batch + self.reader.get_batch(n - 1).num_rows if n else 0

    def __len__(self) -> int:
        return self.length

    def __getitem__(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        if not 0 <= k < self.length:
            raise IndexError(k)
        rows = self.reader.get_batch(k // self.per_batch).slice(k % self.per_batch, 1)
        return rows.column(0).flatten().to_numpy(zero_copy_only=True), rows.column(1).flatten()


def read_documents(manifest: DataFrame) -> DataFrame:
    """Read the shards back: one row for each document with doc_id, start (global), n_tokens and the crc32 of its ids."""
    n = max(1, manifest.count())
    schema = f"doc_id {manifest.schema['first_id'].dataType.simpleString()}, start bigint, n_tokens bigint, ids_crc32 bigint"

    def run(batches):
        for shard in (r for b in batches for r in b.to_pylist()):
            reader, k, flat, at = open_file(shard["path"]), 0, np.zeros(0), 0
            docs_file = open_file(shard["docs_path"])
            for i in range(docs_file.num_record_batches):
                docs = docs_file.get_batch(i)
                crcs = []
                for left in docs.column(2).to_pylist():
                    crc = 0
                    while left:
                        if at == len(flat):
                            flat, at, k = reader.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True), 0, k + 1
                        take = min(left, len(flat) - at)
                        crc = zlib.crc32(flat[at : at + take].astype("<u4"), crc)
                        at, left = at + take, left - take
                    crcs.append(crc)
                start = pa.array(docs.column(1).to_numpy() + shard["global_start"], pa.int64())
                yield pa.RecordBatch.from_arrays([docs.column(0), start, docs.column(2), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.repartition(n).mapInArrow(run, schema)
