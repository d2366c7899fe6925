"""Operator 13: a Merkle manifest of a dataset, with a witness for every row.

A row's leaf is a digest of its fields.  Leaves of a source stand in the order of their ids; every `ARITY` consecutive
nodes become one, until one is left, the source's root; the roots of all sources, in order, become the dataset's root in
the same way.  A witness of a leaf has, level by level, the siblings on its way to the root.

Witnesses grow by streaming appends: `Frontier` takes nodes from left to right and holds the open run of each level; when
a run completes, the witness of everything below each of its members is extended by the other members, and the run's
digest is appended to the level above.  Distributed, a source is cut into aligned blocks of `ARITY ** LEVELS` leaves, each
of which is one row with a fixed number of digests; block roots are the nodes of a smaller table that is appended to in
the same way, round by round, until each source has one.  Then witnesses go down again: each block is joined with the
witness of its root.  Leaves are sorted and dealt out once; every later round has a 256th of the rows before it.

A manifest can be continued: new rows whose ids follow those of their source extend its last, open block; complete blocks
are taken over as they are.

Defined cases: a null field is `-` in the leaf, so a null text differs from an empty one; null ids come first in their
source and a null source is a source of its own, before all others; rows with equal ids stand in the order of their leaves;
repeated rows are leaves of their own; a source of one row is its leaf; an empty table has no rows (and no root).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import save

ARITY, LEVELS = 16, 2
BLOCK = ARITY**LEVELS
#: Fields of a leaf, in order (fixed values).
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: A step of a witness: the place among the run's members, and the digests of the others, joined.
WITNESS = "array<struct<at: int, others: string>>"


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Frontier:
    """The open subtrees of one tree, level by level; nodes are appended from left to right.

    witnesses[i] is the witness of the i-th appended node so far: steps (place, digests of the others joined).
    """

    def __init__(self, arity: int = ARITY):
        self.arity, self.open, self.done, self.witnesses = arity, [[]], [0], []

    def append(self, node: str) -> None:
        self.witnesses.append([])
        self._put(0, node, [len(self.witnesses) - 1])

    def _put(self, level: int, node: str, below: list[int]) -> None:
        if level == len(self.open):
            self.open.append([])
            self.done.append(0)
        self.open[level].append((node, below))
        self.done[level] += 1
        if len(self.open[level]) == self.arity:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        nodes = [n for n, _ in run]
        for i, (_, below) in enumerate(run):
            step = (i, "".join(nodes[:i] + nodes[i + 1 :]))
            for k in below:
                self.witnesses[k].append(step)
        self._put(level + 1, digest(nodes), [k for _, below in run for k in below])

    def close(self, levels: int | None = None) -> str:
        """Complete what is open and return the root: that of exactly so many levels, or of as many as leave one node."""
        level = 0
        while level < levels if levels is not None else self.done[level] > 1:
            if self.open[level]:
                self._complete(level)
            level += 1
        return self.open[level][0][0]


def folded(leaf: str, witness: list[tuple[int, str]]) -> str:
    """The root that follows from a leaf and its witness."""
    for at, others in witness:
        leaf = digest([others[: 64 * at], leaf, others[64 * at :]])
    return leaf


def leaf(fields: list[Column]) -> Column:
    """Hex digest of the fields: `-` where null, else the number of UTF-8 bytes, a colon and the value."""
    text = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]), 256)


@dataclass
class Manifest:
    """blocks: (_group, _block, _total, _nodes array<struct<id, leaf, other>>, _first), a saved table of aligned runs of leaves;
    rows of one source have one _group, which orders sources (null first)."""

    blocks: DataFrame
    id_type: str


def _placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows: a saved table with _group.  Adds _at, the place of a row in its group by order, and _total, the group's rows.

    Rows are range-partitioned and numbered within each partition; what a group has in earlier partitions is added, so a
    group may spread over any number of tasks.
    """
    kept = rows.columns
    ranged = rows.repartitionByRange("_group", *order).sortWithinPartitions("_group", *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", _part int, _row bigint"

    def number(batches):
        part, group, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for g in batch.column(batch.schema.get_field_index("_group")).to_pylist():
                n = n + 1 if g == group else 0
                group = g
                places.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())], names=[*batch.schema.names, "_part", "_row"])

    numbered = save(ranged.mapInArrow(number, schema), f"{name}-sorted")
    counts = numbered.groupBy("_group", "_part").agg(F.count("*").alias("_n"))  # a row for each task and each group's change
    counts = counts.selectExpr("_group", "_part", "sum(_n) over (partition by _group order by _part) - _n as _before", "sum(_n) over (partition by _group) as _total")
    return numbered.join(counts, ["_group", "_part"]).select(*kept, (F.col("_before") + F.col("_row")).alias("_at"), "_total")


def _blocks(placed: DataFrame, columns: list[str]) -> DataFrame:
    """placed: (_group, _at, _total, columns).  One row for each BLOCK consecutive places, its nodes in order."""
    nodes = F.sort_array(F.collect_list(F.struct("_at", *columns)))  # BLOCK rows at most: places differ
    return placed.groupBy("_group", F.expr(f"_at div {BLOCK}").alias("_block")).agg(F.max("_total").alias("_total"), nodes.alias("_nodes"))


def _few(batches, rows: int = 16):
    """Batches of a few blocks, so that what is made of them at once has a bound."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _append_all(nodes: list[dict], total: int) -> tuple[str, list[list[tuple[int, str]]]]:
    """The block's root and the witness of each node: a whole tree, or LEVELS levels of a larger one."""
    tree = Frontier()
    for x in nodes:
        tree.append(x["leaf"])
    return tree.close(LEVELS if total > BLOCK else None), tree.witnesses


def _roots(blocks: DataFrame) -> DataFrame:
    """(_group, _at, _total, leaf): the root of each block as a node of the next round."""

    def run(batches):
        for b in _few(batches):
            cols = [b.column(b.schema.get_field_index(c)) for c in ("_group", "_block", "_total")]
            totals = cols[2].to_pylist()
            roots = [_append_all(nodes, n)[0] for nodes, n in zip(b.column(b.schema.get_field_index("_nodes")).to_pylist(), totals, strict=True)]
            yield pa.RecordBatch.from_arrays([cols[0], cols[1], pa.array([-(-n // BLOCK) for n in totals], pa.int64()), pa.array(roots)], names=["_group", "_at", "_total", "leaf"])

    return blocks.mapInArrow(run, "_group binary, _at bigint, _total bigint, leaf string")


def _descend(blocks: DataFrame, upper: DataFrame) -> DataFrame:
    """blocks and the witness of each block's root, upper: (_group, _block, _root, _up).  (_group, _block, _root, _up) of every
    node, whose place is _block in the next lower round."""

    def run(batches):
        for b in _few(batches):
            cols = {c: b.column(b.schema.get_field_index(c)).to_pylist() for c in b.schema.names}
            out = []
            for g, block, total, nodes, root, up in zip(*(cols[c] for c in ("_group", "_block", "_total", "_nodes", "_root", "_up")), strict=True):
                for i, w in enumerate(_append_all(nodes, total)[1]):
                    out.append({"_group": g, "_block": block * BLOCK + i, "_root": root, "_up": [{"at": a, "others": o} for a, o in w] + up})
            kind = pa.schema([("_group", pa.binary()), ("_block", pa.int64()), ("_root", pa.string()), ("_up", pa.list_(pa.struct([("at", pa.int32()), ("others", pa.string())])))])
            yield pa.RecordBatch.from_pylist(out, kind)

    met = blocks.join(upper, ["_group", "_block"])
    return met.mapInArrow(run, f"_group binary, _block bigint, _root string, _up {WITNESS}")


def _climb(blocks: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of blocks above (and with) these, and the root of each group: (_group, leaf)."""
    rounds = [blocks]
    while True:
        nodes = save(_roots(rounds[-1]), f"{name}-roots")
        if nodes.where("_total > 1").isEmpty():
            return rounds, nodes.select("_group", "leaf")
        # Groups that are down to one node wait as blocks of one.
        rounds.append(save(_blocks(nodes, ["leaf"]), f"{name}-blocks"))


def build(df: DataFrame, fields: list[str] = FIELDS, id_col: str = "doc_id", source_col: str = "source", other: Callable[[dict[str, Column]], Column] | None = None, earlier: Manifest | None = None) -> Manifest:
    """The manifest of df's rows, or of earlier's and then df's, whose ids must then follow those of their source.

    other: from the fields, those of a second state of the row whose leaf is kept beside (null: the same).
    """
    own = {c: F.col(f"`{c}`") for c in fields}
    second = F.lit(None).cast("string") if other is None else other(own)
    source = F.col(f"`{source_col}`").cast("string")
    group = F.coalesce(F.concat(F.lit(b"\x01"), F.encode(source, "utf-8")), F.lit(b"\x00"))  # null first, then by bytes
    rows = df.select(group.alias("_group"), F.col(f"`{id_col}`").alias("id"), leaf(list(own.values())).alias("leaf"), second.alias("other"), F.monotonically_increasing_id().alias("_tie"))
    id_type = rows.schema["id"].dataType.simpleString()
    rows = save(rows, "leaves")  # texts are read once
    columns = ["id", "leaf", "other"]
    placed = _placed(rows, ["id", "leaf", "_tie"], "leaves").select("_group", "_at", "_total", *columns)
    if earlier is None:
        return Manifest(save(_blocks(placed, columns), "leaf-blocks"), id_type)
    # Continue: places go on behind those that are held; only a source's last block may be open.
    ends = earlier.blocks.groupBy("_group").agg(F.max("_total").alias("_held"), F.max(F.element_at("_nodes", -1)["id"]).alias("_end"))
    late = rows.join(ends, "_group").where("id is null or id <= _end")
    if not late.isEmpty():
        raise ValueError("new ids must follow those that their source holds")
    grown = placed.groupBy("_group").agg(F.max("_total").alias("_new")).join(ends, "_group", "full").select("_group", (F.coalesce("_new", F.lit(0)) + F.coalesce("_held", F.lit(0))).alias("_all"), F.coalesce("_held", F.lit(0)).alias("_held"))
    grown = save(grown, "source-sizes")
    moved = placed.join(grown, "_group").select("_group", (F.col("_at") + F.col("_held")).alias("_at"), F.col("_all").alias("_total"), *columns)
    held = earlier.blocks.drop("_total").join(grown.where("_all > _held").select("_group", F.col("_all").alias("_total")), "_group")
    still = earlier.blocks.join(grown.where("_all = _held").select("_group"), "_group", "left_semi")
    full = F.size("_nodes") == BLOCK
    reopened = held.where(~full).select("_group", "_total", F.explode("_nodes").alias("_x")).select("_group", F.col("_x._at").alias("_at"), "_total", *[F.col(f"_x.{c}").alias(c) for c in columns])
    names = ["_group", "_block", "_total", "_nodes"]
    fresh = _blocks(moved.unionByName(reopened), columns)
    return Manifest(save(still.select(*names).unionByName(held.where(full).select(*names)).unionByName(fresh.select(*names)), "leaf-blocks"), id_type)


def witnesses(manifest: Manifest) -> DataFrame:
    """One row for each leaf: id, leaf, other, subroot, root, witness (steps from the leaf to the root)."""
    rounds, subroots = _climb(manifest.blocks, "source")
    one = F.lit(b"").alias("_group")
    nodes = save(subroots.select(one, F.col("_group").alias("_source"), "leaf"), "subroots")
    top = save(_blocks(_placed(nodes, ["_source"], "subroots"), ["_source", "leaf"]), "subroot-blocks")
    upper, roots = _climb(top, "top")
    # Down: from the dataset's root to each source's, then to each block of leaves.
    way = _start(upper[-1].join(roots.select("_group", F.col("leaf").alias("_root")), "_group"))
    for blocks in reversed(upper):
        way = save(_descend(blocks, way), "top-witnesses")
    names = top.select("_block", F.explode("_nodes").alias("_x")).select(F.col("_x._at").alias("_block"), F.col("_x._source").alias("_group"), F.col("_x.leaf").alias("_sub"))
    way = names.join(way.drop("_group"), "_block").select("_group", F.lit(0).cast("bigint").alias("_block"), F.struct("_sub", "_root").alias("_ends"), "_up")
    ends = save(way, "source-witnesses")
    down = ends.select("_group", "_block", F.to_json("_ends").alias("_root"), "_up")
    for blocks in reversed(rounds[1:]):
        down = save(_descend(blocks, down), "block-witnesses")
    met = rounds[0].join(down, ["_group", "_block"])

    def run(batches):
        for b in _few(batches):
            cols = {c: b.column(b.schema.get_field_index(c)).to_pylist() for c in ("_total", "_root", "_up")}
            nodes = b.column(b.schema.get_field_index("_nodes"))
            ids, flat, out = nodes.flatten().field(1), nodes.to_pylist(), []
            for total, root, up, members in zip(cols["_total"], cols["_root"], cols["_up"], flat, strict=True):
                end = json.loads(root)
                for x, w in zip(members, _append_all(members, total)[1], strict=True):
                    out.append({"leaf": x["leaf"], "other": x["other"], "subroot": end["_sub"], "root": end["_root"], "witness": [{"at": a, "others": o} for a, o in w] + up})
            kind = pa.schema([("leaf", pa.string()), ("other", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("witness", pa.list_(pa.struct([("at", pa.int32()), ("others", pa.string())])))])
            rest = pa.RecordBatch.from_pylist(out, kind)
            yield pa.RecordBatch.from_arrays([ids, *rest.columns], names=["id", *kind.names])

    return met.select("_total", "_root", "_up", "_nodes").mapInArrow(run, f"id {manifest.id_type}, leaf string, other string, subroot string, root string, witness {WITNESS}")


def _start(blocks: DataFrame) -> DataFrame:
    return blocks.select("_group", "_block", "_root", F.array().cast(WITNESS).alias("_up"))


def verify(witnessed: DataFrame) -> DataFrame:
    """Adds proof_sha256 (digest of all siblings of the witness in order), folded_root (from other, or the leaf where it is
    null) and verified (whether that is the root), and drops the witness."""
    kept = [c for c in witnessed.columns if c != "witness"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in witnessed.schema if f.name in kept)

    def run(batches):
        for b in batches:
            cols = {c: b.column(b.schema.get_field_index(c)) for c in b.schema.names}
            proofs, ends = [], []
            for own, other, steps in zip(cols["leaf"].to_pylist(), cols["other"].to_pylist(), cols["witness"].to_pylist(), strict=True):
                proofs.append(digest([s["others"] for s in steps]))
                ends.append(folded(own if other is None else other, [(s["at"], s["others"]) for s in steps]))
            good = [x == y for x, y in zip(ends, cols["root"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(cols[c] for c in kept), pa.array(proofs, pa.string()), pa.array(ends, pa.string()), pa.array(good, pa.bool_())], names=[*kept, "proof_sha256", "folded_root", "verified"])

    return witnessed.mapInArrow(run, f"{schema}, proof_sha256 string, folded_root string, verified boolean")


def lower_cased(every: int = 5) -> Callable[[dict[str, Column]], Column]:
    """The trial of the query: where `every` divides the unsigned crc32 of the id, the leaf with the text's A-Z in lower case."""

    def other(own: dict[str, Column]) -> Column:
        text = F.translate(own["text"].cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        return F.when(F.crc32(own["doc_id"].cast("string")) % every == 0, leaf([text if c == "text" else own[c] for c in FIELDS]))

    return other
