"""Change feeds: messages of inserts, updates and deletes applied to keyed snapshots."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fold(messages: DataFrame, key: str, order: Column, operation: str = "operation") -> DataFrame:
    """The last message of each key, by one aggregate with map-side combine; deletes stay as rows."""
    rest = [c for c in messages.columns if c != key]
    last = messages.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_m"))
    return last.select(*[F.col(key) if c == key else F.col(f"_m.{c}").alias(c) for c in messages.columns])


def apply_changes(snapshot: DataFrame, messages: DataFrame, key: str, order: Column, operation: str = "operation") -> DataFrame:
    """What messages change in a keyed snapshot: the rows that are new or other than before, with _gone for deleted keys.

    Messages count in their order: an insert for a key that is there is ignored, as are an update and a delete for one that
    is not.  Three aggregates with map-side combine say it all: the last delete, and after it the first insert and the last
    update.
    """
    columns = snapshot.columns
    rest = [c for c in columns if c != key]
    m = messages.withColumns({"_order": order, "_op": F.col(operation)})
    cut = m.groupBy(key).agg(F.max(F.when(F.col("_op") == "delete", F.col("_order"))).alias("_cut"))
    after = m.where("_op != 'delete'").join(cut, key).where("_cut is null or _order > _cut")
    row = F.struct(F.col("_order").alias("at"), *[F.col(c) for c in rest])
    live = after.groupBy(key).agg(F.min(F.when(F.col("_op") == "insert", row)).alias("_first"), F.max(F.when(F.col("_op") == "update", row)).alias("_last"))
    both = cut.join(live, key, "left").join(snapshot.select(key, F.lit(True).alias("_known")), key, "left")
    there = F.col("_known").isNotNull() & F.col("_cut").isNull()
    last = F.when(there | (F.col("_last.at") > F.col("_first.at")), F.col("_last"))
    now = F.when(there, last).otherwise(F.coalesce(last, F.col("_first")))
    gone = F.col("_now").isNull() & F.col("_known").isNotNull() & F.col("_cut").isNotNull()
    changed = both.withColumn("_now", now).withColumn("_gone", gone).where("_now is not null or _gone")
    return changed.select(*[F.col(key) if c == key else F.col(f"_now.{c}").alias(c) for c in columns], "_gone")


def replay(events: DataFrame, key: str, version: Column, operation: str = "operation") -> DataFrame:
    """State of an append-only log: its last version of each key, without deleted keys."""
    return fold(events, key, version, operation).where(F.col(operation) != "delete")


class SnapshotTable:
    """A snapshot kept as what each batch changed, one folder a batch, so a batch writes no more than its changes, one that
    is run again writes the same folder again, and a new process finds what earlier ones wrote.

    schema: DDL without a column named version or _gone; key: the column that identifies a row.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.path, self.schema, self.key = spark, path, f"{schema}, _gone boolean", key
        spark.createDataFrame([], self.schema).write.mode("ignore").parquet(f"{path}/version=-1")

    def read(self, before: int | None = None) -> DataFrame:
        """The rows after the last batch, or before the batch of that number."""
        every = self.spark.read.schema(f"{self.schema}, version int").parquet(self.path)
        if before is not None:
            every = every.where(F.col("version") < before)
        return fold(every, self.key, F.col("version")).where("not _gone").drop("_gone", "version")

    def write(self, changes: DataFrame, batch: int) -> None:
        changes.write.mode("overwrite").parquet(f"{self.path}/version={batch}")

    def compacted(self, path: str) -> SnapshotTable:
        """The same rows at another path, as one version (numbered as the last, so later batches follow)."""
        last = self.spark.read.schema(f"{self.schema}, version int").parquet(self.path).agg(F.max("version")).first()[0]
        out = SnapshotTable(self.spark, path, self.schema.removesuffix(", _gone boolean"), self.key)
        if last is not None:
            out.write(self.read().withColumn("_gone", F.lit(False)), last)
        return out


def run_feed(source: DataFrame, table: SnapshotTable, order: Callable[[], Column], checkpoint: str) -> None:
    """Apply what a streaming source has now, micro-batch by micro-batch, and stop."""

    def batch(messages: DataFrame, number: int) -> None:
        # A batch number that was applied before starts from what the batches before it left.
        table.write(apply_changes(table.read(number), messages, table.key, order()), number)

    query = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


class LatestTable:
    """A snapshot kept as messages of which the newest of each key counts, whatever the order in which they arrive.

    Every load is a folder of its own, written whole or not at all, and a load that is run again replaces itself.  Deletes
    stay as rows, so what history brings late never revives or overwrites anything newer.

    schema: DDL of all columns, with an integer column seq, the message's place in the source's order.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), f"{schema}, _gone boolean", key
        spark.createDataFrame([], self.schema).write.mode("ignore").parquet(f"{self.path}/load=none")

    def read(self) -> DataFrame:
        every = self.spark.read.schema(self.schema).parquet(f"{self.path}/load=*")
        return fold(every, self.key, F.col("seq")).where("not _gone").drop("_gone")

    def load(self, messages: DataFrame, name: str, operation: str = "operation") -> None:
        """Messages reduced to the newest of each key, as the load of this name."""
        columns = [c.split()[0] for c in self.schema.split(", ")]
        newest = fold(messages.withColumn("_gone", F.col(operation) == "delete").select(*columns), self.key, F.col("seq"))
        newest.write.mode("overwrite").parquet(f"{self.path}/load={name}")

    def loads(self) -> set[str]:
        """Names of the loads that are complete."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = (s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("load="))
        return {p.getName().removeprefix("load=") for p in done if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}


class TwoPhaseSync:
    """Recent rows first, so that readers can begin; then history, range by range, which may stop and go on at any place.

    source: messages with the table's columns, an operation and a date column; cut: dates from there on are recent; ranges:
    the history's ranges (from, up to), newest first.  Live messages may be loaded at any time between.
    """

    def __init__(self, table: LatestTable, source: DataFrame, date: str, cut: str, ranges: list[tuple[str, str]], operation: str = "operation"):
        self.table, self.source, self.date, self.cut, self.ranges, self.operation = table, source, F.col(date), cut, ranges, operation

    def recent(self) -> None:
        if "recent" not in self.table.loads():
            self.table.load(self.source.where(self.date >= F.lit(self.cut).cast("date")), "recent", self.operation)

    def backfill(self, steps: int | None = None) -> bool:
        """Load the ranges that are not there yet, so many at most.  Whether history is complete then."""
        names = [f"history-{a}-{b}" for a, b in self.ranges]
        open_ = [(n, r) for n, r in zip(names, self.ranges, strict=True) if n not in self.table.loads()]
        for name, (low, high) in open_[: len(open_) if steps is None else steps]:
            inside = (self.date >= F.lit(low).cast("date")) & (self.date < F.lit(high).cast("date"))
            self.table.load(self.source.where(inside), name, self.operation)
        return steps is None or steps >= len(open_)

    def live(self, messages: DataFrame, name: str) -> None:
        self.table.load(messages, f"live-{name}", self.operation)


# ---------------------------------------------------------------- buffered messages


def buffered(messages: DataFrame, key: str, columns: list[str], size: int = 100, idle_ms: int = 50, buffers: int = 8) -> DataFrame:
    """Streaming messages through buffers that are emptied when they hold `size` messages, or when none has come for idle_ms.

    A key's messages share a buffer and keep their order of arrival by `seq`.  Adds _buffer, _flush (the buffer's n-th) and
    _place in it.  State is what buffers hold: size messages each at most, however many a batch brings.
    """
    kinds = {f.name: f.dataType.simpleString() for f in messages.schema if f.name in columns}
    output = ", ".join([*(f"{c} {kinds[c]}" for c in columns), "_buffer int, _flush bigint, _place int"])
    held = ", ".join([*(f"{c} array<{kinds[c]}>" for c in columns), "flushes bigint"])

    def emit(frame: pd.DataFrame, buffer: int, flush: int) -> pd.DataFrame:
        return frame.assign(_buffer=buffer, _flush=flush, _place=range(len(frame)))[[*columns, "_buffer", "_flush", "_place"]]

    def run(group: tuple, frames, state):
        kept, flush = pd.DataFrame({c: pd.Series([], dtype=object) for c in columns}), 0
        if state.exists:
            *lists, flush = state.get
            kept = pd.DataFrame({c: pd.Series(list(x), dtype=object) for c, x in zip(columns, lists, strict=True)})
        if state.hasTimedOut:
            yield emit(kept, int(group[0]), flush)
            kept, flush = kept[:0], flush + 1
        else:
            parts = [kept, *(f[columns].astype(object).where(f[columns].notna(), None) for f in frames)]
            every = pd.concat([p for p in parts if len(p)], ignore_index=True) if any(map(len, parts)) else kept
            every = every.sort_values("seq", kind="stable", ignore_index=True)
            while len(every) >= size:
                yield emit(every[:size].reset_index(drop=True), int(group[0]), flush)
                every, flush = every[size:].reset_index(drop=True), flush + 1
            kept = every
        state.update((*(kept[c].tolist() for c in columns), flush))
        if len(kept):
            state.setTimeoutDuration(idle_ms)

    keyed = messages.withColumn("_buffer", F.pmod(F.xxhash64(key), F.lit(buffers)).cast("int"))
    return keyed.groupBy("_buffer").applyInPandasWithState(run, output, held, "append", "ProcessingTimeTimeout")


def run_buffered(messages: DataFrame, table: LatestTable, columns: list[str], checkpoint: str, size: int = 100, idle_ms: int = 50, buffers: int = 8, batches: int | None = None) -> None:
    """Pass a stream through buffers into a table until nothing has come or been emptied for a while (longer than any buffer
    waits), or until so many batches have run, and stop.  A batch that is run again writes its own load again."""
    at = {"last": time.monotonic(), "batch": -1, "quiet": 0}

    def flush(rows: DataFrame, number: int) -> None:
        rows = rows.persist()  # buffers are worked through once a batch
        try:
            if rows.count():
                table.load(rows, f"flush-{number}")
                at.update(last=time.monotonic(), quiet=0)
        finally:
            rows.unpersist()

    query = buffered(messages, table.key, columns, size, idle_ms, buffers).writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    try:
        while query.isActive:
            done = query.lastProgress
            if done is not None and done["batchId"] != at["batch"]:
                at.update(batch=done["batchId"], quiet=at["quiet"] + 1)
                if done["numInputRows"]:
                    at.update(last=time.monotonic(), quiet=0)
            if batches is not None and at["batch"] + 1 >= batches or at["quiet"] > 2 and time.monotonic() - at["last"] > 2 * idle_ms / 1000:
                break
            time.sleep(0.05)
    finally:
        query.stop()
    if query.exception() is not None:
        raise query.exception()
