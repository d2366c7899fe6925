"""An append-only log of events whose state can be read as of any version, from a snapshot and the log's tail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.streaming.feed import fold


class EventLog:
    """Events have an increasing version, a key, an operation (delete, or anything else for a new state) and columns.

    They lie in segments of `segment` versions, one folder each, so a reader opens only the segments it needs.  Snapshots
    hold the newest event of each key up to a version, deletes included, so that the tail goes on from them.  A batch that is
    appended again changes nothing: events of one version are one event.

    schema: DDL of the columns besides version and operation; key: the column that identifies a row.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, segment: int = 10_000):
        self.spark, self.path, self.key, self.segment = spark, path.rstrip("/"), key, segment
        self.schema = f"{schema}, version bigint, operation string"
        self.columns = [c.split()[0] for c in self.schema.split(", ")]
        spark.createDataFrame([], self.schema).write.mode("ignore").parquet(f"{self.path}/events/segment=-1")

    def append(self, events: DataFrame) -> None:
        placed = events.select(*self.columns, F.expr(f"version div {self.segment}").alias("segment"))
        placed.repartition("segment").write.mode("append").partitionBy("segment").parquet(f"{self.path}/events")

    def tail(self, after: int, to: int) -> DataFrame:
        """Events of the versions after + 1 to `to`."""
        low, high = (after + 1) // self.segment, to // self.segment
        every = self.spark.read.schema(f"{self.schema}, segment bigint").parquet(f"{self.path}/events")
        return every.where(F.col("segment").between(low, high) & (F.col("version") > after) & (F.col("version") <= to)).select(*self.columns)

    def snapshots(self) -> list[int]:
        """Versions of the snapshots that are complete."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/snapshots")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        found = (s.getPath() for s in fs.listStatus(at))
        return sorted(int(p.getName().partition("=")[2]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _newest(self, version: int, base: int | None = None) -> DataFrame:
        known = [v for v in self.snapshots() if v <= version] if base is None else [base]
        at = known[-1] if known else -1
        rows = self.tail(at, version)
        if known:
            rows = rows.unionByName(self.spark.read.schema(self.schema).parquet(f"{self.path}/snapshots/version={at}"))
        return fold(rows, self.key, F.col("version"))

    def snapshot(self, version: int) -> None:
        """Keep the newest events as of a version, made from the snapshot before and the tail between."""
        if version not in self.snapshots():
            self._newest(version).write.mode("overwrite").parquet(f"{self.path}/snapshots/version={version}")

    def as_of(self, version: int) -> DataFrame:
        """The rows as they were after that version; folds the tail behind the last snapshot, not the whole log."""
        return self._newest(version).where("operation != 'delete'").drop("operation")
