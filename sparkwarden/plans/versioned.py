"""Tables that are replaced in parts, one whole version at a time.

Data is written aside; a version is a small file that names the folder of each partition, and it is put in place by one
rename.  A reader opens the newest version, so it sees all of it or none; folders of partitions that a version does not
touch are shared with the version before.  Two writers that start from the same version cannot both follow it: the second
finds its number taken and raises `Conflict`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Another writer has published the version that this one was to be."""


class VersionedTable:
    """path: shared storage; schema: DDL without the partition column; partition: its name (an integer)."""

    def __init__(self, spark: SparkSession, path: str, schema: str, partition: str):
        self.spark, self.path, self.schema, self.partition = spark, path.rstrip("/"), schema, partition

    def _files(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        return jvm, at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version's number; 0 before the first."""
        _, at, fs = self._files()
        if not fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def folders(self, version: int | None = None) -> dict[int, str]:
        """Partition -> the folder that holds it in a version (default: the newest)."""
        n = self.version() if version is None else version
        if not n:
            return {}
        line = self.spark.read.text(f"{self.path}/versions/{n:012d}.json", wholetext=True).first()[0]
        return {int(k): v for k, v in json.loads(line).items()}

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of one version; it does not change when later ones are published."""
        found = self.folders(version)
        if not found:
            return self.spark.createDataFrame([], f"{self.schema}, {self.partition} int")
        paths = [f"{self.path}/data/{folder}/{self.partition}={k}" for k, folder in sorted(found.items())]
        return self.spark.read.schema(f"{self.schema}, {self.partition} int").option("basePath", f"{self.path}/data").parquet(*paths).select(*[c.split()[0] for c in self.schema.split(", ")], self.partition)

    def replace(self, rows: DataFrame, partitions: list[int], base: int | None = None) -> int:
        """Publish a version in which these partitions hold rows, all others what they held.  Returns its number.

        base: the version that rows were made from, if they depend on one; a newer one then is a conflict.
        """
        base, folder = self.version() if base is None else base, f"w={uuid.uuid4().hex}"
        held = self.folders(base)
        rows.repartition(self.partition).write.partitionBy(self.partition).parquet(f"{self.path}/data/{folder}")
        written = {r[0] for r in self.spark.read.schema(f"{self.schema}, {self.partition} int").parquet(f"{self.path}/data/{folder}").select(self.partition).distinct().collect()}
        if not written <= set(partitions):
            raise ValueError(f"rows of other partitions: {sorted(written - set(partitions))}")
        kept = {k: v for k, v in held.items() if k not in set(partitions)} | dict.fromkeys(written, folder)
        self._publish(base + 1, kept)
        return base + 1

    def _publish(self, number: int, folders: dict[int, str]) -> None:
        jvm, at, fs = self._files()
        fs.mkdirs(at)
        aside, place = jvm.org.apache.hadoop.fs.Path(at, f".{uuid.uuid4().hex}"), jvm.org.apache.hadoop.fs.Path(at, f"{number:012d}.json")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps({str(k): v for k, v in sorted(folders.items())}).encode()))
        out.close()
        if fs.exists(place) or not fs.rename(aside, place):
            fs.delete(aside, False)
            raise Conflict(f"version {number} exists")


def retried(attempt: Callable[[], int], times: int = 5) -> int:
    """Run attempt again, from what is newest then, while others publish first."""
    for left in range(times - 1, -1, -1):
        try:
            return attempt()
        except Conflict:
            if not left:
                raise
    raise AssertionError
