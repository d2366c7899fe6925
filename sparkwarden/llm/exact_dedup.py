"""Operator 9: exact de-duplication against a persistent digest index.

The index is a table bucketed and sorted by the digest.  New rows are reduced to one representative of each digest,
anti-joined with the index by sort-merge (the index side needs no shuffle), and what is new is appended.

Only DataFrame functions run here.  Only ids, lengths and 32-byte digests are shuffled; copies are counted map-side
before the shuffle, and the rows of a digest that very many share are joined apart, by broadcast of those digests.

A batch has a name.  Running a batch again, after a failure or to ask again, gives the answer of its first run: digests
that it brought itself are its own.

Defined cases: a null text equals the empty text; of equal lengths the smallest id stays (a null id loses to every
other); repeated rows (one id, one text) count in group_size and are one document, so each carries the same kept; an empty table gives an empty result and leaves the index as it is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm.common import join_unique, save, work_dir

#: Deleted before texts are compared: tab, line feed, vertical tab, form feed, carriage return, space (fixed values).
SPACE = "\t\n\x0b\x0c\r "


def normalised(text: Column) -> Column:
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _points, _digest) of every row."""
    return df.select(F.col(id_col).alias("_id"), F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("bigint").alias("_points"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("_digest"))


class DigestIndex:
    """A persistent index: digest, keep_id, n_points, group_size, batch; one row for each distinct text ever seen.

    path: where it lives (shared storage); buckets: chosen once, at creation, as the cluster's shuffle partitions.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, id_type: str = "bigint", name: str | None = None):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or work_dir(spark, "digest-index")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id {id_type}, n_points BIGINT, group_size BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append_new(self, groups: DataFrame, batch: str) -> None:
        """Add those of groups (see grouped()) whose digest the index lacks."""
        known = self.rows().select("digest").hint("merge")
        new = groups.join(known, "digest", "left_anti").withColumn("batch", F.lit(batch))
        new.select("digest", "keep_id", "n_points", "group_size", "batch").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def compacted(self, path: str | None = None, buckets: int | None = None) -> DigestIndex:
        """A new index with the same rows in one sorted file a bucket; every append adds a file to the buckets it touches."""
        id_type = self.rows().schema["keep_id"].dataType.simpleString()
        out = DigestIndex(self.spark, path, buckets or self.buckets, id_type)
        # Read as plain files: a bucketed scan counts as partitioned already, with as many files as were appended.
        rows = self.spark.read.schema(self.rows().schema).parquet(self.path)
        rows.repartition(out.buckets, "digest").sortWithinPartitions("digest").write.insertInto(out.name)
        self.spark.catalog.refreshTable(out.name)
        return out


def grouped(hashed: DataFrame) -> DataFrame:
    """hashed: see digests().  (digest, keep_id, n_points, group_size) of each digest."""
    first = F.min_by("_id", F.struct(-F.col("_points"), F.col("_id").isNull(), F.col("_id")))
    return hashed.groupBy(F.col("_digest").alias("digest")).agg(first.alias("keep_id"), F.max("_points").alias("n_points"), F.count("*").alias("group_size"))


def deduplicate(df: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """One row for each row of df: the id, keep_id, group_size (in the batch that brought the text), kept, text_sha256.

    Rows whose text an earlier batch of the index holds are not kept: their keep_id is that batch's.  batch names these
    rows, so that a job which is run again finds its own; without a name every call is a new batch.
    """
    batch = batch or uuid.uuid4().hex
    hashed = save(digests(df, id_col, text_col), "digests")  # whole texts are read and hashed once
    index = index or DigestIndex(df.sparkSession, id_type=hashed.schema["_id"].dataType.simpleString())
    groups = save(grouped(hashed), "digest-groups")
    index.append_new(groups, batch)
    known = index.rows().select(F.col("digest").alias("_digest"), "keep_id", "group_size", "batch").hint("merge")
    known = known.join(groups.select(F.col("digest").alias("_digest"), F.col("group_size").alias("_n")), "_digest")
    kept = (F.col("batch") == batch) & F.col("_id").eqNullSafe(F.col("keep_id"))
    return join_unique(hashed, known, "_digest", "_n").select(F.col("_id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"))


def keep_first(df: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """The rows of df that stay, with their columns; of repeated rows (one id, one text) one."""
    stay = deduplicate(df, index, id_col, text_col, batch).where("kept").select(F.col(id_col).alias("_id"), F.unhex("text_sha256").alias("_digest")).distinct()
    return rows_that_stay(df, stay, [F.col(id_col), F.unhex(F.sha2(normalised(F.col(text_col)), 256))], ["_id", "_digest"])


def rows_that_stay(df: DataFrame, stay: DataFrame, keys: list[Column], stay_keys: list[str]) -> DataFrame:
    """Rows of df whose keys are in stay (nulls equal), each combination once, with df's columns, whatever their names.

    One digest of the keys serves both steps, so whole rows are shuffled once.
    """
    digest = lambda columns: F.sha2(F.to_json(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(columns)])), 256)
    names = df.columns
    own = df.select(digest(keys).alias("_where"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)])  # private names
    met = own.join(stay.select(digest([F.col(c) for c in stay_keys]).alias("_where")), "_where", "left_semi")
    return met.dropDuplicates(["_where"]).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])
