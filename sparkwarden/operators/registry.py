"""Offenders that are found or created, one row an identity, while several jobs do so at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwarden.functions import text
from sparkwarden.operators.entities import best_candidate
from sparkwarden.plans.storage import keep
from sparkwarden.plans.versioned import VersionedTable, retried


def numbered_densely(df: DataFrame, order: list[str], first: int, name: str = "id") -> DataFrame:
    """df with whole numbers from first on, in order: rows are range-partitioned, counted, and numbered within each part."""
    ranged = keep(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    bases = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.join(F.broadcast(bases), "_p").withColumn(name, (F.col("_base") + place + (first - 1)).cast("bigint")).drop("_p", "_base")


class Registry:
    """Rows (id, name, postcode, key): key is the comparable name; key and postcode (null is a postcode of its own) are unique.

    What a batch creates is published as one version; where another batch has published in the meantime, the batch is
    matched again with what is there now, so no identity is created twice.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.table = VersionedTable(spark, path, "id bigint, name string, postcode string, key string", "batch")

    def rows(self) -> DataFrame:
        return self.table.read().drop("batch")

    def find_or_create(self, batch: DataFrame, similar: bool = True, before_publish: Callable[[], None] | None = None) -> DataFrame:
        """batch: (ref, name, postcode).  (ref, offender_id, created): the row of the same identity, else (if similar) the best
        similar one, else a new one; rows of one new identity share it.  A blank name has none (null)."""
        found: list[DataFrame] = []
        own = batch.select("ref", F.trim("name").alias("name"), F.upper(F.trim("postcode")).alias("postcode")).withColumn("key", text.company_name(F.col("name")))

        def attempt() -> int:
            version = self.table.version()
            known = self.table.read(version).select("id", "name", "postcode", "key")
            same = known.groupBy("key", "postcode").agg(F.min("id").alias("_same")).alias("k")
            named = own.where("key != ''").alias("o")
            met = named.join(same, (F.col("o.key") == F.col("k.key")) & F.col("o.postcode").eqNullSafe(F.col("k.postcode")), "left").select("o.*", "_same")
            met = keep(met, "registry-same")
            close = met.select("ref", F.lit(None).cast("bigint").alias("_close")).limit(0)
            if similar:
                close = best_candidate(met.where("_same is null").select("ref", "name", "postcode"), known.select("id", "name", "postcode")).select("ref", F.col("offender_id").alias("_close"))
            near = keep(met.join(close, "ref", "left").withColumn("_id", F.coalesce("_same", "_close")), "registry-near")
            new = near.where("_id is null").groupBy("key", "postcode").agg(F.min_by("name", "ref").alias("name"))
            last = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
            made = keep(numbered_densely(new, ["key", "postcode"], last + 1), "registry-new").alias("n")
            joined = near.alias("o").join(made, (F.col("o.key") == F.col("n.key")) & F.col("o.postcode").eqNullSafe(F.col("n.postcode")) & F.col("o._id").isNull(), "left")
            done = joined.select("o.ref", F.coalesce("o._id", "n.id").alias("offender_id"), (F.col("o._id").isNull()).alias("created"))
            nameless = own.where("key is null or key = ''").select("ref", F.lit(None).cast("bigint").alias("offender_id"), F.lit(False).alias("created"))
            found[:] = [keep(done.unionByName(nameless), "registry-found")]
            if before_publish is not None:
                before_publish()
            if made.isEmpty():
                return version
            part = version + 1
            return self.table.replace(made.select("id", "name", "postcode", "key", F.lit(part).alias("batch")), [part], base=version)

        retried(attempt)
        return found[0]
