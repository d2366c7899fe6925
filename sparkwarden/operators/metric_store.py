"""Materialised metrics: partial sums by month that are refreshed where facts have changed, and the cube read from them.

A partial row is what one offender did with one agency on one day: its counts and sums merge by addition, and distinct
offenders are counted from them without the facts.  Months are the partitions of a versioned table, so a refresh reads and
writes the touched months only, and readers keep a whole version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.operators.reports import merged_cube
from sparkwarden.plans.versioned import VersionedTable, retried

SCHEMA = "day date, agency_id int, offender_id bigint, cases bigint, notices bigint, fines decimal(28,2), costs decimal(28,2)"


def month_of(date: Column) -> Column:
    """Months counted from year 0, so that they are whole numbers in order."""
    return (F.year(date) * 12 + F.month(date) - 1).cast("int")


def partials(facts: DataFrame) -> DataFrame:
    """facts: (record_type, action_date, agency_id, offender_id, fine, costs).  Rows without a date are in no period."""
    case = F.col("record_type") == "case"
    grouped = facts.where("action_date is not null").groupBy(F.col("action_date").alias("day"), F.col("agency_id").cast("int").alias("agency_id"), F.col("offender_id").cast("bigint").alias("offender_id"))
    sums = grouped.agg(F.count_if(case).alias("cases"), F.count_if(~case).alias("notices"), *[F.coalesce(F.sum(c), F.lit(0)).cast("decimal(28,2)").alias(to) for c, to in (("fine", "fines"), ("costs", "costs"))])
    return sums.withColumn("month", month_of(F.col("day")))


class MetricStore:
    def __init__(self, spark: SparkSession, path: str):
        self.table = VersionedTable(spark, path, SCHEMA, "month")

    def refresh(self, facts: DataFrame, months: list[int] | None = None) -> int:
        """Recompute these months (default: all that facts or the store have) and publish them as one version."""
        if months is None:
            there = facts.where("action_date is not null").select(month_of(F.col("action_date")).alias("m")).distinct()
            months = sorted({r["m"] for r in there.collect()} | set(self.table.folders()))  # one number for each month
        if not months:
            return self.table.version()
        low, high = min(months), max(months)
        # Plain bounds on the date reach the scan; the months between are told apart behind it.
        first, after = (F.make_date(F.lit(m // 12), F.lit(m % 12 + 1), F.lit(1)) for m in (low, high + 1))
        touched = facts.where((F.col("action_date") >= first) & (F.col("action_date") < after) & month_of(F.col("action_date")).isin(months))
        return retried(lambda: self.table.replace(partials(touched), months))

    def changed_months(self, changed_days: DataFrame, date: str = "day") -> list[int]:
        return sorted(r[0] for r in changed_days.where(F.col(date).isNotNull()).select(month_of(F.col(date))).distinct().collect())

    def metrics(self, periods: dict[str, int], as_of: Column | None = None, version: int | None = None) -> DataFrame:
        """The metric cube (period, agency or all, cases, notices, fines, costs, offenders) from the partials."""
        rows = self.table.read(version)
        end = rows.agg(F.max("day")).scalar() if as_of is None else as_of
        aged = rows.withColumn("_age", F.datediff(end, F.col("day")))
        return merged_cube(aged, F.col("_age"), "agency_id", periods)
