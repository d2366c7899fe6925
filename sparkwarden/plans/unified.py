"""The unified fact: cases and notices in one frame, the missing side null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def case_rows(cases: DataFrame) -> DataFrame:
    return cases.select(F.lit("case").alias("record_type"), "id", "action_date", "action_type", "offender_id", "fine", "costs", "result")


def notice_rows(notices: DataFrame) -> DataFrame:
    return notices.select(F.lit("notice").alias("record_type"), "id", "action_date", "action_type", "offender_id")


def unified(cases: DataFrame, notices: DataFrame, record_type: str | None = None) -> DataFrame:
    """UNION ALL; a record_type leaves one branch, the other becomes an empty relation that the optimizer removes."""
    a, b = case_rows(cases), notice_rows(notices)
    if record_type == "case":
        b = b.where(F.lit(False))
    elif record_type == "notice":
        a = a.where(F.lit(False))
    return a.unionByName(b, allowMissingColumns=True)


def with_names(fact: DataFrame, offenders: DataFrame, agencies: DataFrame | None = None, unknown: str = "Unknown Organization") -> DataFrame:
    """N:1 joins to the dimensions; a fact without its offender stays, under a placeholder name."""
    o = offenders.select(F.col("id").alias("offender_id"), F.col("name").alias("offender_name"), "agency_id")
    out = fact.join(o, "offender_id", "left").withColumn("offender_name", F.coalesce("offender_name", F.lit(unknown)))
    if agencies is not None:
        out = out.join(agencies.select(F.col("id").alias("agency_id"), F.col("code").alias("agency_code"), F.col("name").alias("agency_name")), "agency_id", "left")
    return out


def nested_offences(offences: DataFrame, cases: DataFrame, notices: DataFrame, legislation: DataFrame) -> DataFrame:
    """Offences (with case_id, notice_id, legislation_id) with the structs case, notice and legislation, null where there is none."""
    c = cases.select(F.col("id").alias("case_id"), F.struct("id", "result", F.date_format("action_date", "yyyy-MM-dd").alias("date")).alias("case"))
    n = notices.select(F.col("id").alias("notice_id"), F.struct("id", F.col("action_type").alias("type")).alias("notice"))
    l = legislation.select(F.col("id").alias("legislation_id"), F.struct("id", "title", "year").alias("legislation"))  # noqa: E741
    return offences.join(c, "case_id", "left").join(n, "notice_id", "left").join(l, "legislation_id", "left")


def recent_activity(fact: DataFrame, offenders: DataFrame, agencies: DataFrame, n: int = 100) -> DataFrame:
    """Latest n rows by date; the sort and limit run before the joins, which then see n rows only."""
    latest = fact.where("action_date is not null").orderBy(F.col("action_date").desc(), "record_type", "id").limit(n)
    return with_names(latest, offenders, agencies).select("record_type", "id", "action_date", "action_type", "fine", "costs", "offender_name", "agency_name", (F.col("record_type") == "case").alias("is_case"))
