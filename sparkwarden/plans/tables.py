"""The roles of the domain and their stand-ins among the test tables.

Every operator takes frames with role columns, so it runs on domain tables and on these stand-ins alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact A.  costs has no stand-in column, so it is a rule of the id."""
    o = load(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.to_date("o_orderdate").alias("action_date"),
        F.col("o_totalprice").cast(MONEY).alias("fine"),
        (F.col("o_orderkey") % 100).cast(MONEY).alias("costs"),
        F.col("o_orderpriority").alias("action_type"),
        F.col("o_orderstatus").alias("result"),
        F.col("o_custkey").alias("offender_id"),
    )


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact B."""
    e = load(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.to_date("ts").alias("action_date"), F.col("event_type").alias("action_type"), F.col("user_id").alias("offender_id"))


def offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("industry"), F.col("c_nationkey").alias("agency_id"), F.col("c_acctbal").cast(MONEY).alias("balance"))


def agencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("code"), F.col("n_name").alias("name"), (F.col("n_regionkey") != 0).alias("enabled"))


def offences(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = load(spark, sf_dir, "lineitem")
    return i.select(
        F.col("l_orderkey").alias("case_id"),
        F.col("l_linenumber").alias("sequence"),
        F.col("l_partkey").alias("legislation_id"),
        F.col("l_suppkey").alias("part_no"),
        F.col("l_extendedprice").cast(MONEY).alias("fine"),
        F.col("l_returnflag").alias("flag"),
    )


def legislation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("type"), (F.col("p_size") + 1960).alias("year"), F.col("p_brand").alias("number"))


def with_agency(fact: DataFrame, offenders_: DataFrame) -> DataFrame:
    """A fact's agency comes from its offender here; unmatched rows keep a null agency."""
    return fact.join(offenders_.select(F.col("id").alias("offender_id"), "agency_id"), "offender_id", "left")


def age_days(df: DataFrame, date: str = "action_date") -> Column:
    """Days before the fact's own latest date, the default as_of (facts need not overlap in time)."""
    return F.datediff(df.agg(F.max(date)).scalar(), F.col(date))


def day(c: str | Column) -> Column:
    """ISO text of a date."""
    return F.date_format(c, "yyyy-MM-dd")


def as_double(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")
