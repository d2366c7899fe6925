"""File sources and sinks beyond plain parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_records(spark: SparkSession, path: str, record: T.StructType, multi_line: bool = True) -> DataFrame:
    """Files of {"records": [...]}: one row for each record, by a given schema (nothing is inferred).

    multi_line: each file is one object; otherwise each line is."""
    whole = T.StructType([T.StructField("records", T.ArrayType(record))])
    return spark.read.schema(whole).json(path, multiLine=multi_line).select(F.explode("records").alias("_r")).select("_r.*")


def positional_json(spark: SparkSession, path: str, names: list[str], multi_line: bool = True) -> DataFrame:
    """Paged table exports, {"data": [[...], ...]}: array positions become columns; shorter rows are filled with null."""
    whole = T.StructType([T.StructField("data", T.ArrayType(T.ArrayType(T.StringType())))])
    rows = spark.read.schema(whole).json(path, multiLine=multi_line).select(F.explode("data").alias("_r"))
    return rows.select(*[F.get("_r", F.lit(i)).alias(n) for i, n in enumerate(names)])


def csv_with_required(spark: SparkSession, path: str, names: list[str], required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(complete rows, rows that lack a required field), all as text."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')
    lacking = F.lit(False)
    for n in required:
        lacking = lacking | (F.trim(F.coalesce(F.col(n), F.lit(""))) == "")
    return rows.where(~lacking), rows.where(lacking)


def write_csv(df: DataFrame, path: str, columns: dict[str, str]) -> None:
    """Columns under their export names, quoted where needed, nulls empty."""
    df.select(*[F.col(c).alias(n) for c, n in columns.items()]).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", escape='"')


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_new(df: DataFrame, path: str, key: str) -> dict[str, int]:
    """Append the rows whose key the stored table lacks; counts of created and skipped rows."""
    spark = df.sparkSession
    stored = spark.read.schema(df.schema).parquet(path)
    marked = df.join(stored.select(key, F.lit(True).alias("_known")).distinct(), key, "left")
    counts = marked.agg(F.count(F.when(F.col("_known").isNull(), 1)).alias("created"), F.count("_known").alias("skipped")).first()
    df.join(stored.select(key), key, "left_anti").write.mode("append").parquet(path)
    return counts.asDict()


def without_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The next snapshot after a delete by id (plain parquet has no DELETE)."""
    return df.join(ids.select(key), key, "left_anti")
