"""Aggregate reports.  Each is one or two hash aggregates; shares come from a second aggregate of the first's few rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.plans.storage import keep


def count_if(c: Column) -> Column:
    return F.count(F.when(c, 1))


def total(c: Column | str) -> Column:
    """A sum that is 0 over no rows."""
    return F.coalesce(F.sum(c), F.lit(0))


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percentage, 0 where the whole is 0."""
    return F.when(whole > 0, F.round(part * 100.0 / whole, digits)).otherwise(0.0)


def recent_stats(fact: DataFrame, age: Column, days: int) -> DataFrame:
    """One row over a unified fact: cases, notices, fines and costs of the last days, in one pass."""
    recent = age <= days
    case = F.col("record_type") == "case"
    return fact.agg(
        count_if(recent & case).alias("recent_cases"),
        count_if(recent & ~case).alias("recent_notices"),
        total(F.when(recent, F.col("fine"))).cast("double").alias("total_fines"),
        total(F.when(recent, F.col("costs"))).cast("double").alias("total_costs"),
    )


def breakdown(fact: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Counts of cases and notices for every row of a dimension (zeros kept) with shares of all cases and of all actions."""
    case = F.col("record_type") == "case"
    counts = fact.groupBy(key).agg(count_if(case).alias("cases"), count_if(~case).alias("notices"), total("fine").alias("fines"))
    rows = dimension.select(F.col("id").alias(key), "code", "name").join(counts, key, "left").na.fill(0, ["cases", "notices"]).withColumn("fines", F.coalesce("fines", F.lit(0)))
    sums = rows.agg(F.sum("cases").alias("_c"), F.sum(F.col("cases") + F.col("notices")).alias("_a"))
    return rows.join(F.broadcast(sums)).select(
        "code", "name", "cases", "notices", F.col("fines").cast("double").alias("fines"), share(F.col("cases"), F.col("_c")).alias("case_pct"), share(F.col("cases") + F.col("notices"), F.col("_a")).alias("action_pct")
    )


def metric_cube(fact: DataFrame, age: Column, key: str, periods: dict[str, int]) -> DataFrame:
    """Period x (all, each key): one scan, one shuffle.  Each row falls into every period that holds it; grouping sets add
    the row over all keys, told apart by is_total and not by a null key."""
    case = F.col("record_type") == "case"
    return _cube(fact, age, key, periods, count_if(case).alias("cases"), count_if(~case).alias("notices"), total("fine").cast("double").alias("fines"), total("costs").cast("double").alias("costs"))


def merged_cube(partials: DataFrame, age: Column, key: str, periods: dict[str, int]) -> DataFrame:
    """The same cube from partial sums (cases, notices, fines, costs) of one offender each."""
    money = [total(c).cast("double").alias(c) for c in ("fines", "costs")]
    return _cube(partials, age, key, periods, *[F.sum(c).alias(c) for c in ("cases", "notices")], *money)


def _cube(rows: DataFrame, age: Column, key: str, periods: dict[str, int], *sums: Column) -> DataFrame:
    names = F.array(*[F.struct(F.lit(n).alias("period"), F.lit(d).alias("days")) for n, d in periods.items()])
    in_period = rows.withColumn("_age", age).where(F.col("_age") <= max(periods.values()))
    spread = in_period.withColumn("_p", F.explode(F.filter(names, lambda p: F.col("_age") <= p["days"]))).withColumn("period", F.col("_p.period"))
    groups = spread.groupingSets([[F.col("period")], [F.col("period"), F.col(key)]], F.col("period"), F.col(key))
    return groups.agg((F.grouping(key) == 1).alias("is_total"), *sums, F.count_distinct("offender_id").alias("offenders"))


def by_group(df: DataFrame, group: Column, value: Column, unknown: str = "Unknown") -> DataFrame:
    """Count, sum and average (sum / count) by a label; null and empty labels are one group, null values are 0."""
    label = F.coalesce(F.nullif(group, F.lit("")), F.lit(unknown))
    v = F.coalesce(value, F.lit(0))
    return df.groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.sum(v).cast("double").alias("total"), F.round(F.sum(v).cast("double") / F.count("*"), 2).alias("average"))


def histogram(df: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """Counts and sums in [edge, next edge), the last without end; null is 0, values under the first edge are left out, empty buckets stay."""
    v = F.coalesce(value.cast("double"), F.lit(0.0))
    bucket = F.lit(None).cast("int")
    for i, e in enumerate(edges):
        bucket = F.when(v >= e, i).otherwise(bucket)
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.coalesce(value, F.lit(0))).cast("double").alias("total")).where("bucket is not null")
    every = df.sparkSession.range(len(edges)).select(F.col("id").cast("int").alias("bucket"))
    low = F.element_at(F.array(*map(F.lit, edges)), F.col("bucket") + 1)
    return every.join(counts, "bucket", "left").select("bucket", low.alias("low"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


def statistics(df: DataFrame, value: Column) -> DataFrame:
    """Over values above 0: count, sum, mean, median, min, max; zeros when there are none."""
    v = value.cast("double")
    got = df.where(v > 0).agg(F.count("*").alias("n"), F.sum(value).cast("double").alias("total"), F.round(F.avg(value), 4).cast("double").alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"))
    middle = at_ranks(df.select(v.alias("_v")).where("_v > 0"), "_v", {"_x": lambda n: F.floor((n + 1) / 2), "_y": lambda n: F.ceil((n + 1) / 2)})
    both = got.crossJoin(middle).withColumn("median", (F.col("_x") + F.col("_y")) / 2)  # a row each
    return both.select("n", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("total", "mean", "median", "low", "high")])


def at_ranks(df: DataFrame, value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row: the values of df at these ranks, each a function of the number of values (nulls apart).

    Distinct values are counted map-side and range-partitioned; running counts within partitions and over the partitions'
    sums find each rank, so no task sees more than its range.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ranged = keep(counted.repartitionByRange("_v").withColumn("_p", F.spark_partition_id()), "ranks")
    parts = ranged.groupBy("_p").agg(F.sum("_n").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    whole = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = parts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(whole).alias("_total"))
    up_to = F.col("_base") + F.sum("_n").over(Window.partitionBy("_p").orderBy("_v"))
    placed = ranged.join(F.broadcast(sums), "_p").withColumn("_last", up_to)
    here = lambda rank: (rank > F.col("_last") - F.col("_n")) & (rank <= F.col("_last"))
    return placed.agg(*[F.max(F.when(here(rank(F.col("_total"))), F.col("_v"))).alias(name) for name, rank in ranks.items()])


def nearest_rank(df: DataFrame, value: str, percents: list[int]) -> DataFrame:
    """Nearest-rank percentiles: the ceil(n p / 100)-th smallest value."""
    return at_ranks(df, value, {f"p{p}": lambda n, p=p: F.greatest(F.lit(1), F.ceil(n * p / 100)) for p in percents})


def run_metrics(df: DataFrame, success: Column, latency: str, percents: list[int]) -> DataFrame:
    """One row on runs: total, successful, failed, success_rate in percent, avg_latency, percentiles of the latency, and
    throughput_per_hour of runs one after the other (latency in milliseconds)."""
    n, good = F.count("*"), F.count_if(success)
    rate = F.when(n > 0, F.round(100.0 * good / n, 1)).otherwise(0.0)
    per_hour = F.when(F.sum(latency) > 0, F.round(n / (F.sum(latency) / 3600000), 1)).otherwise(0.0)
    counts = df.agg(n.alias("total"), good.alias("successful"), (n - good).alias("failed"), rate.alias("success_rate"), F.coalesce(F.round(F.avg(latency), 1), F.lit(0.0)).alias("avg_latency"), per_hour.alias("throughput_per_hour"))
    return counts.crossJoin(nearest_rank(df, latency, percents))  # a row each


def distinct_sets(fact: DataFrame, key: str, value: str) -> DataFrame:
    """The sorted set of values of each key."""
    return fact.where(f"{value} is not null").groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("values"))


def ordered_summary(items: DataFrame, key: str, text: Column, order: list[Column], by: str = "; ") -> DataFrame:
    """Texts of each key joined in order (nulls last); the group is one parent's children."""
    item = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], text.alias("t"))
    return items.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), by).alias("summary"))


def peer_context(df: DataFrame, group: str, value: str) -> DataFrame:
    """Each row against the others of its group: how many there are, their average, and a label.

    Two aggregates and a join on the group, not a window, so no group is held by one task.
    """
    sums = df.groupBy(group).agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    average = F.when(F.col("_n") > 1, ((F.col("_s") - F.col(value)) / (F.col("_n") - 1)).cast("double"))
    v = F.col(value).cast("double")
    label = F.when(average.isNull(), "No peers").when(v > 2 * average, "Well above average").when(v > average, "Above average").otherwise("Average or below")
    return df.join(sums, group).withColumns({"peers": F.col("_n") - 1, "peer_average": F.round(average, 2), "context": label}).drop("_n", "_s")


def top_peers(df: DataFrame, group: str, value: str, n: int = 5) -> DataFrame:
    """Every row with the n best other rows of its group: ranked once a group (n + 1 rows suffice), then joined."""
    w = Window.partitionBy(group).orderBy(F.col(value).desc(), "id")
    best = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n + 1).select(group, F.col("id").alias("peer_id"), F.col(value).alias("peer_value"), "_r")
    pairs = df.select("id", group).join(best, group).where("id != peer_id")
    place = Window.partitionBy("id").orderBy("_r")
    return pairs.withColumn("place", F.row_number().over(place)).where(F.col("place") <= n).select("id", "place", "peer_id", "peer_value")


def parts_by_size(df: DataFrame, each: int = 16 << 20) -> int:
    """How many parts of about `each` bytes (as the optimizer estimates them) df makes, so that a task's share does not grow
    with df; Spark's own number of shuffle partitions at least."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // each), 20_000))
