"""Aggregations, the metric cube and dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwarden.functions import values
from sparkwarden.operators import reports as R
from sparkwarden.plans import tables as T
from sparkwarden.plans import unified as U
from sparkwarden.queries import query

PERIODS = {"week": 7, "month": 30, "year": 365}
EDGES = [0.0, 1000.0, 5000.0, 10000.0, 50000.0, 100000.0]

AGED = """, aged AS (SELECT f.*, date_diff('day', action_date, CASE record_type WHEN 'case' THEN (SELECT max(action_date) FROM cases) ELSE (SELECT max(action_date) FROM notices) END) AS age FROM facts f)"""


def aged(s, d):
    """The unified fact with its age in days before each fact's own latest date."""
    c, n = T.cases(s, d), T.notices(s, d)
    return U.unified(c.withColumn("id", F.col("id")), n).withColumn("age", F.datediff(F.when(F.col("record_type") == "case", c.agg(F.max("action_date")).scalar()).otherwise(n.agg(F.max("action_date")).scalar()), "action_date"))


def aged_by_agency(s, d):
    return T.with_agency(aged(s, d), T.offenders(s, d))


@query(AGED + """ SELECT count(*) FILTER (WHERE age <= 365 AND record_type = 'case') AS recent_cases, count(*) FILTER (WHERE age <= 365 AND record_type = 'notice') AS recent_notices,
CAST(coalesce(sum(fine) FILTER (WHERE age <= 365), 0) AS DOUBLE) AS total_fines, CAST(coalesce(sum(costs) FILTER (WHERE age <= 365), 0) AS DOUBLE) AS total_costs FROM aged""")
def a01_recent_stats(s, d):
    return R.recent_stats(aged(s, d), F.col("age"), 365)


@query(""" SELECT record_type, count(*) AS n FROM facts GROUP BY record_type""")
def a02_total_counts(s, d):
    return U.unified(T.cases(s, d), T.notices(s, d)).groupBy("record_type").agg(F.count("*").alias("n"))


@query(AGED + """ SELECT count(*) AS offences FROM offences WHERE case_id IN (SELECT id FROM aged WHERE record_type = 'case' AND age <= 365)""")
def a03_recent_offences(s, d):
    recent = aged(s, d).where("record_type = 'case' and age <= 365").select(F.col("id").alias("case_id"))
    return T.offences(s, d).join(recent, "case_id", "left_semi").agg(F.count("*").alias("offences"))


@query(AGED + """, r AS (SELECT a.*, o.agency_id FROM aged a LEFT JOIN offenders o ON a.offender_id = o.id WHERE age <= 365),
k AS (SELECT g.code, g.name, count(r.id) FILTER (WHERE record_type = 'case') AS cases, count(r.id) FILTER (WHERE record_type = 'notice') AS notices, CAST(coalesce(sum(fine), 0) AS DOUBLE) AS fines FROM agencies g LEFT JOIN r ON r.agency_id = g.id GROUP BY ALL)
SELECT code, name, cases, notices, fines, CASE WHEN sum(cases) OVER () > 0 THEN round(cases * 100.0 / sum(cases) OVER (), 1) ELSE 0 END AS case_pct,
CASE WHEN sum(cases + notices) OVER () > 0 THEN round((cases + notices) * 100.0 / sum(cases + notices) OVER (), 1) ELSE 0 END AS action_pct FROM k""")
def a04_agency_breakdown(s, d):
    return R.breakdown(aged_by_agency(s, d).where("age <= 365"), T.agencies(s, d), "agency_id")


@query(""" SELECT count(*) AS active FROM agencies WHERE enabled""")
def a05_active_agencies(s, d):
    return T.agencies(s, d).where("enabled").agg(F.count("*").alias("active"))


@query(AGED + """, p(period, days) AS (VALUES ('week', 7), ('month', 30), ('year', 365)), x AS (SELECT a.*, o.agency_id, p.period FROM aged a LEFT JOIN offenders o ON a.offender_id = o.id JOIN p ON a.age <= p.days)
SELECT period, coalesce(x.agency_id, -1) AS agency_id, grouping(x.agency_id) = 1 AS is_total, count(*) FILTER (WHERE record_type = 'case') AS cases, count(*) FILTER (WHERE record_type = 'notice') AS notices, CAST(coalesce(sum(fine), 0) AS DOUBLE) AS fines, CAST(coalesce(sum(costs), 0) AS DOUBLE) AS costs, count(DISTINCT offender_id) AS offenders
FROM x GROUP BY GROUPING SETS ((period), (period, x.agency_id))""")
def a06_metric_cube(s, d):
    cube = R.metric_cube(aged_by_agency(s, d), F.col("age"), "agency_id", PERIODS)
    return cube.withColumn("agency_id", F.coalesce("agency_id", F.lit(-1)))


@query(""" SELECT o.agency_id, count(*) AS cases, CAST(sum(fine) AS DOUBLE) AS fines, strftime(max(action_date), '%Y-%m-%d') AS last_date FROM cases c JOIN offenders o ON c.offender_id = o.id GROUP BY o.agency_id""")
def a07_agency_aggregates(s, d):
    c = T.cases(s, d).join(T.offenders(s, d).select(F.col("id").alias("offender_id"), "agency_id"), "offender_id")
    return c.groupBy("agency_id").agg(F.count("*").alias("cases"), F.sum("fine").cast("double").alias("fines"), T.day(F.max("action_date")).alias("last_date"))


@query(AGED + """ SELECT g.code, count(a.id) AS recent FROM agencies g LEFT JOIN offenders o ON o.agency_id = g.id LEFT JOIN aged a ON a.offender_id = o.id AND a.age <= 30 GROUP BY g.code""")
def a08_agency_page(s, d):
    n = aged_by_agency(s, d).where("age <= 30").groupBy("agency_id").agg(F.count("*").alias("recent"))
    return T.agencies(s, d).join(n, F.col("id") == F.col("agency_id"), "left").select("code", F.coalesce("recent", F.lit(0)).alias("recent"))


@query(""" SELECT coalesce(nullif(industry, ''), 'Unknown') AS label, count(*) AS n, CAST(sum(coalesce(fine, 0)) AS DOUBLE) AS total, round(CAST(sum(coalesce(fine, 0)) AS DOUBLE) / count(*), 2) AS average FROM cases c LEFT JOIN offenders o ON c.offender_id = o.id GROUP BY 1""")
def a09_industry_stats(s, d):
    c = T.cases(s, d).join(T.offenders(s, d).select(F.col("id").alias("offender_id"), "industry"), "offender_id", "left")
    return R.by_group(c, F.col("industry"), F.col("fine"))


@query(""", t AS (SELECT offender_id, count(*) AS n FROM facts GROUP BY 1) SELECT CAST(round(coalesce(100.0 * count(*) FILTER (WHERE n > 2) / nullif(count(*), 0), 0)) AS BIGINT) AS repeat_pct FROM t""")
def a10_repeat_percentage(s, d):
    t = U.unified(T.cases(s, d), T.notices(s, d)).groupBy("offender_id").agg(F.count("*").alias("n"))
    return t.agg(F.round(R.share(R.count_if(F.col("n") > 2), F.count("*"), 6)).cast("bigint").alias("repeat_pct"))


@query(""" SELECT a.code, count(*) AS cases, CAST(sum(fine) AS DOUBLE) AS fines FROM cases c JOIN offenders o ON c.offender_id = o.id JOIN agencies a ON o.agency_id = a.id GROUP BY a.code""")
def a11_fines_by_agency(s, d):
    c = U.with_names(T.cases(s, d), T.offenders(s, d), T.agencies(s, d)).where("agency_code is not null")
    return c.groupBy(F.col("agency_code").alias("code")).agg(F.count("*").alias("cases"), F.sum("fine").cast("double").alias("fines"))


@query(""" SELECT offender_id, count(*) AS cases, CAST(sum(fine) AS DOUBLE) AS fines, count(*) > 1 AS is_repeat FROM cases GROUP BY 1""")
def a12_offender_analysis(s, d):
    return T.cases(s, d).groupBy("offender_id").agg(F.count("*").alias("cases"), F.sum("fine").cast("double").alias("fines"), (F.count("*") > 1).alias("is_repeat"))


@query(""" SELECT f.offender_id, coalesce(a.code, 'unknown') AS code, count(*) FILTER (WHERE record_type = 'case') AS cases, count(*) FILTER (WHERE record_type = 'notice') AS notices FROM facts f LEFT JOIN offenders o ON f.offender_id = o.id LEFT JOIN agencies a ON o.agency_id = a.id GROUP BY 1, 2""")
def a13_offender_agencies(s, d):
    f = U.with_names(U.unified(T.cases(s, d), T.notices(s, d)), T.offenders(s, d), T.agencies(s, d))
    case = F.col("record_type") == "case"
    return f.groupBy("offender_id", F.coalesce("agency_code", F.lit("unknown")).alias("code")).agg(R.count_if(case).alias("cases"), R.count_if(~case).alias("notices"))


@query(""", p AS (SELECT id, industry, balance, count(*) OVER w - 1 AS peers, CASE WHEN count(*) OVER w > 1 THEN CAST(sum(balance) OVER w - balance AS DOUBLE) / (count(*) OVER w - 1) END AS avg_ FROM offenders WINDOW w AS (PARTITION BY industry))
SELECT id, peers, round(avg_, 2) AS peer_average, CASE WHEN avg_ IS NULL THEN 'No peers' WHEN CAST(balance AS DOUBLE) > 2 * avg_ THEN 'Well above average' WHEN CAST(balance AS DOUBLE) > avg_ THEN 'Above average' ELSE 'Average or below' END AS context FROM p""")
def a14_industry_context(s, d):
    return R.peer_context(T.offenders(s, d), "industry", "balance").select("id", "peers", "peer_average", "context")


@query(""" SELECT f.offender_id, array_to_string(list_sort(list_distinct(list(action_type))), ',') AS types FROM facts f GROUP BY 1""")
def a15_distinct_sets(s, d):
    return R.distinct_sets(U.unified(T.cases(s, d), T.notices(s, d)), "offender_id", "action_type").select("offender_id", F.array_join("values", ",").alias("types"))


@query(""" SELECT case_id, string_agg(l.title || ' / ' || o.flag, '; ' ORDER BY sequence, legislation_id, part_no, o.fine, l.title || ' / ' || o.flag) AS summary FROM offences o JOIN legislation l ON o.legislation_id = l.id GROUP BY case_id""")
def a16_breach_summary(s, d):
    items = T.offences(s, d).join(T.legislation(s, d).select(F.col("id").alias("legislation_id"), "title"), "legislation_id")
    return R.ordered_summary(items, "case_id", F.concat_ws(" / ", "title", "flag"), [F.col(c) for c in ("sequence", "legislation_id", "part_no", "fine")])


def _periods(s, d, unit):
    c = T.cases(s, d).where("action_date is not null")
    return c.groupBy(values.period_label(F.col("action_date"), unit).alias("period")).agg(F.count("*").alias("n"), F.sum("fine").cast("double").alias("fines")).orderBy("period")


@query(""" SELECT strftime(action_date, '%Y-%m') AS period, count(*) AS n, CAST(sum(fine) AS DOUBLE) AS fines FROM cases WHERE action_date IS NOT NULL GROUP BY 1""")
def a17_by_month(s, d):
    return _periods(s, d, "month")


@query(""" SELECT year(action_date) || '-W' || lpad(CAST(CAST(ceil((dayofyear(action_date) - 1 + dayofweek(make_date(year(action_date), 1, 1)) + 1) / 7.0) AS BIGINT) AS VARCHAR), 2, '0') AS period, count(*) AS n, CAST(sum(fine) AS DOUBLE) AS fines FROM cases WHERE action_date IS NOT NULL GROUP BY 1""")
def a17_by_week(s, d):
    return _periods(s, d, "week")


@query(""" SELECT year(action_date) || '-Q' || quarter(action_date) AS period, count(*) AS n, CAST(sum(fine) AS DOUBLE) AS fines FROM cases WHERE action_date IS NOT NULL GROUP BY 1""")
def a17_by_quarter(s, d):
    return _periods(s, d, "quarter")


@query(""" SELECT coalesce(nullif(action_type, ''), 'Unknown') AS label, count(*) AS n, CAST(sum(coalesce(fine, 0)) AS DOUBLE) AS total, round(CAST(sum(coalesce(fine, 0)) AS DOUBLE) / count(*), 2) AS average FROM facts GROUP BY 1""")
def a18_group_and_sum(s, d):
    return R.by_group(U.unified(T.cases(s, d), T.notices(s, d)), F.col("action_type"), F.col("fine"))


@query(""" SELECT coalesce(nullif(result, ''), 'Unknown') AS label, count(*) AS n FROM facts GROUP BY 1""")
def a19_group_and_count(s, d):
    return R.by_group(U.unified(T.cases(s, d), T.notices(s, d)), F.col("result"), F.lit(0)).select("label", "n")


@query(""", b(bucket, low, high) AS (VALUES (0, 0.0, 1000), (1, 1000, 5000), (2, 5000, 10000), (3, 10000, 50000), (4, 50000, 100000), (5, 100000, 1e300))
SELECT bucket, CAST(low AS DOUBLE) AS low, count(f.id) AS n, CAST(coalesce(sum(coalesce(f.fine, 0)), 0) AS DOUBLE) AS total FROM b LEFT JOIN facts f ON coalesce(f.fine, 0) >= b.low AND coalesce(f.fine, 0) < b.high GROUP BY 1, 2""")
def a20_histogram(s, d):
    return R.histogram(U.unified(T.cases(s, d), T.notices(s, d)), F.col("fine"), EDGES)


@query(""" SELECT count(*) AS n, CAST(sum(fine) AS DOUBLE) AS total, round(CAST(sum(fine) AS DOUBLE) / count(*), 4) AS mean, CAST(median(CAST(fine AS DOUBLE)) AS DOUBLE) AS median, CAST(min(fine) AS DOUBLE) AS low, CAST(max(fine) AS DOUBLE) AS high FROM cases WHERE fine > 0""")
def a21_statistics(s, d):
    return R.statistics(T.cases(s, d), F.col("fine"))


@query(""" SELECT CAST(sum(coalesce(fine, 0)) AS DOUBLE) AS fines, CAST(sum(coalesce(costs, 0)) AS DOUBLE) AS costs FROM cases WHERE result = 'F'""")
def a22_filtered_totals(s, d):
    c = T.cases(s, d).where("result = 'F'")
    return c.agg(*[R.total(x).cast("double").alias(y) for x, y in (("fine", "fines"), ("costs", "costs"))])


@query(""" SELECT count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS successful, count(*) FILTER (WHERE event_type = 'error') AS failed, round(100.0 * count(*) FILTER (WHERE event_type <> 'error') / count(*), 1) AS success_rate,
round(avg(value), 1) AS avg_latency, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, round(count(*) / (sum(value) / 3600000), 1) AS throughput_per_hour FROM events""")
def a23_percentiles(s, d):
    return R.run_metrics(T.load(s, d, "events"), F.col("event_type") != "error", "value", [50, 95, 99])


@query(AGED + """ SELECT CASE WHEN age <= 90 THEN '0-90' WHEN age <= 180 THEN '91-180' WHEN age <= 365 THEN '181-365' ELSE 'over 365' END AS bucket, count(*) AS n FROM aged GROUP BY 1""")
def a24_age_buckets(s, d):
    a = F.col("age")
    return aged(s, d).groupBy(F.when(a <= 90, "0-90").when(a <= 180, "91-180").when(a <= 365, "181-365").otherwise("over 365").alias("bucket")).agg(F.count("*").alias("n"))


@query(""" SELECT CASE WHEN coalesce(fine, 0) = 0 THEN 'No fine' WHEN fine < 10000 THEN 'Low' WHEN fine <= 100000 THEN 'Medium' ELSE 'High' END AS band, count(*) AS n FROM facts GROUP BY 1""")
def a25_fine_bands(s, d):
    f = F.coalesce("fine", F.lit(0))
    return U.unified(T.cases(s, d), T.notices(s, d)).groupBy(F.when(f == 0, "No fine").when(f < 10000, "Low").when(f <= 100000, "Medium").otherwise("High").alias("band")).agg(F.count("*").alias("n"))


@query(""" SELECT coalesce(action_type, 'Unknown') AS action_type, count(*) AS n FROM notices GROUP BY 1""")
def a26_notice_types(s, d):
    return T.notices(s, d).groupBy(F.coalesce("action_type", F.lit("Unknown")).alias("action_type")).agg(F.count("*").alias("n"))


@query(""", g AS (SELECT title, year, count(*) AS n FROM legislation GROUP BY 1, 2)
SELECT (SELECT count(*) FROM legislation) AS total, (SELECT count(DISTINCT type) FROM legislation) AS types, (SELECT count(*) FILTER (WHERE year IS NULL) FROM legislation) AS no_year, (SELECT count(*) FILTER (WHERE number IS NULL) FROM legislation) AS no_number, (SELECT count(*) FROM g WHERE n > 1) AS duplicate_groups, (SELECT count(DISTINCT title) FROM legislation) AS titles""")
def a28_legislation_stats(s, d):
    # a29 is the DISTINCT title part.  Aggregating by (title, year) first lets one small table answer everything but types.
    l = T.legislation(s, d)
    flat = l.agg(F.count("*").alias("total"), F.count_distinct("type").alias("types"), R.count_if(F.col("year").isNull()).alias("no_year"), R.count_if(F.col("number").isNull()).alias("no_number"), F.count_distinct("title").alias("titles"))
    groups = l.groupBy("title", "year").agg(F.count("*").alias("n")).agg(R.count_if(F.col("n") > 1).alias("duplicate_groups"))
    return flat.join(F.broadcast(groups)).select("total", "types", "no_year", "no_number", "duplicate_groups", "titles")


@query(""" SELECT title, array_to_string(list(id ORDER BY year DESC, length(number) DESC, id), ',') AS ids FROM legislation GROUP BY title HAVING count(*) > 1""")
def a30_ordered_ids(s, d):
    item = F.struct((-F.col("year")).alias("a"), (-F.length("number")).alias("b"), "id")
    g = T.legislation(s, d).groupBy("title").agg(F.sort_array(F.collect_list(item)).alias("x")).where(F.size("x") > 1)
    return g.select("title", F.array_join(F.transform("x", lambda i: i["id"].cast("string")), ",").alias("ids"))


@query(""", x AS (SELECT * FROM notices n WHERE EXISTS (SELECT 1 FROM notices m WHERE m.offender_id = n.offender_id AND m.action_date = n.action_date AND m.action_type = n.action_type AND m.id <> n.id)) SELECT count(*) AS n, count(DISTINCT offender_id) AS keys FROM x""")
def a31_duplicate_counts(s, d):
    n = T.notices(s, d)
    key = ["offender_id", "action_date", "action_type"]
    twin = n.groupBy(*key).agg(F.count_distinct("id").alias("_n")).where("_n > 1")
    return n.join(twin, key, "left_semi").agg(F.count("*").alias("n"), F.count_distinct("offender_id").alias("keys"))


@query(""", c AS (SELECT offender_id, count(*) AS total_cases, CAST(sum(fine) AS DOUBLE) AS total_fines, max(action_date) AS m FROM cases GROUP BY 1), n AS (SELECT offender_id, count(*) AS total_notices, max(action_date) AS m FROM notices GROUP BY 1)
SELECT o.id, coalesce(total_cases, 0) AS total_cases, coalesce(total_notices, 0) AS total_notices, coalesce(total_fines, 0) AS total_fines, strftime(greatest(c.m, n.m), '%Y-%m-%d') AS last_seen FROM offenders o LEFT JOIN c ON c.offender_id = o.id LEFT JOIN n ON n.offender_id = o.id""")
def a33_offender_totals(s, d):
    case = F.col("record_type") == "case"
    t = U.unified(T.cases(s, d), T.notices(s, d)).groupBy("offender_id").agg(R.count_if(case).alias("c"), R.count_if(~case).alias("n"), R.total("fine").cast("double").alias("f"), T.day(F.max("action_date")).alias("last_seen"))
    out = T.offenders(s, d).join(t, F.col("id") == F.col("offender_id"), "left")
    return out.select("id", F.coalesce("c", F.lit(0)).alias("total_cases"), F.coalesce("n", F.lit(0)).alias("total_notices"), F.coalesce("f", F.lit(0.0)).alias("total_fines"), "last_seen")


@query(""" SELECT offender_id, CAST(round(count(DISTINCT action_type) / 5.0 * 100) AS BIGINT) AS validated FROM notices GROUP BY 1""")
def a34_validation_share(s, d):
    return T.notices(s, d).groupBy("offender_id").agg(F.round(F.count_distinct("action_type") / 5.0 * 100).cast("bigint").alias("validated"))


@query(""" SELECT source, round(avg(quality * 4 + 1), 1) AS rating, count(*) FILTER (WHERE quality = 1) AS good FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""", roles=True)
def a35_ratings(s, d):
    # a36, the count of good ratings, is the second column.
    x = T.load(s, d, "labels").join(T.load(s, d, "documents").select("doc_id", "source"), "doc_id")
    return x.groupBy("source").agg(F.round(F.avg(F.col("quality") * 4 + 1), 1).alias("rating"), R.count_if(F.col("quality") == 1).alias("good"))


@query(""" SELECT count(*) AS total, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS active, count(*) FILTER (WHERE event_type = 'purchase') AS completed, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events""")
def a37_session_stats(s, d):
    t = F.col("event_type")
    return T.load(s, d, "events").agg(F.count("*").alias("total"), R.count_if(t.isin("click", "view")).alias("active"), R.count_if(t == "purchase").alias("completed"), R.count_if(t == "error").alias("failed"))


@query(""" SELECT count(*) FILTER (WHERE record_type = 'case') AS "case", count(*) FILTER (WHERE record_type = 'notice') AS notice FROM facts""")
def a38_type_counts(s, d):
    f = U.unified(T.cases(s, d), T.notices(s, d)).groupBy().pivot("record_type", ["case", "notice"]).agg(F.count(F.lit(1)))
    return f.na.fill(0)


@query(""" SELECT event_type, count(*) AS attempts, count(*) FILTER (WHERE value > 50) AS successes, round(avg(value), 4) AS average FROM events GROUP BY 1""")
def a39_retry_metrics(s, d):
    return T.load(s, d, "events").groupBy("event_type").agg(F.count("*").alias("attempts"), R.count_if(F.col("value") > 50).alias("successes"), F.round(F.avg("value"), 4).alias("average"))


@query(""" SELECT hour(ts) AS hour, count(*) AS errors, round(count(*) / 24.0, 4) AS per_hour FROM events WHERE event_type = 'error' GROUP BY 1""")
def a40_error_trend(s, d):
    return T.load(s, d, "events").where("event_type = 'error'").groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("errors"), F.round(F.count("*") / 24.0, 4).alias("per_hour"))


@query(""" SELECT legislation_id, count(*) AS offences, count(DISTINCT case_id) AS cases, strftime(min(c.action_date), '%Y-%m-%d') AS first_used, strftime(max(c.action_date), '%Y-%m-%d') AS last_used FROM offences o JOIN cases c ON o.case_id = c.id GROUP BY 1""")
def a43_legislation_usage(s, d):
    offences, cases = T.offences(s, d).select("case_id", "legislation_id"), T.cases(s, d).select(F.col("id").alias("case_id"), "action_date")
    # Both are dealt by case, in as many parts as their size asks for; a case's laws then are counted where it lies.
    parts = R.parts_by_size(offences)
    each = offences.repartition(parts, "case_id").groupBy("case_id", "legislation_id").agg(F.count("*").alias("_n"))
    dates = cases.repartition(parts, "case_id").groupBy("case_id").agg(F.count("*").alias("_m"), F.min("action_date").alias("_first"), F.max("action_date").alias("_last"))
    return each.join(dates.hint("merge"), "case_id").groupBy("legislation_id").agg(F.sum(F.col("_n") * F.col("_m")).alias("offences"), F.count("*").alias("cases"), T.day(F.min("_first")).alias("first_used"), T.day(F.max("_last")).alias("last_used"))


@query(""" SELECT record_type, action_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY record_type), 1) AS pct FROM facts GROUP BY 1, 2""")
def a44_action_frequencies(s, d):
    g = U.unified(T.cases(s, d), T.notices(s, d)).groupBy("record_type", "action_type").agg(F.count("*").alias("n"))
    sums = g.groupBy("record_type").agg(F.sum("n").alias("_t"))
    return g.join(sums, "record_type").select("record_type", "action_type", "n", R.share(F.col("n"), F.col("_t")).alias("pct"))


@query(""" SELECT f.action_type, f.action_date::VARCHAR AS action_date, count(DISTINCT a.code) AS agencies FROM facts f JOIN offenders o ON f.offender_id = o.id JOIN agencies a ON o.agency_id = a.id GROUP BY 1, 2 HAVING count(DISTINCT a.code) > 1""")
def a45_keys_in_several_agencies(s, d):
    f = U.with_names(U.unified(T.cases(s, d), T.notices(s, d)), T.offenders(s, d), T.agencies(s, d)).where("agency_code is not null")
    g = f.groupBy("action_type", T.day("action_date").alias("action_date")).agg(F.count_distinct("agency_code").alias("agencies"))
    return g.where("agencies > 1")


@query(""" SELECT event_type AS level, CAST(json_extract(props, '$.k') AS BIGINT) % 5 AS category, count(*) AS n FROM events GROUP BY 1, 2""")
def a46_log_counters(s, d):
    k = F.get_json_object("props", "$.k").cast("bigint") % 5
    return T.load(s, d, "events").groupBy(F.col("event_type").alias("level"), k.alias("category")).agg(F.count("*").alias("n"))
