"""Filters, joins, sorts, pages and set operations."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkwarden.functions import similarity, text
from sparkwarden.operators import filtering as Q
from sparkwarden.operators import reports as R
from sparkwarden.plans import spec as S
from sparkwarden.plans import tables as T
from sparkwarden.plans import unified as U
from sparkwarden.queries import query
from sparkwarden.queries.reports import AGED, aged


@query(""" SELECT id, strftime(action_date, '%Y-%m-%d') AS action_date, CAST(fine AS DOUBLE) AS fine FROM cases WHERE action_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND fine >= 50000 AND fine <= 300000 AND action_type = '1-URGENT'""")
def f01_case_filter(s, d):
    keep = Q.all_of([Q.between("action_date", date(1997, 1, 1), date(1998, 12, 31)), Q.between("fine", 50000, 300000), Q.equals("action_type", "1-URGENT"), Q.equals("result", None)])
    return T.cases(s, d).where(keep).select("id", T.day("action_date").alias("action_date"), T.as_double("fine").alias("fine"))


@query(""" SELECT id, offender_id FROM notices WHERE action_date >= DATE '2024-01-10' AND action_type = 'error'""")
def f02_notice_filter(s, d):
    return T.notices(s, d).where(Q.all_of([Q.between("action_date", date(2024, 1, 10)), Q.equals("action_type", "error")])).select("id", "offender_id")


@query(""", b AS (SELECT case_id, string_agg(l.title, '; ') AS summary FROM offences o JOIN legislation l ON o.legislation_id = l.id GROUP BY 1)
SELECT c.id FROM cases c LEFT JOIN offenders o ON c.offender_id = o.id LEFT JOIN b ON b.case_id = c.id WHERE coalesce(contains(lower(o.name), '#00000001'), false) OR coalesce(contains(lower(b.summary), 'small'), false)""")
def f03_search(s, d):
    items = T.offences(s, d).join(T.legislation(s, d).select(F.col("id").alias("legislation_id"), "title"), "legislation_id")
    named = U.with_names(T.cases(s, d), T.offenders(s, d))
    # The text to be found is in one title, so the titles are searched and not the joined summaries.
    hit = items.where(Q.search("small", "title")).select(F.col("case_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    return named.join(hit, "id", "left").where(Q.search("#00000001", "offender_name") | F.coalesce("_hit", F.lit(False))).select("id")


@query(""", t AS (SELECT offender_id, count(*) AS n FROM facts GROUP BY 1) SELECT o.id FROM offenders o JOIN t ON t.offender_id = o.id WHERE industry = 'BUILDING' AND n > 2""")
def f04_offender_filter(s, d):
    t = U.unified(T.cases(s, d), T.notices(s, d)).groupBy("offender_id").agg(F.count("*").alias("n"))
    o = T.offenders(s, d).where(Q.all_of([Q.one_of("industry", "BUILDING", ["BUILDING", "MACHINERY"]), Q.one_of("industry", "no such", ["BUILDING"])]))
    return o.join(t, F.col("id") == F.col("offender_id")).where(Q.repeat(F.col("n"), F.lit(0))).select("id")


@query(""", x AS (SELECT offender_id, list(DISTINCT action_type) AS types FROM notices GROUP BY 1) SELECT offender_id FROM x WHERE list_contains(types, 'purchase')""")
def f05_array_membership(s, d):
    return R.distinct_sets(T.notices(s, d), "offender_id", "action_type").where(Q.member("values", "purchase")).select("offender_id")


@query(""" SELECT id FROM offenders WHERE contains(lower(name), '99') OR contains(lower(industry), 'auto')""")
def f07_offender_search(s, d):
    return T.offenders(s, d).where(Q.search("AUTO", "industry") | Q.search("99", "name")).select("id")


@query(""" SELECT id, title FROM legislation WHERE year >= 1970 AND year <= 1985 AND contains(lower(title), 'ring')""")
def f08_legislation_filter(s, d):
    return T.legislation(s, d).where(Q.all_of([Q.between("year", 1970, 1985), Q.search("ring", "title")])).select("id", "title")


@query(""" SELECT l.id FROM legislation l WHERE EXISTS (SELECT 1 FROM offences x JOIN cases c ON x.case_id = c.id JOIN offenders o ON c.offender_id = o.id JOIN agencies a ON o.agency_id = a.id WHERE x.legislation_id = l.id AND a.id = 3)
OR EXISTS (SELECT 1 FROM offences x JOIN notices n ON x.case_id = n.id JOIN offenders o ON n.offender_id = o.id JOIN agencies a ON o.agency_id = a.id WHERE x.flag = 'R' AND x.legislation_id = l.id AND a.id = 3)""")
def f09_legislation_by_agency(s, d):
    # Semi joins inward out: each keeps keys only.  Returned items stand for offences that are a notice's, with its number.
    o = T.offenders(s, d).where("agency_id = 3").select(F.col("id").alias("offender_id"))
    c = T.cases(s, d).join(o, "offender_id", "left_semi").select(F.col("id").alias("case_id"))
    n = T.notices(s, d).join(o, "offender_id", "left_semi").select(F.col("id").alias("case_id"))
    by_case = T.offences(s, d).join(c, "case_id", "left_semi")
    by_notice = T.offences(s, d).where("flag = 'R'").join(n, "case_id", "left_semi")
    x = by_case.unionByName(by_notice).select(F.col("legislation_id").alias("id"))
    return T.legislation(s, d).join(x, "id", "left_semi").select("id")


@query(""" SELECT id FROM cases WHERE action_date BETWEEN DATE '1996-02-01' AND DATE '1996-02-29'""")
def f10_date_range(s, d):
    return T.cases(s, d).where(Q.between("action_date", date(1996, 2, 1), date(1996, 2, 29))).select("id")


@query(""" SELECT case_id, sequence, CAST(fine AS DOUBLE) AS fine FROM offences WHERE fine > 80000""")
def f12_with_fines(s, d):
    return T.offences(s, d).where("fine is not null and fine > 80000").orderBy(F.col("fine").desc(), "case_id", "sequence").select("case_id", "sequence", T.as_double("fine").alias("fine"))


TRGM = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', CAST(i AS BIGINT), 3)))))"


@query(f""", t AS (SELECT DISTINCT title FROM legislation), g AS (SELECT title, {TRGM.format('title')} AS g, {TRGM.format("'small ring'")} AS q FROM t), x AS (SELECT title, len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q))) AS sim FROM g) SELECT title, round(sim, 6) AS similarity FROM x WHERE sim >= 0.3""")
def f14_trigram_filter(s, d):
    t = T.legislation(s, d).select("title").distinct().withColumn("similarity", similarity.trigram_similarity(F.col("title"), F.lit("small ring")))
    return t.where("similarity >= 0.3").select("title", F.round("similarity", 6).alias("similarity"))


@query(AGED + """ SELECT id, record_type FROM aged WHERE age > 30 AND record_type = 'notice' OR age > 2000""")
def f18_stale(s, d):
    return aged(s, d).where("(age > 30 and record_type = 'notice') or age > 2000").select("id", "record_type")


@query(""" SELECT record_type, id FROM facts WHERE record_type = 'case' AND action_date >= DATE '2001-01-01'""")
def f19_unified_filter(s, d):
    start, bad = Q.iso_date("2001-01-01"), Q.iso_date("not a date")
    f = U.unified(T.cases(s, d), T.notices(s, d), "case")
    return f.where(Q.between("action_date", start, bad)).select("record_type", "id")


@query(""" SELECT id, CAST(fine AS DOUBLE) AS fine FROM cases WHERE contains(lower(action_type), 'high') AND NOT contains(lower(result), 'o') AND coalesce(fine, 0) > 150000 AND starts_with(lower(action_type), '2') AND result <> ''""")
def f20_spec_operators(s, d):
    q = S.QuerySpec((S.Filter("action_type", "contains", "HIGH"), S.Filter("result", "not_contains", "O"), S.Filter("fine", "greater_than", 150000), S.Filter("action_type", "starts_with", "2"), S.Filter("result", "is_not_empty"), S.Filter("no_such", "equals", 1), S.Filter("id", "no such operator", 1)), columns=("id", "fine", "nothing"))
    return S.apply(T.cases(s, d), q).withColumn("fine", T.as_double("fine"))


@query(""" SELECT record_type, id FROM facts WHERE (action_date IS NULL OR action_date >= DATE '2024-01-20') AND coalesce(fine, 0) < 10""")
def f21_keep_null_dates(s, d):
    f = U.unified(T.cases(s, d), T.notices(s, d))
    return f.where(Q.all_of([Q.between("action_date", date(2024, 1, 20), keep_null=True), F.coalesce("fine", F.lit(0)) < 10])).select("record_type", "id")


@query(""" SELECT count(*) FILTER (WHERE action_date >= DATE '2001-08-01' - INTERVAL 36 MONTH) AS recent, count(*) FILTER (WHERE action_date < DATE '2001-08-01' - INTERVAL 36 MONTH) AS older FROM cases""")
def f25_recency_split(s, d):
    a, b = Q.recency_split(T.cases(s, d), "action_date", F.lit(date(2001, 8, 1)))
    return a.agg(F.count("*").alias("recent")).join(F.broadcast(b.agg(F.count("*").alias("older"))))


SLUGS = """, u AS (SELECT page_id, url || CASE page_id % 11 WHEN 0 THEN '/firm-Fined-1000' WHEN 1 THEN '/man-prosecuted-for' WHEN 2 THEN '/two-sentenced-today' WHEN 3 THEN '/a-prosecution' WHEN 4 THEN '/found-guilty-of' WHEN 5 THEN '/x-convicted-x'
WHEN 6 THEN '/an-ILLEGAL-site' WHEN 7 THEN '/in-court-again' WHEN 8 THEN '/ordered-to-pay-back' WHEN 9 THEN '/firm-ordered-to-pay-back' ELSE '/courtyard-opens' END AS url FROM pages)"""


@query(SLUGS + """ SELECT page_id FROM u WHERE contains(lower(url), '-fined-') OR contains(lower(url), '-prosecuted-') OR contains(lower(url), '-sentenced-') OR contains(lower(url), '-prosecution') OR contains(lower(url), '-guilty-')
OR contains(lower(url), '-convicted-') OR contains(lower(url), '-illegal-') OR contains(lower(url), '-court-') OR contains(lower(url), '-ordered-to-pay-')""")
def f30_url_predicate(s, d):
    ends = ("/firm-Fined-1000", "/man-prosecuted-for", "/two-sentenced-today", "/a-prosecution", "/found-guilty-of", "/x-convicted-x", "/an-ILLEGAL-site", "/in-court-again", "/ordered-to-pay-back", "/firm-ordered-to-pay-back", "/courtyard-opens")
    slug = F.element_at(F.array(*map(F.lit, ends)), (F.col("page_id") % len(ends) + 1).cast("int"))
    return T.load(s, d, "pages").where(Q.enforcement_url(F.concat("url", slug))).select("page_id")


@query(""" SELECT count(*) FILTER (WHERE regexp_full_match(lpad(CAST(id AS VARCHAR), 8, '0'), '[0-9]{8}')) AS well_formed, count(*) FILTER (WHERE action_type NOT IN ('click', 'view', 'purchase', 'signup', 'error')) AS misfiled FROM notices""")
def f33_key_format(s, d):
    # f34, the classification audit, is the second column.
    n = T.notices(s, d).withColumn("key", F.lpad(F.col("id").cast("string"), 8, "0"))
    return n.agg(R.count_if(Q.well_formed("key")).alias("well_formed"), R.count_if(~F.col("action_type").isin("click", "view", "purchase", "signup", "error")).alias("misfiled"))


@query(""" SELECT record_type, id, strftime(action_date, '%Y-%m-%d') AS action_date, action_type, offender_id, CAST(fine AS DOUBLE) AS fine, result FROM facts""")
def u01_unified(s, d):
    # p01 and p02 are the projections of its branches.
    f = U.unified(T.cases(s, d), T.notices(s, d))
    return f.select("record_type", "id", T.day("action_date").alias("action_date"), "action_type", "offender_id", T.as_double("fine").alias("fine"), "result")


@query(""" SELECT o.case_id, o.sequence, o.part_no, CAST(o.fine AS DOUBLE) AS fine,
CASE WHEN c.id IS NULL THEN 'null' ELSE '{"id":' || c.id || ',"result":"' || c.result || '","date":"' || strftime(c.action_date, '%Y-%m-%d') || '"}' END AS "case",
CASE WHEN n.id IS NULL THEN 'null' ELSE '{"id":' || n.id || ',"type":"' || n.action_type || '"}' END AS notice,
CASE WHEN l.id IS NULL THEN 'null' ELSE '{"id":' || l.id || ',"title":"' || l.title || '","year":' || l.year || '}' END AS legislation
FROM offences o LEFT JOIN cases c ON o.case_id = c.id LEFT JOIN notices n ON o.flag = 'R' AND o.case_id = n.id LEFT JOIN legislation l ON o.legislation_id = l.id""")
def p06_nested_offences(s, d):
    # The nested structs, shown as JSON so that both engines print them alike.
    x = U.nested_offences(T.offences(s, d).withColumn("notice_id", F.when(F.col("flag") == "R", F.col("case_id"))), T.cases(s, d), T.notices(s, d), T.legislation(s, d))
    shown = [F.coalesce(F.to_json(c), F.lit("null")).alias(c) for c in ("case", "notice", "legislation")]
    return x.select("case_id", "sequence", "part_no", T.as_double("fine").alias("fine"), *shown)


@query(""" SELECT f.record_type, f.id, coalesce(o.name, 'Unknown Organization') AS offender_name, a.code AS agency_code FROM facts f LEFT JOIN offenders o ON f.offender_id = o.id LEFT JOIN agencies a ON o.agency_id = a.id""")
def j01_dimension_joins(s, d):
    # j03, the placeholder for a missing offender, is part of it.
    return U.with_names(U.unified(T.cases(s, d), T.notices(s, d)), T.offenders(s, d), T.agencies(s, d)).select("record_type", "id", "offender_name", "agency_code")


@query(""" SELECT o.id, count(c.id) AS n_cases, coalesce(string_agg(CAST(c.id AS VARCHAR), ',' ORDER BY c.id), '') AS case_ids FROM offenders o LEFT JOIN cases c ON c.offender_id = o.id GROUP BY 1""")
def j02_children(s, d):
    c = T.cases(s, d).groupBy(F.col("offender_id").alias("id")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids"))
    return T.offenders(s, d).join(c, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_cases"), F.coalesce(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), F.lit("")).alias("case_ids"))


@query(""" SELECT count(*) AS n FROM notices n WHERE EXISTS (SELECT 1 FROM notices m WHERE m.offender_id = n.offender_id AND m.action_date = n.action_date AND m.id <> n.id)""")
def j06_exists_other(s, d):
    # A key with two ids or more has another row for each of its rows: an aggregate instead of a self join.
    n = T.notices(s, d)
    twin = n.groupBy("offender_id", "action_date").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b")
    return n.join(twin, ["offender_id", "action_date"], "left_semi").agg(F.count("*").alias("n"))


@query(""" SELECT id FROM offenders o WHERE NOT EXISTS (SELECT 1 FROM cases c WHERE c.offender_id = o.id)""")
def j08_anti_join(s, d):
    c = T.cases(s, d).select(F.col("offender_id").alias("id"))
    return T.offenders(s, d).join(c, "id", "left_anti").select("id")


@query(""" SELECT DISTINCT c.id, strftime(c.action_date, '%Y-%m-%d') AS action_date FROM cases c JOIN offences o ON o.case_id = c.id JOIN legislation l ON l.id = o.legislation_id WHERE l.year = 1970 ORDER BY action_date DESC, id LIMIT 20 OFFSET 10""")
def j10_two_hop_page(s, d):
    l = T.legislation(s, d).where("year = 1970").select(F.col("id").alias("legislation_id"))
    x = T.offences(s, d).join(l, "legislation_id", "left_semi").select(F.col("case_id").alias("id"))
    c = T.cases(s, d).join(x, "id", "left_semi").orderBy(F.col("action_date").desc(), "id").offset(10).limit(20)
    return c.select("id", T.day("action_date").alias("action_date"))


@query(""" SELECT o.case_id, o.sequence, o.legislation_id, o.part_no, coalesce('case ' || c.id, 'notice ' || n.id, 'none') AS parent FROM offences o LEFT JOIN cases c ON c.id = o.case_id AND o.flag = 'R' LEFT JOIN notices n ON n.id = o.case_id AND o.flag = 'A'""")
def j14_polymorphic_parent(s, d):
    o = T.offences(s, d)
    c = T.cases(s, d).select(F.col("id").alias("_c"))
    n = T.notices(s, d).select(F.col("id").alias("_n"))
    x = o.join(c, (F.col("case_id") == F.col("_c")) & (F.col("flag") == "R"), "left").join(n, (F.col("case_id") == F.col("_n")) & (F.col("flag") == "A"), "left")
    return x.select("case_id", "sequence", "legislation_id", "part_no", F.coalesce(F.concat(F.lit("case "), "_c"), F.concat(F.lit("notice "), "_n"), F.lit("none")).alias("parent"))


@query(""", p AS (SELECT a.id, b.id AS peer_id, CAST(b.balance AS DOUBLE) AS peer_value, row_number() OVER (PARTITION BY a.id ORDER BY b.balance DESC, b.id) AS place FROM offenders a JOIN offenders b ON a.industry = b.industry AND a.id <> b.id) SELECT * FROM p WHERE place <= 5""")
def j15_peers(s, d):
    return R.top_peers(T.offenders(s, d), "industry", "balance").withColumn("peer_value", T.as_double("peer_value"))


@query(""" SELECT c.id, coalesce(n.action_type, c.action_type) AS action_type FROM cases c LEFT JOIN notices n ON n.id = c.id""")
def j16_detail_wins(s, d):
    n = T.notices(s, d).select("id", F.col("action_type").alias("_detail"))
    return T.cases(s, d).join(n, "id", "left").select("id", F.coalesce("_detail", "action_type").alias("action_type"))


@query(""", w AS (SELECT id, count(*) OVER (PARTITION BY offender_id, action_date) AS n FROM notices) SELECT id, n FROM w WHERE n > 1""")
def w01_window_count(s, d):
    w = Window.partitionBy("offender_id", "action_date")
    return T.notices(s, d).withColumn("n", F.count("*").over(w)).where("n > 1").select("id", "n")


@query(""", w AS (SELECT *, row_number() OVER (PARTITION BY offender_id ORDER BY action_date DESC, id DESC) AS r FROM cases) SELECT offender_id, id, strftime(action_date, '%Y-%m-%d') AS action_date FROM w WHERE r = 1""")
def w03_latest_per_key(s, d):
    # An aggregate with map-side combine, not a window over whole groups.
    g = T.cases(s, d).groupBy("offender_id").agg(F.max(F.struct("action_date", "id")).alias("x"))
    return g.select("offender_id", "x.id", T.day("x.action_date").alias("action_date"))


@query(""" SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), -1) AS heading FROM events""")
def w06_carry_forward(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    head = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w)
    return T.load(s, d, "events").select("event_id", F.coalesce(head, F.lit(-1)).alias("heading"))


@query(""" SELECT id, CAST(fine AS DOUBLE) AS fine FROM cases WHERE result = 'O' ORDER BY fine DESC, id LIMIT 25 OFFSET 50""")
def o01_page(s, d):
    q = S.QuerySpec((S.Filter("result", "equals", "O"),), (("fine", "desc"),), ("id", "fine"), S.clamp(25), 50, ("fine", "id"))
    return S.apply(T.cases(s, d), q, "id").withColumn("fine", T.as_double("fine"))


@query(""" SELECT count(*) AS total, CAST(ceil(count(*) / 25.0) AS BIGINT) AS pages FROM cases WHERE result = 'O'""")
def o03_page_count(s, d):
    # o11, the number of pages, is the second column.
    return T.cases(s, d).where("result = 'O'").agg(F.count("*").alias("total"), F.ceil(F.count("*") / 25).alias("pages"))


@query(""" SELECT f.record_type, f.id, strftime(f.action_date, '%Y-%m-%d') AS action_date, f.action_type, CAST(f.fine AS DOUBLE) AS fine, coalesce(o.name, 'Unknown Organization') AS offender_name, a.name AS agency_name, f.record_type = 'case' AS is_case FROM (SELECT * FROM facts ORDER BY action_date DESC, record_type, id LIMIT 100) f LEFT JOIN offenders o ON f.offender_id = o.id LEFT JOIN agencies a ON o.agency_id = a.id""")
def o06_recent_activity(s, d):
    r = U.recent_activity(U.unified(T.cases(s, d), T.notices(s, d)), T.offenders(s, d), T.agencies(s, d))
    return r.select("record_type", "id", T.day("action_date").alias("action_date"), "action_type", T.as_double("fine").alias("fine"), "offender_name", "agency_name", "is_case")


@query(""" SELECT o.name AS name, CAST(sum(fine) AS DOUBLE) AS fines FROM cases c JOIN offenders o ON c.offender_id = o.id GROUP BY o.id, o.name ORDER BY sum(fine) DESC, o.id LIMIT 10""")
def o08_top_offenders(s, d):
    g = T.cases(s, d).groupBy("offender_id").agg(F.sum("fine").alias("f")).join(T.offenders(s, d).select(F.col("id").alias("offender_id"), "name"), "offender_id")
    return g.orderBy(F.col("f").desc(), "offender_id").limit(10).select(text.truncate(F.col("name"), 40).alias("name"), T.as_double("f").alias("fines"))


@query(""", w AS (SELECT *, row_number() OVER (PARTITION BY action_type ORDER BY fine DESC, id) AS r FROM cases) SELECT action_type, id FROM w WHERE r <= 20""")
def o13_stratified(s, d):
    w = Window.partitionBy("action_type").orderBy(F.col("fine").desc(), "id")
    return T.cases(s, d).withColumn("r", F.row_number().over(w)).where("r <= 20").select("action_type", "id")


@query(""" SELECT offender_id, year(action_date) AS year, string_agg(record_type || ':' || id, ',' ORDER BY action_date DESC, record_type, id) AS actions FROM facts GROUP BY 1, 2""")
def o14_by_year(s, d):
    f = U.unified(T.cases(s, d), T.notices(s, d))
    item = F.struct((-F.unix_date("action_date")).alias("a"), "record_type", "id")
    g = f.groupBy("offender_id", F.year("action_date").alias("year")).agg(F.sort_array(F.collect_list(item)).alias("x"))
    return g.select("offender_id", "year", F.array_join(F.transform("x", lambda i: F.concat(i["record_type"], F.lit(":"), i["id"])), ",").alias("actions"))


@query(""" SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 15""")
def o16_last_records(s, d):
    return T.load(s, d, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(15).select("event_id")


@query(""" SELECT offender_id FROM cases EXCEPT ALL SELECT offender_id FROM notices""")
def u03_multiset_difference(s, d):
    return T.cases(s, d).select("offender_id").exceptAll(T.notices(s, d).select("offender_id"))


@query(""" SELECT offender_id FROM cases EXCEPT SELECT offender_id FROM notices""")
def u04_set_difference(s, d):
    return T.cases(s, d).select("offender_id").subtract(T.notices(s, d).select("offender_id"))


@query(""", c AS (SELECT offender_id, list(DISTINCT month(action_date)) AS m FROM cases GROUP BY 1), n AS (SELECT offender_id, list(DISTINCT day(action_date)) AS m FROM notices GROUP BY 1) SELECT c.offender_id, len(list_intersect(c.m, n.m)) AS common, len(list_distinct(list_concat(c.m, n.m))) AS every FROM c JOIN n ON c.offender_id = n.offender_id""")
def u06_set_sizes(s, d):
    # u05, the union, is the set whose size is the second column.
    c = T.cases(s, d).groupBy("offender_id").agg(F.collect_set(F.month("action_date")).alias("a"))
    n = T.notices(s, d).groupBy("offender_id").agg(F.collect_set(F.day("action_date")).alias("b"))
    return c.join(n, "offender_id").select("offender_id", F.size(F.array_intersect("a", "b")).cast("bigint").alias("common"), F.size(F.array_union("a", "b")).cast("bigint").alias("every"))


@query(""" SELECT title, count(*) AS n FROM legislation GROUP BY 1 HAVING count(*) > 1""")
def u07_repeated_values(s, d):
    return T.legislation(s, d).groupBy("title").agg(F.count("*").alias("n")).where("n > 1")


@query(""" SELECT title, min(id) AS id FROM legislation GROUP BY 1""")
def u08_first_of_key(s, d):
    return T.legislation(s, d).groupBy("title").agg(F.min("id").alias("id"))
