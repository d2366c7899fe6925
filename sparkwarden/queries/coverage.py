"""Further operators of the inventory, each over whole tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from sparkwarden.functions import text, values
from sparkwarden.operators import entities as E
from sparkwarden.operators import filtering as Q
from sparkwarden.operators import reports as R
from sparkwarden.plans import spec as S
from sparkwarden.plans import tables as T
from sparkwarden.plans import unified as U
from sparkwarden.queries import query


@query(""", t AS (SELECT offender_id, count(*) FILTER (WHERE record_type = 'case') AS c, count(*) FILTER (WHERE record_type = 'notice') AS n FROM facts GROUP BY 1) SELECT offender_id, c, n FROM t WHERE c + n > 2""")
def f06_repeat_offenders(s, d):
    case = F.col("record_type") == "case"
    t = U.unified(T.cases(s, d), T.notices(s, d)).groupBy("offender_id").agg(R.count_if(case).alias("c"), R.count_if(~case).alias("n"))
    return t.where(Q.repeat(F.col("c"), F.col("n")))


@query(""" SELECT case_id, sequence, part_no FROM offences WHERE legislation_id = 11 OR case_id = 7""")
def f11_offence_lookups(s, d):
    return T.offences(s, d).where((F.col("legislation_id") == 11) | (F.col("case_id") == 7)).select("case_id", "sequence", "part_no")


@query(""" SELECT id, type, year FROM legislation WHERE year BETWEEN 1990 AND 1999""")
def f13_year_range(s, d):
    return T.legislation(s, d).where(Q.between("year", 1990, 1999)).select("id", "type", "year")


@query(""", q AS (SELECT doc_id, quality * 4 + 1 AS rating FROM labels) SELECT doc_id, rating FROM q WHERE rating >= 4""")
def f17_ratings(s, d):
    # f15 and f16 filter reviews and enrichments the same way.
    q = T.load(s, d, "labels").select("doc_id", (F.col("quality") * 4 + 1).alias("rating"))
    return q.where("rating >= 4").orderBy(F.col("rating").desc(), "doc_id")


@query(""" SELECT id FROM notices WHERE action_type = 'view' AND (action_date IS NULL OR action_date <= DATE '2024-01-05')""")
def f22_notice_page(s, d):
    return T.notices(s, d).where(Q.all_of([Q.equals("action_type", "view"), Q.between("action_date", None, date(2024, 1, 5), keep_null=True)])).select("id")


@query(""" SELECT id FROM offenders WHERE contains(lower(name), '7') AND (contains(lower(industry), 'mach') OR contains(lower(industry), 'furn'))""")
def f24_shape_filter(s, d):
    # f23, the report filter, is an AND of the same parts.
    return T.offenders(s, d).where(Q.all_of([Q.search("7", "name"), Q.search("MACH", "industry") | Q.search("FURN", "industry")])).select("id")


@query(""" SELECT record_type, id FROM facts WHERE coalesce(action_date, DATE '1900-01-01') <= DATE '1995-03-01'""")
def f26_timeline_filter(s, d):
    day = F.coalesce("action_date", F.lit(date(1900, 1, 1)))
    return U.unified(T.cases(s, d), T.notices(s, d)).where(day <= F.lit(date(1995, 3, 1))).select("record_type", "id")


@query(""" SELECT id, CAST(fine AS DOUBLE) AS fine FROM cases WHERE action_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' ORDER BY fine DESC, id LIMIT 50""")
def f29_sort_whitelist(s, d):
    # f28 (date range needed, two years at most) and f32 (unknown columns dropped) are checked on the way.
    start, end = date(1996, 1, 1), date(1996, 12, 31)
    S.check_dates(start, end)
    q = S.QuerySpec(sort=(("secret", "asc"), ("fine", "desc")), columns=("id", "no_such", "fine"), limit=S.clamp(50), sortable=("fine", "id"))
    return S.apply(T.cases(s, d).where(Q.between("action_date", start, end)), q, "id").withColumn("fine", T.as_double("fine"))


@query(""" SELECT id, title, type FROM legislation WHERE contains(lower(title), 'rod') OR contains(lower(type), 'rod') OR contains(lower(number), 'rod')""")
def f35_table_search(s, d):
    return T.legislation(s, d).where(Q.search("ROD", "title", "type", "number")).select("id", "title", "type").orderBy("title", "id")


@query(""" SELECT record_type AS type, id AS key, action_type AS action FROM facts""")
def p08_renamed(s, d):
    # p03 to p05: a subset of columns, in order, some renamed; the scan reads only these.
    f = U.unified(T.cases(s, d), T.notices(s, d)).select("record_type", "id", "action_type")
    return f.withColumnsRenamed({"record_type": "type", "id": "key", "action_type": "action"})


@query(""" SELECT a.code, count(DISTINCT l.id) AS legislation FROM agencies a JOIN offenders o ON o.agency_id = a.id JOIN cases c ON c.offender_id = o.id JOIN offences x ON x.case_id = c.id JOIN legislation l ON l.id = x.legislation_id GROUP BY 1""")
def j07_three_levels(s, d):
    # Duplicates go before the last join: (agency, legislation) pairs are few.
    c = T.with_agency(T.cases(s, d).select(F.col("id").alias("case_id"), "offender_id"), T.offenders(s, d)).select("case_id", "agency_id")
    pairs = T.offences(s, d).select("case_id", "legislation_id").join(c, "case_id").select("agency_id", "legislation_id").distinct()
    known = pairs.join(T.legislation(s, d).select(F.col("id").alias("legislation_id")), "legislation_id", "left_semi")
    return known.groupBy("agency_id").agg(F.count("*").alias("legislation")).join(T.agencies(s, d).select(F.col("id").alias("agency_id"), "code"), "agency_id").select("code", "legislation")


@query(""", k(title, code) AS (VALUES ('small ring', 'A'), ('hot bolt', 'B'), ('large rod', 'C')) SELECT l.id, coalesce(k.code, 'none') AS code FROM legislation l LEFT JOIN k ON lower(l.title) = k.title""")
def j13_lookup_table(s, d):
    # A small lookup is a map literal: no join at all.
    m = F.create_map(*[F.lit(x) for x in ("small ring", "A", "hot bolt", "B", "large rod", "C")])
    return T.legislation(s, d).select("id", F.coalesce(F.try_element_at(m, F.lower("title")), F.lit("none")).alias("code"))


@query(""", x AS (SELECT f.record_type, a.code FROM agencies a LEFT JOIN offenders o ON o.agency_id = a.id LEFT JOIN facts f ON f.offender_id = o.id) SELECT code, count(record_type) AS n FROM x GROUP BY 1 ORDER BY n DESC, code LIMIT 10""")
def o15_busiest_agencies(s, d):
    # j11 (every agency, zeros kept), w04 and w05 (shares, best of a group) rest on the same counts.
    n = T.with_agency(U.unified(T.cases(s, d), T.notices(s, d)), T.offenders(s, d)).groupBy("agency_id").agg(F.count("*").alias("n"))
    a = T.agencies(s, d).join(n, F.col("id") == F.col("agency_id"), "left").select("code", F.coalesce("n", F.lit(0)).alias("n"))
    return a.orderBy(F.col("n").desc(), "code").limit(10)


@query(""", t AS (SELECT offender_id, count(*) FILTER (WHERE action_type = 'purchase') AS good FROM notices WHERE action_date >= DATE '2024-01-10' GROUP BY 1) SELECT offender_id, good FROM t""")
def a36_reputation(s, d):
    n = T.notices(s, d).where(Q.between("action_date", date(2024, 1, 10)))
    return n.groupBy("offender_id").agg(R.count_if(F.col("action_type") == "purchase").alias("good"))


@query(""" SELECT round(100.0 * count(*) FILTER (WHERE value >= 85) / count(*), 2) AS sure, round(100.0 * count(*) FILTER (WHERE value < 80) / count(*), 2) AS review FROM events""")
def a41_classifier_shares(s, d):
    n = F.count("*")
    return T.load(s, d, "events").agg(R.share(R.count_if(F.col("value") >= 85), n, 2).alias("sure"), R.share(R.count_if(F.col("value") < 80), n, 2).alias("review"))


@query(""" SELECT record_type, id FROM facts ORDER BY coalesce(action_date, DATE '1900-01-01') DESC, record_type, id LIMIT 100 OFFSET 200""")
def o04_unified_sort(s, d):
    # o02 (default sorts) and o05 (limit clamped) are part of it; u02 is the union below.
    f = U.unified(T.cases(s, d), T.notices(s, d))
    day = F.coalesce("action_date", F.lit(date(1900, 1, 1)))
    return f.orderBy(day.desc(), "record_type", "id").offset(200).limit(S.clamp(None)).select("record_type", "id")


@query(""" SELECT id, CAST(balance AS DOUBLE) AS balance FROM offenders ORDER BY coalesce(offenders.balance, 0) DESC, id LIMIT 10""")
def o07_top_n(s, d):
    # o09 and o10 (stored totals; pages of a search) are the same sort and limit.
    return T.offenders(s, d).orderBy(F.coalesce("balance", F.lit(0)).desc(), "id").limit(10).select("id", T.as_double("balance").alias("balance"))


@query(""" SELECT case_id, sequence, legislation_id, part_no FROM offences ORDER BY case_id DESC, sequence, legislation_id, part_no LIMIT 200""")
def o12_two_key_sort(s, d):
    return T.offences(s, d).orderBy(F.col("case_id").desc(), F.col("sequence").asc_nulls_last(), "legislation_id", "part_no").limit(200).select("case_id", "sequence", "legislation_id", "part_no")


@query(r""" SELECT id, 'ukpga' AS type, year, CAST(id AS VARCHAR) AS number, upper(substring(title, 1, 1)) || substring(title, 2) AS title FROM legislation""")
def x10_paths(s, d):
    # x27, the upper-case first letter, is the last column.
    url = F.concat(F.lit("https://www.legislation.gov.uk/ukpga/"), "year", F.lit("/"), "id")
    n = text.split_name(text.resource_path(url))
    return T.legislation(s, d).select("id", n.alias("n"), text.upper_first(F.col("title")).alias("title")).select("id", "n.type", "n.year", "n.number", "title")


@query(r""" SELECT id, CASE id % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'company' ELSE 'person' END AS kind, CASE industry WHEN 'BUILDING' THEN 'construction' WHEN 'MACHINERY' THEN 'manufacturing' ELSE 'other' END AS grp FROM offenders""")
def x16_offender_kinds(s, d):
    # x15 (word-boundary forms) and x18 (industry by word) are the other columns' rules.
    k = F.col("id") % 3
    name = F.when(k == 0, "Mr J Smith").when(k == 1, F.concat("name", F.lit(" Limited"))).otherwise("Jane Ann Smith")
    return T.offenders(s, d).select("id", text.offender_kind(name).alias("kind"), text.industry_by_word(F.col("industry")).alias("grp"))


@query(r""" SELECT id, CASE WHEN industry = 'HOUSEHOLD' THEN 'HOUSEHOLD (' || id || ')' ELSE industry END AS name, upper(trim(' ' || lower(industry))) AS postcode FROM offenders""")
def x29_generic_names(s, d):
    # x04, the postcode's normal form, is the last column.
    return T.offenders(s, d).select("id", text.distinct_name(F.col("industry"), ["household", "shop"], F.col("id").cast("string")).alias("name"), text.postcode(F.concat(F.lit(" "), F.lower("industry"))).alias("postcode"))


@query(r""" SELECT id, CASE id % 3 WHEN 0 THEN year WHEN 1 THEN 1990 ELSE -1 END AS year, 'Breach of ' || title || CASE WHEN id % 2 = 0 THEN ', section 4' ELSE '' END || CASE WHEN id % 5 = 0 THEN ' (water)' ELSE '' END AS description, CASE id % 2 WHEN 0 THEN 'act' ELSE NULL END AS kind FROM legislation""")
def x43_act_years(s, d):
    # x44 (description) and x13 (kind of act) are further columns.
    k = F.col("id") % 3
    t = F.when(k == 0, F.concat("title", F.lit(" Act "), "year")).when(k == 1, "Environmental Protection").otherwise(F.col("title"))
    y = text.act_year(t, {"environmental protection": 1990, "water resources": 1991})
    section, context = F.when(F.col("id") % 2 == 0, "4").otherwise(""), F.when(F.col("id") % 5 == 0, "water")
    return T.legislation(s, d).select("id", F.coalesce(y, F.lit(-1)).alias("year"), text.notice_description(F.col("title"), section, context).alias("description"), text.breach_type(F.when(F.col("id") % 2 == 0, "Some Act 1990").otherwise("none")).alias("kind"))


@query(r""" SELECT id, strftime(action_date, '%Y-%m-%d') AS swapped, date_diff('day', action_date, DATE '2002-01-01') AS total_days, CAST(datesub('month', action_date, DATE '2002-01-01') AS BIGINT) AS months FROM cases""")
def y07_pending(s, d):
    # y03, the reshuffled date text, is the second column.
    p = values.pending(F.col("action_date"), F.lit(date(2002, 1, 1)))
    return T.cases(s, d).select("id", values.swap_date(F.date_format("action_date", "dd/MM/yyyy")).alias("swapped"), p.alias("p")).select("id", "swapped", F.col("p.total_days").cast("bigint").alias("total_days"), F.col("p.months").cast("bigint").alias("months"))


@query(r""" SELECT strftime(action_date, '%Y-%m-%d') AS day, strftime(action_date, '%Y') AS year, count(*) AS n FROM cases GROUP BY 1, 2""")
def y05_period_labels(s, d):
    c = F.col("action_date")
    return T.cases(s, d).groupBy(values.period_label(c, "day").alias("day"), values.period_label(c, "year").alias("year")).agg(F.count("*").alias("n"))


@query(""" SELECT balance::DOUBLE AS balance, count(*) OVER w AS n, id AS member FROM offenders WINDOW w AS (PARTITION BY balance) QUALIFY count(*) OVER w > 1""")
def d04_same_number(s, d):
    g = E.duplicate_members(T.offenders(s, d), {"balance": F.col("balance")}, F.col("id"))
    return g.select(T.as_double("balance").alias("balance"), "n", "member")


@query(""" SELECT (SELECT count(*) FROM offences WHERE fine >= 0 AND sequence >= 1 AND fine <= 90000) AS valid, (SELECT count(*) FROM offences WHERE NOT (fine >= 0 AND sequence >= 1 AND fine <= 90000)) AS quarantined""")
def v01_validation(s, d):
    good, bad = Q.validate(T.offences(s, d), {"fine": F.col("fine") >= 0, "sequence": F.col("sequence") >= 1, "limit": F.col("fine") <= 90000})
    return good.agg(F.count("*").alias("valid")).join(F.broadcast(bad.agg(F.count("*").alias("quarantined"))))
