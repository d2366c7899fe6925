"""Inventory ids whose operator is part of another query, applied by themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwarden.functions import grammar as P
from sparkwarden.functions import text, values
from sparkwarden.operators import entities as E
from sparkwarden.operators import filtering as Q
from sparkwarden.plans import tables as T
from sparkwarden.plans import unified as U
from sparkwarden.queries import query
from sparkwarden.queries.matching import D05, _snapshots


@query(""", n AS (SELECT id, upper(title) || CASE id % 3 WHEN 0 THEN ' LIMITED' WHEN 1 THEN ' COMPANY  LIMITED' ELSE ' UNLIMITED' END AS t FROM legislation)
SELECT id, array_to_string(list_transform(list_filter(string_split(t, ' '), lambda w: w <> ''), lambda w: CASE w WHEN 'LIMITED' THEN 'LTD' WHEN 'COMPANY' THEN 'CO' ELSE w END), ' ') AS name FROM n""")
def x03_short_names(s, d):
    k = F.col("id") % 3
    name = F.concat(F.lit(" "), "title", F.when(k == 0, " Limited").when(k == 1, " Company  Limited").otherwise(" Unlimited"))
    return T.legislation(s, d).select("id", text.short_name(name).alias("name"))


KINDS = """, n AS (SELECT id, year, title || CASE id % 5 WHEN 0 THEN ' Act' WHEN 1 THEN ' Regulations' WHEN 2 THEN ' Approved Code of Practice' WHEN 3 THEN ' Order' ELSE '' END || CASE WHEN id % 2 = 0 THEN ' ' || year ELSE '' END AS t FROM legislation)"""


def _kinds(s, d):
    k = F.col("id") % 5
    end = F.when(k == 0, " Act").when(k == 1, " Regulations").when(k == 2, " Approved Code of Practice").when(k == 3, " Order").otherwise("")
    return T.legislation(s, d).select("id", F.concat("title", end, F.when(F.col("id") % 2 == 0, F.concat(F.lit(" "), "year")).otherwise("")).alias("t"))


@query(KINDS + """ SELECT id, CASE WHEN contains(t, 'Code of Practice') THEN 'acop' WHEN contains(t, 'Regulation') THEN 'regulation' WHEN contains(lower(t), 'order') THEN 'order' ELSE 'act' END AS type FROM n""")
def x07_legislation_types(s, d):
    return _kinds(s, d).select("id", text.legislation_type(F.col("t")).alias("type"))


@query(KINDS + """ SELECT id, CASE WHEN id % 2 = 0 THEN year END AS year FROM n""")
def x08_title_years(s, d):
    return _kinds(s, d).select("id", text.title_year(F.col("t")).alias("year"))


@query(KINDS + """, c AS (SELECT CASE id % 5 WHEN 0 THEN 'ukpga' WHEN 1 THEN 'uksi' WHEN 3 THEN 'uksi' END AS code FROM n) SELECT coalesce(code, 'none') AS code, count(*) AS n FROM c GROUP BY 1""")
def x45_type_codes(s, d):
    return _kinds(s, d).groupBy(F.coalesce(text.type_code(F.col("t")), F.lit("none")).alias("code")).agg(F.count("*").alias("n"))


SENTENCES = """, p AS (SELECT id, id % 40 + 1 AS n, id % 7 AS k, CAST(floor(fine) AS BIGINT) AS f FROM cases),
t AS (SELECT id, concat_ws(', ', CASE WHEN k <> 0 THEN 'Fined £' || format('{:,}', f) END, CASE WHEN k = 1 THEN n || ' months imprisonment' WHEN k = 2 THEN n || ' years custody' END, CASE WHEN k = 2 THEN 'suspended for ' || n || ' months' WHEN k = 3 THEN 'Suspended ' || n || ' years' END,
CASE WHEN k = 4 THEN 'community order for ' || n || ' months' WHEN k = 5 THEN n || ' month community order' END, CASE WHEN k > 4 THEN n || ' hours unpaid work' END) AS t FROM p)"""


def _sentences(s, d):
    n, k = (F.col("id") % 40 + 1).cast("string"), F.col("id") % 7
    parts = [
        F.when(k != 0, F.concat(F.lit("Fined £"), F.format_number(F.floor("fine"), 0))),
        F.when(k == 1, F.concat(n, F.lit(" months imprisonment"))).when(k == 2, F.concat(n, F.lit(" years custody"))),
        F.when(k == 2, F.concat(F.lit("suspended for "), n, F.lit(" months"))).when(k == 3, F.concat(F.lit("Suspended "), n, F.lit(" years"))),
        F.when(k == 4, F.concat(F.lit("community order for "), n, F.lit(" months"))).when(k == 5, F.concat(n, F.lit(" month community order"))),
        F.when(k > 4, F.concat(n, F.lit(" hours unpaid work"))),
    ]
    return T.cases(s, d).select("id", F.concat_ws(", ", *parts).alias("t"))


@query(SENTENCES + """ SELECT id, try_cast(replace(regexp_extract(t, '£([0-9,]+)', 1), ',', '') AS DOUBLE) AS fine,
coalesce(try_cast(regexp_extract(t, '([0-9]+) months imprisonment', 1) AS INT), 12 * try_cast(regexp_extract(t, '([0-9]+) years custody', 1) AS INT)) AS imprisonment,
coalesce(try_cast(regexp_extract(t, 'suspended for ([0-9]+) months', 1) AS INT), 12 * try_cast(regexp_extract(t, 'Suspended ([0-9]+) years', 1) AS INT)) AS suspended,
coalesce(try_cast(regexp_extract(t, 'order for ([0-9]+) months', 1) AS INT), try_cast(regexp_extract(t, '([0-9]+) month community', 1) AS INT)) AS community, try_cast(regexp_extract(t, '([0-9]+) hours', 1) AS INT) AS hours FROM t""")
def x35_sentences(s, d):
    x = _sentences(s, d).select("id", P.sentence(F.col("t")).alias("p"))
    return x.select("id", F.col("p.fine").cast("double").alias("fine"), F.col("p.imprisonment_months").alias("imprisonment"), F.col("p.suspended_months").alias("suspended"), F.col("p.community_months").alias("community"), F.col("p.unpaid_hours").alias("hours"))


def _cases(s, d):
    k = F.col("id") % 4
    money = F.format_number("fine", 2)
    t = F.concat(
        F.lit("Pat Example"), F.when(k < 2, F.concat(F.lit(", "), (F.col("id") % 60 + 18).cast("string"))).otherwise(""), F.lit(", of Port "), F.col("result"), F.lit(". The skipper appeared at Hull "), F.when(k == 0, "Crown").otherwise("Magistrates"),
        F.lit(" Court, contrary to Section "), (F.col("id") % 9 + 1).cast("string"), F.lit("(1) of the Merchant Shipping Act 1995 and Regulation 4 of the Safety of Vessels Regulations 1998"),
        F.when(k != 3, F.concat(F.lit(", was fined £"), money)).otherwise(""), F.when(k == 1, ", with costs of £1,250.50 and £95 victim surcharge").otherwise(""), F.when(k == 2, ", 12 weeks suspended and 80 hours of unpaid work").otherwise(""),
    )
    return T.cases(s, d).select("id", t.alias("t"))


@query(""" SELECT id, CASE WHEN id % 4 < 2 THEN CAST(id % 60 + 18 AS INT) END AS age, 'Port ' || result AS place, CASE WHEN id % 4 = 0 THEN 'Hull Crown Court' ELSE 'Hull Magistrates Court' END AS court,
CASE WHEN id % 4 <> 3 THEN CAST(fine AS DOUBLE) END AS fine, CASE WHEN id % 4 = 1 THEN CAST(fine AS DOUBLE) + 1345.5 WHEN id % 4 <> 3 THEN CAST(fine AS DOUBLE) END AS total, CASE WHEN id % 4 = 2 THEN '12 weeks suspended' END AS custodial, CASE WHEN id % 4 = 2 THEN 80 END AS hours,
'Section ' || (id % 9 + 1) || '(1)/Merchant Shipping Act 1995|Regulation 4/Safety of Vessels Regulations 1998' AS offences FROM cases""")
def x36_prosecutions(s, d):
    c = F.col("t")
    x = _cases(s, d).select("id", P.together(c, {"d": P.defendant, "court": P.court, "p": P.components, "o": P.citations}).alias("x")).select("id", "x.*")
    offences = F.array_join(F.transform("o", lambda o: F.concat_ws("/", o["section"], o["law"])), "|")
    return x.select("id", "d.age", "d.place", "court", F.col("p.fine").cast("double").alias("fine"), F.col("p.total").cast("double").alias("total"), "p.custodial", F.col("p.community_hours").alias("hours"), offences.alias("offences"))


@query(""" SELECT id, nullif(concat_ws('; ', CASE WHEN id % 4 <> 3 THEN 'Fine: £' || format('{:,.2f}', CAST(fine AS DOUBLE)) END, CASE WHEN id % 4 = 1 THEN 'Costs: £1,250.50; Victim surcharge: £95.00' END, CASE WHEN id % 4 = 2 THEN 'Custodial: 12 weeks suspended; Unpaid work: 80 hours' END), '') AS line FROM cases""")
def x37_penalty_lines(s, d):
    return _cases(s, d).select("id", P.describe(P.components(F.col("t"))).alias("line"))


@query(""" SELECT id, CASE WHEN id % 3 <> 0 THEN CAST(fine AS DOUBLE) END AS fine FROM cases""")
def y11_money_or_null(s, d):
    k = F.col("id") % 3
    t = F.when(k == 0, "fined an amount of 100").when(k == 1, F.concat(F.lit("fined £ "), F.format_number("fine", 2))).otherwise(F.concat(F.lit("2 firms: £"), F.col("fine").cast("string")))
    return T.cases(s, d).select("id", values.money_or_null(t).cast("double").alias("fine"))


@query(""" SELECT id, CAST(id % 90 + 1 AS DOUBLE) * CASE WHEN id % 2 = 0 THEN 1000000 ELSE 1 END AS fine FROM cases""")
def y12_millions(s, d):
    t = F.concat(F.lit("£"), (F.col("id") % 90 + 1).cast("string"), F.when(F.col("id") % 4 == 0, " million").when(F.col("id") % 2 == 0, "m").otherwise(" minimum"))
    return T.cases(s, d).select("id", values.money_or_null(t).cast("double").alias("fine"))


@query(""" SELECT id, CASE WHEN id % 5 = 0 THEN 0.0 ELSE CAST(fine AS DOUBLE) END AS fine FROM cases""")
def y13_clean_fines(s, d):
    t = F.when(F.col("id") % 5 == 0, "n/a").otherwise(F.concat(F.lit(" £"), F.format_number("fine", 2), F.lit(" ")))
    return T.cases(s, d).select("id", values.clean_fine(t).cast("double").alias("fine"))


@query(""" SELECT id, CAST(coalesce(fine, 0) + coalesce(costs, 0) AS DOUBLE) AS total FROM facts WHERE record_type = 'case'""")
def y15_total_penalties(s, d):
    return T.cases(s, d).select("id", values.total_penalty(F.col("fine"), F.col("costs")).cast("double").alias("total"))


@query(D05 + """ SELECT st.status, s.id, n.result FROM st s JOIN new n ON s.id = n.id JOIN st ON st.id = s.id UNION ALL SELECT 'kept', id, result FROM old WHERE id NOT IN (SELECT id FROM new)""")
def sk08_upsert(s, d):
    old, new = _snapshots(s, d)
    status = E.reconcile(old, new, "id", ["result", "action_type"]).select("id", "status")
    return E.upsert(old, new, "id").join(status, "id", "left").select(F.coalesce("status", F.lit("kept")).alias("status"), "id", "result")


@query(""" SELECT offender_id, action_date, count(*) AS n FROM notices GROUP BY 1, 2 HAVING count(*) > 1""")
def a27_repeated_groups(s, d):
    return T.notices(s, d).groupBy("offender_id", "action_date").agg(F.count("*").alias("n")).where("n > 1")


@query(""" SELECT record_type, id, action_type FROM facts WHERE record_type = 'notice'""")
def p02_notice_rows(s, d):
    return U.unified(T.cases(s, d), T.notices(s, d), "notice").select("record_type", "id", "action_type")


@query(""" SELECT c.id, coalesce(o.name, 'Unknown Organization') AS name FROM cases c LEFT JOIN offenders o ON c.offender_id = o.id AND o.id % 2 = 0""")
def j03_placeholder(s, d):
    return U.with_names(T.cases(s, d), T.offenders(s, d).where("id % 2 = 0")).select("id", F.col("offender_name").alias("name"))


@query(""", x AS (SELECT id, CASE id % 4 WHEN 0 THEN title WHEN 1 THEN title || ' extra' WHEN 2 THEN split_part(title, ' ', 1) || ' ' || split_part(title, ' ', 2) ELSE 'none' END AS part FROM legislation),
l AS (SELECT title, min(id) AS id FROM legislation GROUP BY 1), m AS (SELECT x.part, min(l.id) AS hit FROM (SELECT DISTINCT part FROM x) x JOIN l ON contains(lower(l.title), lower(x.part)) GROUP BY 1)
SELECT x.id, coalesce(m.hit, -1) AS legislation_id FROM x LEFT JOIN m ON x.part = m.part""")
def d16_partial_titles(s, d):
    l = T.legislation(s, d)
    k = F.col("id") % 4
    words = F.split("title", " ")
    part = F.when(k == 0, F.col("title")).when(k == 1, F.concat("title", F.lit(" extra"))).when(k == 2, F.concat_ws(" ", words[0], words[1])).otherwise("none")
    x = l.select("id", part.alias("part"))
    found = E.partial_matches(x, l, "part", "title")
    return x.join(found, "part", "left").select("id", F.coalesce("found_id", F.lit(-1)).alias("legislation_id"))


@query(r""" SELECT event_id, list_extract(string_split(regexp_replace(props, '[^0-9,]', '', 'g'), ','), 1) AS first FROM events""")
def y24_flat_links(s, d):
    # A map of maps flattened: each inner value is an element.
    m = F.from_json(F.concat(F.lit('{"a":'), "props", F.lit("}")), "map<string,map<string,string>>")
    return T.load(s, d, "events").select("event_id", F.flatten(F.transform(F.map_values(m), lambda x: F.map_values(x))).alias("v")).select("event_id", F.get("v", F.lit(0)).alias("first"))


@query(""" SELECT record_type, id FROM facts WHERE record_type = 'case' AND regexp_matches(action_type, '^[1-5]-')""")
def f34_classified(s, d):
    return U.unified(T.cases(s, d), T.notices(s, d)).where(Q.all_of([F.col("record_type") == "case", F.col("action_type").rlike("^[1-5]-")])).select("record_type", "id")
