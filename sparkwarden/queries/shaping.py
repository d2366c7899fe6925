"""Text, date and money functions over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwarden.functions import grammar, text, values
from sparkwarden.operators import entities as E
from sparkwarden.plans import tables as T
from sparkwarden.queries import query


@query(r""" SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(trim(name || ' & Sons  Ltd.')), '&', ' and '), '[.,:;!@#$%^*()]', '', 'g'), '\bltd\b', 'limited', 'g'), '\s+', ' ', 'g')) AS name FROM offenders""")
def x01_company_names(s, d):
    return T.offenders(s, d).select("id", text.company_name(F.concat("name", F.lit(" & Sons  Ltd."))).alias("name"))


@query(r""" SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(name || ' & Sons  Ltd.')), '[.,:;!@#$%^&*()]', '', 'g'), '\s+', ' ', 'g'), '\bltd$', 'limited')) AS register, upper(name) || ' LTD CO' AS short FROM offenders""")
def x02_name_variants(s, d):
    # x03, the upper-case form, is the third column.
    n = F.concat("name", F.lit(" & Sons  Ltd."))
    return T.offenders(s, d).select("id", text.register_name(n).alias("register"), text.short_name(F.concat("name", F.lit(" Limited  Company"))).alias("short"))


@query(r""" SELECT id, regexp_replace(regexp_extract('SITE AB' || (id % 90 + 10) || ' ' || (id % 10) || 'CD, UK', '([A-Z]{1,2}[0-9][A-Z0-9]? ?[0-9][A-Z]{2})', 1), ' ', '') AS postcode FROM offenders""")
def x05_postcodes(s, d):
    address = F.concat(F.lit("Site ab"), (F.col("id") % 90 + 10), F.lit(" "), (F.col("id") % 10), F.lit("cd, UK"))
    return T.offenders(s, d).select("id", text.find_postcode(address).alias("postcode"))


@query(r""" SELECT id, upper(substring(title, 1, 1)) || regexp_extract(title, '^.([^ ]* )', 1) || upper(substring(regexp_extract(title, ' (.*)$', 1), 1, 1)) || substring(regexp_extract(title, ' (.*)$', 1), 2) || ' at Work etc. Act' AS title, year AS year, 'ukpga' AS code, 'act' AS type FROM legislation""")
def x06_legislation_titles(s, d):
    # x07 (type), x08 (year) and x45 (type code) are further columns.
    raw = F.concat(F.lit("The "), F.upper("title"), F.lit(" AT WORK ETC ACT, "), F.col("year").cast("string"))
    out = text.legislation_title(raw)
    return T.legislation(s, d).select("id", out.alias("title"), text.title_year(raw).alias("year"), text.type_code(out).alias("code"), text.legislation_type(out).alias("type"))


@query(r""" SELECT id, 'uksi' AS type, year, CAST(id AS VARCHAR) AS number FROM legislation""")
def x09_legislation_urls(s, d):
    url = text.build_legislation_url(F.lit("uksi"), F.col("year"), F.col("id").cast("string"))
    return T.legislation(s, d).select("id", text.legislation_url(url).alias("u")).select("id", "u.type", "u.year", "u.number")


@query(r""" SELECT case_id, sequence, legislation_id, part_no, title || ' Act ' || year || ', Section ' || sequence || '(1)' AS reference, 'Section ' || sequence || '(1)' AS part, title || ' Act ' || year AS act_name, year AS act_year, CAST(5000.50 AS DOUBLE) AS fine FROM offences o JOIN legislation l ON o.legislation_id = l.id""")
def x11_breaches(s, d):
    x = T.offences(s, d).join(T.legislation(s, d).select(F.col("id").alias("legislation_id"), "title", "year"), "legislation_id")
    # Many offences breach the same provision, and each wording is parsed once.
    said = x.withColumns({"_said": F.concat("title", F.lit(" Act "), "year", F.lit(", Section "), "sequence", F.lit("(1)")), "_paid": F.lit("Fine: £5,000.50")})
    parsed = grammar.parsed_once(said, {"b": ("_said", grammar.breach), "p": ("_paid", grammar.breach)})
    return parsed.select("case_id", "sequence", "legislation_id", "part_no", "b.reference", "b.part", "b.act_name", "b.act_year", F.col("p.fine").cast("double").alias("fine"))


@query(r""", t AS (SELECT offender_id, string_agg(action_type, ' ; ' ORDER BY id) AS list FROM cases GROUP BY 1), p AS (SELECT offender_id, list_filter(list_transform(string_split(list || ';; ', ';'), lambda x: trim(x)), lambda x: x <> '') AS items FROM t)
SELECT offender_id, unnest(items) AS item, generate_subscripts(items, 1) AS sequence FROM p""")
def x12_breach_lists(s, d):
    # w02, numbering from 1, is part of it.
    t = T.cases(s, d).groupBy("offender_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "action_type"))), lambda x: x["action_type"]), " ; ").alias("list"))
    return E.numbered(t, "offender_id", text.breaches(F.concat("list", F.lit(";; ")))).select("offender_id", "item", F.col("sequence").cast("bigint").alias("sequence"))


@query(r""", n AS (SELECT id, name || CASE id % 6 WHEN 0 THEN ' LLC' WHEN 1 THEN ' Inc' WHEN 2 THEN ' PLC' WHEN 3 THEN ' Limited' WHEN 4 THEN ' LLP' ELSE '' END AS name FROM offenders)
SELECT id, CASE id % 6 WHEN 0 THEN 'LLC' WHEN 1 THEN 'INC' WHEN 2 THEN 'PLC' WHEN 3 THEN 'LTD' WHEN 4 THEN 'LLP' ELSE 'SOLE' END AS type, CASE id % 6 WHEN 2 THEN 'plc' WHEN 4 THEN 'partnership' WHEN 5 THEN 'individual' ELSE 'limited_company' END AS class FROM n""")
def x14_business_types(s, d):
    k = F.col("id") % 6
    name = F.concat("name", F.when(k == 0, " LLC").when(k == 1, " Inc").when(k == 2, " PLC").when(k == 3, " Limited").when(k == 4, " LLP").otherwise(""))
    kind = text.business_type(name)
    return T.offenders(s, d).select("id", kind.alias("type"), text.business_class(kind).alias("class"))


@query(r""", n AS (SELECT id, lower(industry) || ' ' || CASE id % 3 WHEN 0 THEN 'construction' WHEN 1 THEN 'waste management services' ELSE '' END AS t FROM offenders), r AS (SELECT *, CASE WHEN length(t) > 40 THEN 1.1 WHEN length(t) > 25 THEN 1.05 WHEN length(t) > 15 THEN 1.0 ELSE 0.95 END AS w FROM n),
c AS (SELECT id, t, CASE WHEN t LIKE '%construction%' THEN 0.95 WHEN t LIKE '%waste%management%' THEN 0.9 WHEN t LIKE '%building%' THEN 0.85 END AS s, w FROM r)
SELECT id, CASE WHEN t LIKE '%construction%' THEN 'Construction' WHEN t LIKE '%waste%management%' THEN 'Total service industries' WHEN t LIKE '%building%' THEN 'Construction' END AS industry, CASE WHEN s IS NOT NULL THEN round(CAST(least(1.0, s * w) AS DOUBLE), 6) END AS confidence, coalesce(s IS NULL OR least(1.0, s * w) < 0.8, true) AS needs_review FROM c""")
def x17_industries(s, d):
    k = F.col("id") % 3
    t = F.concat(F.lower("industry"), F.lit(" "), F.when(k == 0, "construction").when(k == 1, "waste management services").otherwise(""))
    return T.offenders(s, d).select("id", text.industry(t).alias("i")).select("id", "i.industry", F.round("i.confidence", 6).alias("confidence"), "i.needs_review")


@query(r""" SELECT id, 'sepa_' || strftime(action_date, '%Y%m%d') || '_' || substring(md5(regexp_replace(lower(action_type), '[^a-z0-9]', '', 'g')), 1, 8) AS record_id, upper(substring(sha256(action_type), 1, 12)) AS hash FROM cases""")
def x20_record_ids(s, d):
    # x21, the short hash, is the third column.
    return T.cases(s, d).select("id", text.record_id("sepa", F.col("action_date"), F.col("action_type")).alias("record_id"), text.short_hash(F.col("action_type"), 12).alias("hash"))


@query(r""" SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS clean, CASE WHEN length(text) > 40 THEN substring(text, 1, 40) || '...' ELSE text END AS short FROM documents""")
def x22_clean_text(s, d):
    # x23, cutting, is the third column.
    t = F.regexp_replace("text", "&", "and")
    return T.load(s, d, "documents").select("doc_id", F.when(F.col("text").contains("&"), F.trim(F.regexp_replace("text", r"\s+", " "))).otherwise(text.clean(t)).alias("clean"), text.truncate(F.col("text"), 40).alias("short"))


@query(r""" SELECT id, CASE WHEN length(CAST(id * 7919 % 9999999 AS VARCHAR)) = 7 THEN '0' || CAST(id * 7919 % 9999999 AS VARCHAR) ELSE CAST(id * 7919 % 9999999 AS VARCHAR) END AS number FROM cases""")
def x24_company_numbers(s, d):
    return T.cases(s, d).select("id", text.company_number(F.concat(F.lit(" "), (F.col("id") * 7919 % 9999999).cast("string"), F.lit(" (opens in new tab)"))).alias("number"))


@query(r""" SELECT id, CASE WHEN coalesce(fine, 0) = 0 THEN 'None' WHEN fine < 1000 THEN 'Low' WHEN fine < 10000 THEN 'Medium' ELSE 'High' END AS severity, CAST(coalesce(fine, 0) + coalesce(costs, 0) AS DOUBLE) AS total, CASE WHEN fine >= 100000 THEN 'Major' WHEN fine >= 10000 THEN 'Significant' ELSE 'Standard' END AS band FROM cases""")
def x30_penalties(s, d):
    # y15 (total) and y18 (band) are further columns.
    return T.cases(s, d).select("id", text.fine_severity(F.col("fine")).alias("severity"), values.total_penalty(F.col("fine"), F.col("costs")).cast("double").alias("total"), values.action_band(F.col("fine")).alias("band"))


@query(r""" SELECT id, CASE WHEN id % 4 = 0 THEN title || ' ' || year || ' No. ' || number WHEN id % 4 = 1 THEN title || ' ' || year WHEN id % 4 = 2 THEN title || ' No. ' || number ELSE title END AS reference FROM legislation""")
def x39_references(s, d):
    k = F.col("id") % 4
    return T.legislation(s, d).select("id", text.legislation_reference(F.col("title"), F.when(k.isin(0, 1), F.col("year")), F.when(k.isin(0, 2), F.col("number"))).alias("reference"))


@query(r""" SELECT event_id, CASE WHEN event_type = 'signup' THEN '[PII]' ELSE props END AS props FROM events""")
def x42_redaction(s, d):
    m = F.create_map(F.when(F.col("event_type") == "signup", "user_email").otherwise(F.lit("props")), F.col("props"))
    return T.load(s, d, "events").select("event_id", F.map_values(text.redact(m))[0].alias("props"))


@query(r""" SELECT id, strftime(action_date, '%Y-%m-%d') AS parsed FROM cases""")
def y01_parse_dates(s, d):
    # y02 and y04 (UK form, ordinals) give the texts; all of them come back to the same date.
    c = F.col("action_date")
    k = F.col("id") % 5
    t = F.when(k == 0, F.date_format(c, "yyyy-M-d")).when(k == 1, values.uk_date(c)).when(k == 2, F.date_format(c, "d-M-yyyy")).when(k == 3, F.date_format(c, "d MMMM yyyy")).otherwise(F.concat(F.lit("On or before "), F.date_format(c, "d"), F.lit("th "), F.date_format(c, "MMMM yyyy")))
    return T.cases(s, d).select("id", T.day(values.parse_ordinal_date(t)).alias("parsed"))


@query(r""" SELECT id, CASE WHEN action_date IS NULL THEN 'unknown' WHEN action_date <= DATE '1998-01-01' THEN 'complied' ELSE 'pending' END AS status FROM cases""")
def y08_compliance(s, d):
    return T.cases(s, d).select("id", values.compliance(F.col("action_date"), F.lit("1998-01-01").cast("date")).alias("status"))


@query(r""" SELECT id, CAST(fine AS DOUBLE) AS amount, CAST(fine AS DOUBLE) AS pounds, CAST(id % 90 + 1 AS DOUBLE) * 1000000 AS millions, 0.0::DOUBLE AS none_ FROM cases""")
def y10_money(s, d):
    # y11 (null on failure), y12 (millions) and y13 (cleaning) are further columns.
    written = F.concat(F.lit("fined £"), F.format_number("fine", 2), F.lit(" in all"))
    return T.cases(s, d).select(
        "id", values.money(written).cast("double").alias("amount"), values.money_or_null(written).cast("double").alias("pounds"), values.money_or_null(F.concat(F.lit("£"), F.col("id") % 90 + 1, F.lit(" million"))).cast("double").alias("millions"), values.clean_fine(F.lit("none")).cast("double").alias("none_")
    )


@query(r""", t AS (SELECT offender_id, CAST(sum(coalesce(fine, 0)) AS DOUBLE) AS fines, count(*) AS n, count(DISTINCT record_type) AS k, date_diff('day', max(action_date), DATE '2024-01-31') AS days FROM facts GROUP BY 1),
p AS (SELECT *, CASE WHEN k > 1 THEN 30 ELSE 0 END + CASE WHEN fines > 100000 THEN 25 ELSE 0 END + CASE WHEN days < 365 THEN 20 ELSE 0 END + CASE WHEN n > 5 THEN 25 ELSE 0 END AS score FROM t)
SELECT offender_id, score, CASE WHEN score >= 70 THEN 'High Risk' WHEN score >= 40 THEN 'Medium Risk' ELSE 'Low Risk' END AS level FROM p""")
def y17_risk(s, d):
    from sparkwarden.plans import unified as U

    f = U.unified(T.cases(s, d), T.notices(s, d)).groupBy("offender_id").agg(F.sum(F.coalesce("fine", F.lit(0))).alias("fines"), F.count("*").alias("n"), F.count_distinct("record_type").alias("k"), F.max("action_date").alias("seen"))
    r = values.risk(F.col("fines"), F.datediff(F.lit("2024-01-31").cast("date"), "seen"), F.col("n"), F.col("k"))
    return f.select("offender_id", r.alias("r")).select("offender_id", "r.score", "r.level")


@query(r""" SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, round(least(100.0, CAST(json_extract(props, '$.k') AS BIGINT) * 100.0 / 200), 1) AS progress FROM events""")
def y22_json(s, d):
    # y23 (path with default) and y26 (progress) are the columns.
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    k = F.coalesce(F.get_json_object(values.json_payload(fenced), "$.k").cast("bigint"), F.lit(0))
    return T.load(s, d, "events").select("event_id", k.alias("k"), values.progress(k, F.lit(200)).alias("progress"))
