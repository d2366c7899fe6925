"""Sources and sinks on whole tables: documents are made of table columns, and reading them must give the columns back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from sparkwarden.functions import text, values
from sparkwarden.plans import tables as T
from sparkwarden.plans import unified as U
from sparkwarden.plans.storage import shared_path
from sparkwarden.queries import query
from sparkwarden.sources import files
from sparkwarden.sources import html as H


def _cells(*columns):
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td class='c'> "), c.cast("string"), F.lit("</td>")) for c in columns], F.lit("</tr>"))


@query(""" SELECT id, name, industry, CAST(agency_id AS VARCHAR) AS agency FROM offenders""")
def sc06_html_table(s, d):
    # Pages of 50 rows; the heading row has another number of cells and is dropped.
    pages = T.offenders(s, d).groupBy(F.floor(F.col("id") / 50)).agg(F.concat(F.lit("<table><tr><th>Notices</th></tr>"), F.array_join(F.collect_list(_cells(F.col("id"), F.concat(F.lit("<a href='#'>"), "name", F.lit("</a>")), F.col("industry"), F.col("agency_id"))), ""), F.lit("</table>")).alias("html"))
    return H.table_records(pages, "html", ["id", "name", "industry", "agency"], []).withColumn("id", F.col("id").cast("bigint"))


@query(""" SELECT id, strftime(action_date, '%Y-%m-%d') AS action_date, CAST(fine AS DOUBLE) AS total_fine, result FROM cases""")
def sc09_detail_pages(s, d):
    # sc08 and sc10 read the same label lists; sc08's is the two-cell table row.
    c = T.cases(s, d)
    page = c.select("id", F.concat(F.lit("<dl><dt>Action Date:</dt><dd>"), F.date_format("action_date", "dd/MM/yyyy"), F.lit("</dd><dt>Total Fine</dt><dd>£"), F.format_number("fine", 2), F.lit("</dd></dl><table><tr><td>Result</td><td><b>"), "result", F.lit("</b></td></tr></table>")).alias("html"))
    m = H.details(page, "html", {"d": "action date", "f": "total fine", "result": "result"}, ["id"])
    return m.select("id", T.day(values.parse_date(F.col("d"))).alias("action_date"), values.money_or_null(F.col("f")).cast("double").alias("total_fine"), "result")


@query(""", y AS (SELECT min(year(action_date)) AS a, max(year(action_date)) AS b FROM cases) SELECT strftime(CAST(unnest(generate_series(make_date(a, 1, 1)::TIMESTAMP, make_date(b, 12, 31)::TIMESTAMP, INTERVAL 3 MONTH)) AS DATE), '%Y-%m-%d') AS quarter_start FROM y""")
def sc11_quarters(s, d):
    # y09, quarter ranges, and y06, cut-off dates, are the same arithmetic.
    y = T.cases(s, d).agg(F.min(F.year("action_date")).alias("a"), F.max(F.year("action_date")).alias("b"))
    q = F.sequence(F.make_date("a", F.lit(1), F.lit(1)), F.make_date("b", F.lit(12), F.lit(31)), F.expr("INTERVAL 3 MONTH"))
    return y.select(F.explode(q).alias("q")).select(T.day("q").alias("quarter_start"))


@query(""" SELECT industry AS category, name AS title, 'balance ' || CAST(balance AS VARCHAR) AS body FROM offenders""")
def sc15_headed_blocks(s, d):
    # sc12, sc16 and sc19 (accordions) have the same shape: an outer heading, inner headings, a block below each.
    block = F.concat(F.lit("<h3>"), "name", F.lit("</h3><p>balance "), F.col("balance").cast("string"), F.lit("</p>"))
    pages = T.offenders(s, d).groupBy("industry", F.floor(F.col("id") / 250)).agg(F.concat(F.lit("<h2 id='x'>"), "industry", F.lit("</h2>"), F.array_join(F.collect_list(block), "\n")).alias("html"))
    return H.headed_blocks(pages, "html", "h2", "h3", []).select("category", "title", "body")


@query(""" SELECT name AS defendant, industry AS court, CAST(balance AS DOUBLE) AS fine FROM offenders""")
def sc18_labelled_text(s, d):
    body = F.concat(F.lit("Defendant: "), "name", F.lit("\nCourt: "), "industry", F.lit("\n Fine: £"), F.col("balance").cast("string"), F.lit("\n"))
    docs = T.offenders(s, d).groupBy(F.floor(F.col("id") / 50)).agg(F.concat(F.lit("Page 1 of 2\n"), F.array_join(F.collect_list(body), "")).alias("pdf"))
    f = H.labelled_fields(F.col("body"), ["Defendant:", "Court:", "Fine:"])
    rows = H.split_records(docs, "pdf", "Defendant:", [])
    return rows.select(f["Defendant:"].alias("defendant"), f["Court:"].alias("court"), F.replace(f["Fine:"], F.lit("£"), F.lit("")).cast("double").alias("fine"))


@query(""" SELECT id, title, year FROM legislation""")
def sc04_json_records(s, d):
    path = shared_path(s, "json")
    l = T.legislation(s, d)
    l.groupBy(F.floor(F.col("id") / 50)).agg(F.collect_list(F.struct("id", "title", "year")).alias("records")).select("records").write.json(path)
    return files.json_records(s, path, Ty.StructType([Ty.StructField("id", Ty.LongType()), Ty.StructField("title", Ty.StringType()), Ty.StructField("year", Ty.IntegerType())]), multi_line=False)


@query(""" SELECT count(*) FILTER (WHERE id % 7 <> 0) AS imported, count(*) FILTER (WHERE id % 7 = 0) AS skipped FROM legislation""")
def sc05_csv_import(s, d):
    # sk04 writes the file, sc05 reads it: rows without a title are skipped and counted.
    path = shared_path(s, "csv")
    l = T.legislation(s, d).withColumn("title", F.when(F.col("id") % 7 != 0, F.concat(F.lit('a "quoted", '), "title")))
    files.write_csv(l, path, {"title": "Title", "year": "Year", "number": "Number"})
    good, bad = files.csv_with_required(s, path, ["Title", "Year", "Number"], ["Title", "Year", "Number"])
    return good.agg(F.count("*").alias("imported")).join(F.broadcast(bad.agg(F.count("*").alias("skipped"))))


@query(""" SELECT CAST(id AS VARCHAR) AS uprn, name AS premises, industry AS status FROM offenders""")
def sc14_positional_json(s, d):
    path = shared_path(s, "pages")
    o = T.offenders(s, d).groupBy(F.floor(F.col("id") / 50)).agg(F.collect_list(F.array(F.col("id").cast("string"), "name", "industry")).alias("data"))
    o.select("data").write.json(path)
    return files.positional_json(s, path, ["uprn", "premises", "status"], multi_line=False)


@query(""" SELECT record_type, id, strftime(action_date, '%Y') AS year, CASE record_type WHEN 'case' THEN CAST(fine AS VARCHAR) ELSE 'N/A' END AS fine FROM facts""")
def sk02_timeline_csv(s, d):
    # sk01 and sk03 are other column lists of the same writer.
    f = U.unified(T.cases(s, d), T.notices(s, d)).withColumns({"year": F.date_format("action_date", "yyyy"), "shown": F.when(F.col("record_type") == "case", F.col("fine").cast("string")).otherwise("N/A")})
    path = shared_path(s, "timeline")
    files.write_csv(f, path, {"record_type": "record_type", "id": "id", "year": "year", "shown": "fine"})
    return s.read.schema("record_type string, id bigint, year string, fine string").csv(path, header=True)


@query(""" SELECT id, CAST(fine AS DOUBLE) AS fine, result FROM cases WHERE fine > 200000""")
def sk05_json_export(s, d):
    # f27, the report filter, chooses the rows.
    path = shared_path(s, "export")
    files.write_json(T.cases(s, d).where("fine > 200000").select("id", T.as_double("fine").alias("fine"), "result"), path)
    return s.read.schema("id bigint, fine double, result string").json(path)


@query(""" SELECT (SELECT count(*) FROM cases WHERE id % 3 = 0) AS created, (SELECT count(*) FROM cases WHERE id % 3 <> 0) AS skipped, (SELECT count(*) FROM cases) AS stored""")
def sk09_bulk_insert(s, d):
    # sk08 and sk10 append the same way.
    path = shared_path(s, "store")
    c = T.cases(s, d).select("id", "result")
    c.where("id % 3 <> 0").write.parquet(path)
    n = files.append_new(c, path, "id")
    return s.read.schema(c.schema).parquet(path).agg(F.lit(n["created"]).cast("bigint").alias("created"), F.lit(n["skipped"]).cast("bigint").alias("skipped"), F.count("*").alias("stored"))


@query(""" SELECT id FROM cases WHERE result <> 'P'""")
def sk11_delete_by_id(s, d):
    c = T.cases(s, d)
    return files.without_ids(c, c.where("result = 'P'"), "id").select("id")


@query(""", p AS (SELECT id, 'Company ' || id || ' Ltd, of Leeds, was fined £' || CAST(fine AS VARCHAR) || ' with costs of £' || CAST(costs AS VARCHAR) || ' on ' || strftime(action_date, '%d/%m/%Y') AS t, fine, costs, action_date FROM cases)
SELECT id, 'Company ' || id || ' Ltd' AS offender, CAST(fine AS DOUBLE) AS fine, CAST(costs AS DOUBLE) AS costs, strftime(action_date, '%Y-%m-%d') AS hearing, CAST(fine + costs AS DOUBLE) AS total FROM p""")
def x34_article_extraction(s, d):
    # x35 to x37 take the same steps with other labels.
    c = T.cases(s, d)
    t = F.concat(F.lit("Company "), "id", F.lit(" Ltd, of Leeds, was fined £"), F.col("fine").cast("string"), F.lit(" with costs of £"), F.col("costs").cast("string"), F.lit(" on "), F.date_format("action_date", "dd/MM/yyyy"))
    amount = lambda label: values.money_or_null(F.regexp_extract(t, rf"{label} (£[0-9,.]*[0-9])", 1))
    fine, costs = amount("fined"), amount("costs of")
    return c.select("id", F.regexp_extract(t, r"^([^,]*? (?:Ltd|Limited|PLC))", 1).alias("offender"), fine.cast("double").alias("fine"), costs.cast("double").alias("costs"), T.day(values.parse_date(F.regexp_extract(t, r"on ([0-9/]+)$", 1))).alias("hearing"), values.sum_known(fine, costs).cast("double").alias("total"))


@query(""" SELECT id, CASE WHEN id % 3 = 0 OR id % 5 = 0 THEN 'major' WHEN id % 2 = 0 THEN 'minor' ELSE 'none' END AS severity, CASE WHEN id % 3 = 0 THEN 'water' WHEN id % 5 = 0 THEN 'air' WHEN id % 2 = 0 THEN 'land' ELSE 'land' END AS receptor,
nullif(concat_ws('; ', CASE WHEN id % 3 = 0 THEN 'major' END, CASE WHEN id % 2 = 0 THEN 'minor' END, CASE WHEN id % 5 = 0 THEN 'major' END), '') AS impacts FROM cases""")
def x19_environmental_impact(s, d):
    w, l, a = F.when(F.col("id") % 3 == 0, "major"), F.when(F.col("id") % 2 == 0, "minor"), F.when(F.col("id") % 5 == 0, "major")
    return T.cases(s, d).select("id", text.severity(w, l, a).alias("severity"), text.receptor(w, l, a).alias("receptor"), text.impacts(w, l, a).alias("impacts"))


@query(""" SELECT id, name || ', ' || industry AS address, coalesce(nullif(CASE WHEN id % 25 < 20 THEN id % 25 + 1 ELSE 0 END, 0), -1) AS ordinal FROM offenders""")
def x25_addresses(s, d):
    # x26, ordinal words, is the third column.
    k = F.col("id") % 25
    word = F.when(k < 20, F.element_at(F.array(*map(F.lit, text.ORDINALS)), (F.least(k, F.lit(19)) + 1).cast("int"))).otherwise("none")
    return T.offenders(s, d).select("id", text.join_parts(F.col("name"), F.lit(" "), F.lit(None).cast("string"), F.col("industry")).alias("address"), F.coalesce(text.ordinal(word), F.lit(-1)).alias("ordinal"))


#: Status texts and what they mean here (fixed values).
STATUS = {"O": "In Force", "F": "Complied With", "P": "Withdrawn"}


@query(""" SELECT id, CASE result WHEN 'O' THEN 'In Force' WHEN 'F' THEN 'Complied With' WHEN 'P' THEN 'Withdrawn' ELSE 'Unknown' END AS status, CASE WHEN action_type IN ('1-URGENT', '2-HIGH') THEN 'Prosecution' ELSE 'Notice' END AS kind FROM cases""")
def x28_status_maps(s, d):
    # f31, the action-type predicate, is the third column.
    m = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    return T.cases(s, d).select("id", F.coalesce(F.try_element_at(m, F.col("result")), F.lit("Unknown")).alias("status"), F.when(F.col("action_type").isin("1-URGENT", "2-HIGH"), "Prosecution").otherwise("Notice").alias("kind"))


@query(""" SELECT o.case_id, o.sequence, o.legislation_id, o.part_no, l.title || ' - Section ' || o.sequence AS reference, CASE WHEN c.id IS NOT NULL THEN 'case' ELSE 'unknown' END AS parent_type, o.sequence IS NOT NULL AS has_sequence FROM offences o JOIN legislation l ON o.legislation_id = l.id LEFT JOIN cases c ON o.case_id = c.id""")
def x40_offence_references(s, d):
    # x46 and x47 (links from breaches to legislation, with places kept) give these rows.
    l = T.legislation(s, d).select(F.col("id").alias("legislation_id"), "title")
    c = T.cases(s, d).select(F.col("id").alias("case_id"), F.lit("case").alias("_p"))
    x = T.offences(s, d).join(l, "legislation_id").join(c, "case_id", "left")
    return x.select("case_id", "sequence", "legislation_id", "part_no", F.concat("title", F.lit(" - Section "), "sequence").alias("reference"), F.coalesce("_p", F.lit("unknown")).alias("parent_type"), F.col("sequence").isNotNull().alias("has_sequence"))


@query(""", n AS (SELECT id, CAST(fine AS DOUBLE) AS fine, CAST(fine AS DOUBLE) / CASE WHEN fine >= 1000000 THEN 1e6 ELSE 1e3 END AS q FROM cases)
SELECT id, CASE WHEN fine < 1000 THEN CAST(fine AS VARCHAR).regexp_replace('\\.0$', '') ELSE printf('%.1f', CASE WHEN q * 4 = floor(q * 4) THEN floor(q * 10 + 0.5) / 10 ELSE q END) || CASE WHEN fine >= 1000000 THEN 'M' ELSE 'K' END END AS shown FROM n""")
def y16_number_format(s, d):
    return T.cases(s, d).select("id", values.short_number(T.as_double("fine")).alias("shown"))


@query(""" SELECT id, CASE id % 3 WHEN 0 THEN 7 WHEN 1 THEN 2 ELSE -1 END AS total FROM cases""")
def y14_sum_known(s, d):
    k = F.col("id") % 3
    a, b = F.when(k == 0, 5), F.when(k.isin(0, 1), 2)
    return T.cases(s, d).select("id", F.coalesce(values.sum_known(a, b), F.lit(-1)).alias("total"))


@query(""" SELECT event_id, len(list_filter(['a', '', CASE WHEN event_type = 'view' THEN 'v' END], lambda x: x <> '')) AS n FROM events""")
def p07_drop_empty(s, d):
    # y21 (sizes, flattened sets) is the count.
    m = F.map_from_arrays(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.array(F.lit("a"), F.lit(""), F.when(F.col("event_type") == "view", "v")))
    return T.load(s, d, "events").select("event_id", F.size(text.drop_empty(m)).cast("bigint").alias("n"))
