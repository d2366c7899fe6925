"""Operators that keep state between runs (metric store, syncs, log, registry), nested markup, page traversal, data sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwarden.operators import mentions, traversal
from sparkwarden.operators.metric_store import MetricStore
from sparkwarden.operators.registry import Registry
from sparkwarden.plans import tables as T
from sparkwarden.plans.storage import keep, shared_path
from sparkwarden.queries import query
from sparkwarden.queries.matching import OFFENDERS, _offenders
from sparkwarden.queries.reports import PERIODS
from sparkwarden.sources import markup, paged, reports
from sparkwarden.streaming import feed
from sparkwarden.streaming.log import EventLog


def _facts(s, d):
    """Cases, of which those that are open play the notices (the stand-in streams do not overlap in time), with their agency."""
    c = T.with_agency(T.cases(s, d), T.offenders(s, d))
    return c.withColumn("record_type", F.when(F.col("result") == "O", "notice").otherwise("case"))


@query(""", p(period, days) AS (VALUES ('week', 7), ('month', 30), ('year', 365)),
x AS (SELECT c.*, o.agency_id, p.period FROM cases c LEFT JOIN offenders o ON c.offender_id = o.id JOIN p ON date_diff('day', action_date, (SELECT max(action_date) FROM cases)) <= p.days)
SELECT period, coalesce(x.agency_id, -1) AS agency_id, grouping(x.agency_id) = 1 AS is_total, count(*) FILTER (WHERE result <> 'O') AS cases, count(*) FILTER (WHERE result = 'O') AS notices, CAST(coalesce(sum(fine), 0) AS DOUBLE) AS fines, CAST(coalesce(sum(costs), 0) AS DOUBLE) AS costs, count(DISTINCT offender_id) AS offenders
FROM x GROUP BY GROUPING SETS ((period), (period, x.agency_id))""")
def sk12_metric_store(s, d):
    # Built from facts of which some are missing and some are wrong, in three months; then only these are refreshed.
    facts = _facts(s, d)
    end = facts.agg(F.max("action_date")).scalar()
    late = (F.datediff(end, F.col("action_date")) <= 60) & (F.col("id") % 3 == 0)
    before = facts.withColumn("fine", F.when(late, F.lit(1)).otherwise(F.col("fine")).cast(T.MONEY)).where(~(late & (F.col("id") % 2 == 0)))
    store = MetricStore(s, shared_path(s, "metrics"))
    store.refresh(before)
    months = store.changed_months(facts.where(late), "action_date")
    store.refresh(facts, months)
    return store.metrics(PERIODS).withColumn("agency_id", F.coalesce("agency_id", F.lit(-1)))


LATEST = """, l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) SELECT user_id, event_id AS seq, value FROM l WHERE r = 1 AND event_type <> 'error'"""
_MESSAGE = ["user_id", "seq", "value", "operation"]


def _messages(e):
    return e.select("user_id", F.col("event_id").alias("seq"), "value", F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("operation"), F.to_date("ts").alias("day"))


def _latest(s, name):
    return feed.LatestTable(s, shared_path(s, name), "user_id bigint, seq bigint, value double", "user_id")


@query(LATEST)
def st02_two_phase_sync(s, d):
    m = _messages(T.load(s, d, "events"))
    low, high, live = m.agg(F.min("day").alias("a"), F.date_add(F.max("day"), -7).alias("b"), (F.max("seq") * 0.9).cast("long").alias("n")).first()
    step = (high - low) / 3
    edges = [str(low), *(str(low + step * k) for k in (1, 2)), str(high)]
    table = _latest(s, "two-phase")
    old = m.where(F.col("seq") <= live)  # the source as it stands when the sync begins; the rest arrives while it runs
    sync = lambda: feed.TwoPhaseSync(table, old, "day", edges[-1], list(zip(edges, edges[1:]))[::-1])
    sync().recent()
    sync().backfill(1)
    sync().live(m.where(F.col("seq") > live), "a")
    sync().backfill()  # a new process finds what is loaded and goes on
    return table.read()


#: Messages of a file, hence of a micro-batch: what its tasks hold does not grow with the feed.
BATCH_MESSAGES = 500_000


@query(LATEST)
def st03_buffered_feed(s, d):
    parts = shared_path(s, "messages")
    _messages(T.load(s, d, "events")).select(*_MESSAGE).repartitionByRange(4, "seq").write.option("maxRecordsPerFile", BATCH_MESSAGES).parquet(parts)
    stream = s.readStream.schema("user_id bigint, seq bigint, value double, operation string").option("maxFilesPerTrigger", 1).parquet(parts)
    table = _latest(s, "buffered")
    feed.run_buffered(stream, table, _MESSAGE, shared_path(s, "buffered-progress"), idle_ms=500)
    return table.read()


@query(r""", n AS (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li><a href="[^"]*">[^<]*</a></li>')) AS item, generate_subscripts(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li><a href="[^"]*">[^<]*</a></li>'), 1) AS nth FROM pages),
u AS (SELECT page_id, nth, regexp_extract(item, 'href="([^"]*)"', 1) AS href, regexp_extract(item, '>([^<]+)</a>', 1) AS label FROM n)
SELECT page_id, CAST(nth AS INT) AS nth, replace(href, '&amp;', '&') AS href, trim(regexp_replace(replace(label, '&amp;', '&'), '\s+', ' ', 'g')) AS label FROM u""")
def sc16_navigation(s, d):
    # The raw pages have paragraphs and bold text that never end; the stack of open tags places what follows all the same.
    found = markup.elements(T.load(s, d, "pages"), "html", ["page_id"]).where("path = 'html/body/nav/ul/li/a'")
    nth = F.row_number().over(markup.Window.partitionBy("page_page_id").orderBy("place"))  # one page
    return found.select(F.col("page_page_id").alias("page_id"), nth.alias("nth"), "href", F.col("text").alias("label"))


def _register(s, d):
    """Pages of 25 offenders: a heading for each section, an accordion item for each year, in it a table whose last cell holds a
    table of its own."""
    o = T.offenders(s, d).withColumns({"page": F.floor(F.col("id") / 25), "year": (F.col("id") % 3 + 2020).cast("int")})
    row = F.concat(F.lit("<tr><td>"), "id", F.lit("<td><b>"), "name", F.lit("</b></td><td><table><tr><td>Balance<td>£"), "balance", F.lit("</td></tr></table></td></tr>"))
    items = o.groupBy("page", "industry", "year").agg(F.concat(F.lit("<div class='accordion-item'><button>"), F.col("year").cast("string"), F.lit("</button><table><tbody>"), F.array_join(F.sort_array(F.collect_list(row)), ""), F.lit("</tbody></table></div>")).alias("item"))
    sections = items.groupBy("page", "industry").agg(F.concat(F.lit("<h2>"), "industry", F.lit("</h2><div class='accordion'>"), F.array_join(F.sort_array(F.collect_list("item")), ""), F.lit("</div>")).alias("section"))
    return sections.groupBy("page").agg(F.concat(F.lit("<html><body>"), F.array_join(F.sort_array(F.collect_list("section")), "<hr>"), F.lit("</body></html>")).alias("html"))


@query(""" SELECT industry AS section, CAST(id % 3 + 2020 AS INT) AS year, id, name, CAST(balance AS DOUBLE) AS balance FROM offenders""")
def sc12_accordion_sections(s, d):
    # sc19 (undertakings by year) has the same shape.
    # Pages are scanned once, not for each use, and by all cores: their bytes are few beside the work on them.
    pages = _register(s, d).repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "page")
    found = keep(markup.elements(pages, "html", ["page"]), "elements")
    cells = markup.table_cells(found, ["page"])
    # Outer tables: the rows' cells; the nested table's second cell is the amount of the row that holds it.
    tables = markup.under_headings(found, ["page"], ["h2", "button"], F.col("tag") == "table").select("page_page", F.col("place").alias("table"), "h2", "button", "parent")
    outer = cells.where("depth = 7").groupBy("page_page", "table", "row").agg(F.max(F.when(F.col("cell") == 1, F.col("own"))).alias("id"), F.max(F.when(F.col("cell") == 2, F.col("text"))).alias("name"), F.max(F.when(F.col("cell") == 3, F.col("text"))).alias("amount"))
    rows = outer.join(tables, ["page_page", "table"])
    return rows.select(F.col("h2").alias("section"), F.col("button").cast("int").alias("year"), F.col("id").cast("bigint").alias("id"), "name", F.regexp_extract("amount", "£(.*)$", 1).cast("double").alias("balance"))


@query(""", e AS (SELECT id AS page, lag(id) OVER (PARTITION BY offender_id ORDER BY id) AS target FROM cases UNION SELECT a.id, b.id FROM cases a JOIN cases b ON b.id = xor(a.id, 1)),
r AS (WITH RECURSIVE w(page, steps) AS (SELECT id, 0 FROM cases WHERE fine > 300000 UNION SELECT e.target, w.steps + 1 FROM w JOIN e ON e.page = w.page WHERE e.target IS NOT NULL AND w.steps < 3) SELECT page, min(steps) AS steps FROM w GROUP BY page)
SELECT page AS id, CAST(steps AS INT) AS steps, result FROM r JOIN cases ON cases.id = r.page""")
def sc08_related_cases(s, d):
    # sc07 and sc10 follow the same links: a case's page leads to its offender's case before and to its twin, three pages deep.
    c = T.cases(s, d)
    before = c.select(F.col("id").alias("page"), F.lag("id").over(markup.Window.partitionBy("offender_id").orderBy("id")).alias("to"))
    twins = c.select(F.col("id").alias("page"), F.col("id").bitwiseXOR(F.lit(1)).alias("to")).join(c.select(F.col("id").alias("to")), "to", "left_semi").select("page", "to")
    found = traversal.reachable(before.unionByName(twins), c.where("fine > 300000").select(F.col("id").alias("page")), 3)
    return found.join(c.select(F.col("id").alias("page"), "result"), "page").select(F.col("page").alias("id"), "steps", "result")


@query(""", l AS (SELECT p.pct, e.user_id, e.event_id AS version, e.value, e.event_type, row_number() OVER (PARTITION BY p.pct, e.user_id ORDER BY e.event_id DESC) AS r FROM events e JOIN (VALUES (20), (55), (100)) p(pct) ON e.event_id <= (SELECT max(event_id) FROM events) * p.pct // 100)
SELECT pct, user_id, version, value FROM l WHERE r = 1 AND event_type <> 'error'""")
def st06_as_of(s, d):
    m = _messages(T.load(s, d, "events")).withColumnRenamed("seq", "version")
    last = m.agg(F.max("version")).first()[0]
    log = EventLog(s, shared_path(s, "event-log"), "user_id bigint, value double", "user_id", max(1, last // 10))
    for low, high in ((0, 4), (4, 7), (6, 10)):  # batches; one part of the log arrives twice
        log.append(m.where((F.col("version") >= last * low // 10) & (F.col("version") <= last * high // 10)))
        log.snapshot(last * high // 10 - 1)
    states = [log.as_of(last * p // 100).select(F.lit(p).alias("pct"), "user_id", "version", "value") for p in (20, 55, 100)]
    return states[0].unionByName(states[1]).unionByName(states[2])


@query(OFFENDERS + """, t AS (SELECT DISTINCT n, p FROM i) SELECT ref, n AS key, p AS postcode, 1 AS n_rows, (SELECT count(*) FROM t) AS registered FROM i""")
def d06_find_or_create(s, d):
    # Two batches with many offenders in common: while the first is worked on, the second is published.
    incoming, _ = _offenders(s, d)
    registry = Registry(s, shared_path(s, "registry"))
    second = []

    def other():
        if not second:
            second.append(registry.find_or_create(incoming.where("ref % 2 = 1"), similar=False))

    first = registry.find_or_create(incoming.where("ref % 2 = 0"), similar=False, before_publish=other)
    rows = registry.rows()
    each = rows.groupBy("key", F.coalesce("postcode", F.lit("")).alias("_p")).agg(F.count("*").alias("n_rows"), F.min("id").alias("offender_id"))
    total = rows.agg(F.count("*").alias("registered"))
    found = first.unionByName(second[0]).join(rows.select(F.col("id").alias("offender_id"), "postcode"), "offender_id").join(each.drop("_p"), "offender_id")
    return found.join(F.broadcast(total)).select("ref", "key", "postcode", F.col("n_rows").cast("int").alias("n_rows"), "registered")


@query(""", x AS (SELECT 'Industry Analysis' AS section, '"' || industry || '",' || count(*) || ',' || CAST(sum(balance) AS DECIMAL(18,2)) AS line FROM offenders GROUP BY industry
UNION ALL SELECT 'Top Offenders', '"' || name || '",' || balance || ',"' || industry || '"' FROM offenders WHERE balance > 5000 UNION ALL SELECT 'Summary Statistics', 'Offenders,' || count(*) FROM offenders) SELECT section, line FROM x""")
def sk03_sectioned_report(s, d):
    o = T.offenders(s, d)
    industry = o.groupBy("industry").agg(F.count("*").alias("n"), F.sum("balance").cast(T.MONEY).alias("total")).withColumn("line", F.concat_ws(",", reports.quoted(F.col("industry")), "n", "total"))
    top = o.where("balance > 5000").withColumns({"_last": -F.col("balance"), "line": F.concat_ws(",", reports.quoted(F.col("name")), F.col("balance").cast("string"), reports.quoted(F.col("industry")))})
    summary = o.agg(F.concat(F.lit("Offenders,"), F.count("*")).alias("line"))
    sections = [("Industry Analysis", "Industry,Offenders,Balance", industry, ["industry"]), ("Top Offenders", "Name,Balance,Industry", top, ["_last", "id"]), ("Summary Statistics", "What,Value", summary, ["line"])]
    path = shared_path(s, "report") + ".csv"
    reports.write_report(s, sections, path, "Offender report")
    return reports.read_sections(s, path)


@query(""" SELECT CAST(id AS VARCHAR) AS uprn, name AS premises, industry AS status FROM offenders WHERE industry IN ('BUILDING', 'MACHINERY') AND name LIKE '%1'""")
def sc14_paged_source(s, d):
    path, names = shared_path(s, "endpoint"), ["uprn", "premises", "status"]
    o = T.offenders(s, d).select(F.col("id").alias("uprn"), F.col("name").alias("premises"), F.col("industry").alias("status"))
    paged.write_pages(o, path, F.pmod(F.xxhash64("status"), F.lit(1000)) * 100000 + F.floor(F.col("uprn") / 50), names, ["status"])
    return paged.read_pages(s, path, names).where(F.col("status").isin("BUILDING", "MACHINERY") & F.col("premises").endswith("1"))


@query(r""", b AS (SELECT cases.id AS case_id, 'Breach of the ' || upper(l.title) || ' Act; and, as said, of ' || l.title || ' and ' || m.title || ' regulations by ' || result AS t FROM cases JOIN legislation l ON l.id = cases.id % 1000 % (SELECT max(id) FROM legislation) + 1 JOIN legislation m ON m.id = cases.id % 7 + 1),
k AS (SELECT min(id) AS id, regexp_extract_all(lower(title), '[\p{L}\p{N}]+') AS w FROM legislation GROUP BY 2), w AS (SELECT case_id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM b), n AS (SELECT DISTINCT len(w) AS m FROM k),
p AS (SELECT case_id, i - 1 AS a, i - 1 + m AS e, list_slice(w, i, i + m - 1) AS s FROM w, n, unnest(range(1, len(w) - m + 2)) AS r(i)),
f AS (SELECT p.case_id, p.a, p.e, k.id FROM p JOIN k ON p.s = k.w), x AS (SELECT *, max(e) OVER (PARTITION BY case_id ORDER BY a, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM f)
SELECT case_id, a AS first_word, e AS end_word, id AS legislation_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY a) AS INT) AS place FROM x WHERE far IS NULL OR e > far""")
def x47_breach_mentions(s, d):
    # x46 gives each mention its offence row; what matches no title is dropped, and places are kept.
    laws = T.legislation(s, d)
    n = laws.agg(F.max("id")).scalar()
    l, m = (laws.select(F.col("id").alias(f"_{x}"), F.col("title").alias(f"title_{x}")) for x in "lm")
    c = T.cases(s, d).withColumns({"_l": F.col("id") % 1000 % n + 1, "_m": F.col("id") % 7 + 1}).join(l, "_l").join(m, "_m")
    t = F.concat(F.lit("Breach of the "), F.upper("title_l"), F.lit(" Act; and, as said, of "), "title_l", F.lit(" and "), "title_m", F.lit(" regulations by "), "result")
    return mentions.mentions(c.select(F.col("id").alias("case_id"), t.alias("t")), laws.select(F.col("id").alias("legislation_id"), "title"), "t", "title", "case_id", "legislation_id")
