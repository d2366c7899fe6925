"""Sources, text extraction and change feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwarden.functions import text
from sparkwarden.plans import tables as T
from sparkwarden.plans.storage import shared_path
from sparkwarden.queries import query
from sparkwarden.sources import html as H
from sparkwarden.streaming import feed


@query(""" SELECT doc_id, source, n_chars FROM documents WHERE doc_id = 17""")
def sc02_point_lookup(s, d):
    return T.load(s, d, "documents").where("doc_id = 17").select("doc_id", "source", "n_chars")


@query(""" SELECT count(*) AS n FROM facts WHERE false""")
def sc03_empty_scan(s, d):
    return T.cases(s, d).where(F.lit(False)).agg(F.count("*").alias("n"))


@query(r""" SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>', 1), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&pound;', '£'), '&amp;', '&'), '\s+', ' ', 'g')) AS title,
len(regexp_extract_all(html, '(?is)<p(?:\s[^>]*)?>(.*?)</p\s*>', 1)) AS paragraphs, len(regexp_extract_all(html, '(?is)<a(?:\s[^>]*)?>(.*?)</a\s*>', 1)) AS links FROM pages""")
def sc13_articles(s, d):
    p = T.load(s, d, "pages")
    return p.select("page_id", H.element(F.col("html"), "title").alias("title"), F.size(H.elements(F.col("html"), "p")).cast("bigint").alias("paragraphs"), F.size(H.elements(F.col("html"), "a")).cast("bigint").alias("links"))


@query(r""", x AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) SELECT href, count(*) AS n, count(DISTINCT page_id) AS pages FROM x GROUP BY 1""")
def sc07_links(s, d):
    x = T.load(s, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))
    return x.groupBy("href").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


@query(r""", x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS record FROM documents) SELECT doc_id, record, length(line) AS n FROM x WHERE trim(line) <> ''""")
def sc17_split_records(s, d):
    x = T.load(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("r", "line"))
    return x.where(F.trim("line") != "").select("doc_id", (F.col("r") + 1).cast("bigint").alias("record"), F.length("line").cast("bigint").alias("n"))


@query(r""" SELECT page_id, regexp_replace(lower(regexp_extract(u, '^([A-Za-z]+://[^/?]*)', 1)) || substring(u, length(regexp_extract(u, '^([A-Za-z]+://[^/?]*)', 1)) + 1), '/$', '') AS url FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])utm_[a-z]+=[^&]*', '\1', 'g'), '[?&]+$', '') AS u FROM pages)""")
def x38_normal_urls(s, d):
    return T.load(s, d, "pages").select("page_id", text.normal_url(F.col("url")).alias("url"))


FEED = """, m AS (SELECT user_id, event_id, value, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert' ELSE 'update' END AS operation FROM events),
d AS (SELECT user_id, coalesce(max(event_id) FILTER (WHERE operation = 'delete'), -1) AS cut FROM m GROUP BY 1),
i AS (SELECT m.user_id, min(event_id) AS first FROM m JOIN d ON m.user_id = d.user_id WHERE operation = 'insert' AND event_id > cut GROUP BY 1),
r AS (SELECT m.*, row_number() OVER (PARTITION BY m.user_id ORDER BY event_id DESC) AS r FROM m JOIN i ON m.user_id = i.user_id WHERE event_id = first OR operation = 'update' AND event_id > first)"""


def _feed(s, d):
    e = s.readStream.schema(T.load(s, d, "events").schema).parquet(f"{d}/events*.parquet")
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "insert").otherwise("update")
    return e.select("user_id", "event_id", "value", op.alias("operation")), feed.SnapshotTable(s, shared_path(s, "feed"), "user_id bigint, event_id bigint, value double", "user_id")


@query(FEED + " SELECT user_id, event_id, value FROM r WHERE r = 1")
def st01_change_feed(s, d):
    messages, table = _feed(s, d)
    feed.run_feed(messages, table, lambda: F.col("event_id"), shared_path(s, "feed-progress"))
    return table.read()


@query(FEED + " SELECT user_id, event_id, value FROM r WHERE r = 1")
def st02_compacted_feed(s, d):
    # The feed once more after a restart from its own progress, which adds nothing; then compacted.
    messages, table = _feed(s, d)
    progress = shared_path(s, "feed-progress")
    feed.run_feed(messages, table, lambda: F.col("event_id"), progress)
    again = feed.SnapshotTable(s, table.path, "user_id bigint, event_id bigint, value double", "user_id")
    feed.run_feed(messages, again, lambda: F.col("event_id"), progress)
    return again.compacted(shared_path(s, "feed-compacted")).read()


@query(""", l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, event_id, event_type FROM l WHERE r = 1 AND event_type <> 'error'""")
def st06_replay(s, d):
    e = T.load(s, d, "events").withColumn("operation", F.when(F.col("event_type") == "error", "delete").otherwise("update"))
    return feed.replay(e, "user_id", F.struct("ts", "event_id")).select("user_id", "event_id", "event_type")


@query(""" SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY 1, 2""")
def sc01_full_scan(s, d):
    return T.load(s, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))
