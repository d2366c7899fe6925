"""Entity resolution and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwarden.functions import similarity, values
from sparkwarden.operators import entities as E
from sparkwarden.plans import tables as T
from sparkwarden.plans import unified as U
from sparkwarden.queries import query
from sparkwarden.queries.filtering import TRGM


@query(""" SELECT case_id, sequence, count(*) OVER w AS n, legislation_id AS member FROM offences WINDOW w AS (PARTITION BY case_id, sequence) QUALIFY count(*) OVER w > 1""")
def d01_duplicate_cases(s, d):
    # a27, groups with more than one row, is this operator.
    return E.duplicate_members(T.offences(s, d), {"case_id": F.col("case_id"), "sequence": F.col("sequence")}, F.col("legislation_id"))


@query(""", a AS (SELECT 'a-' || offender_id || '-' || strftime(action_date, '%Y-%m-%d') AS grp, id FROM notices), b AS (SELECT 'b-' || offender_id || '-' || action_type AS grp, id FROM notices),
x AS (SELECT grp, id, count(*) OVER (PARTITION BY grp) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b)), y AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, grp) AS r FROM x WHERE n > 1)
SELECT grp, n, id AS member FROM x WHERE grp IN (SELECT grp FROM y WHERE r = 1)""")
def d02_overlapping_groups(s, d):
    # u09, the resolution of overlaps, is its second half.
    n = T.notices(s, d)
    a = E.duplicate_members(n, {"grp": F.concat(F.lit("a-"), "offender_id", F.lit("-"), T.day("action_date"))}, F.col("id"))
    b = E.duplicate_members(n, {"grp": F.concat(F.lit("b-"), "offender_id", F.lit("-"), "action_type")}, F.col("id"))
    return E.largest_groups(a.unionByName(b), "grp")


@query(""" SELECT lower(trim(title)) AS name, count(*) OVER w AS n, id AS member FROM legislation WINDOW w AS (PARTITION BY lower(trim(title))) QUALIFY count(*) OVER w > 1""")
def d03_duplicate_names(s, d):
    return E.duplicate_members(T.legislation(s, d), {"name": F.lower(F.trim("title"))}, F.col("id"))


D05 = """, old AS (SELECT id, result, action_type FROM cases WHERE id % 3 <> 0), new AS (SELECT id, CASE WHEN id % 5 = 0 THEN result || '*' ELSE ' ' || result END AS result, action_type FROM cases),
st AS (SELECT n.id, CASE WHEN o.id IS NULL THEN 'created' WHEN trim(o.result) IS DISTINCT FROM trim(n.result) OR trim(o.action_type) IS DISTINCT FROM trim(n.action_type) THEN 'updated' ELSE 'existing' END AS status FROM new n LEFT JOIN old o ON n.id = o.id)"""


def _snapshots(s, d):
    c = T.cases(s, d).select("id", "result", "action_type")
    return c.where("id % 3 <> 0"), c.withColumn("result", F.when(F.col("id") % 5 == 0, F.concat("result", F.lit("*"))).otherwise(F.concat(F.lit(" "), "result")))


@query(D05 + " SELECT id, status FROM st")
def d05_upsert_status(s, d):
    # j09, the three-way reconcile, is this operator.
    old, new = _snapshots(s, d)
    return E.reconcile(old, new, "id", ["result", "action_type"]).select("id", "status")


@query(D05 + " SELECT status, count(*) AS n FROM st GROUP BY 1")
def a42_batch_counters(s, d):
    old, new = _snapshots(s, d)
    return E.reconcile(old, new, "id", ["result", "action_type"]).groupBy("status").agg(F.count("*").alias("n"))


@query(D05 + " SELECT (SELECT count(*) FROM new WHERE id IN (SELECT id FROM old)) AS existing, (SELECT count(*) FROM new WHERE id NOT IN (SELECT id FROM old)) AS new_, (SELECT count(*) FROM new) AS total")
def d14_existence_counts(s, d):
    # sc22, the pre-read of existing keys, feeds it.
    old, new = _snapshots(s, d)
    marked = new.select("id").join(old.select("id", F.lit(1).alias("known")), "id", "left")
    return marked.agg(F.count("known").alias("existing"), (F.count("*") - F.count("known")).alias("new_"), F.count("*").alias("total"))


D09 = """, refs AS (SELECT id AS ref_id,
CASE id % 6 WHEN 0 THEN 'no such title' WHEN 4 THEN title || 's' ELSE title END AS title, CASE WHEN id % 6 = 5 THEN NULL ELSE year END AS year,
CASE id % 6 WHEN 1 THEN 'other' WHEN 3 THEN 'other' WHEN 4 THEN 'other' ELSE type END AS type, CASE id % 6 WHEN 2 THEN 'none' WHEN 3 THEN 'none' WHEN 4 THEN 'none' ELSE number END AS number FROM legislation),
t1 AS (SELECT year, type, number, min(id) AS i FROM legislation GROUP BY ALL), t2 AS (SELECT title, year, number, min(id) AS i FROM legislation GROUP BY ALL), t3 AS (SELECT title, year, type, min(id) AS i FROM legislation GROUP BY ALL), t4 AS (SELECT title, year, min(id) AS i FROM legislation GROUP BY ALL),
m AS (SELECT r.*, t1.i AS i1, t2.i AS i2, t3.i AS i3, t4.i AS i4 FROM refs r LEFT JOIN t1 ON r.year = t1.year AND r.type = t1.type AND r.number = t1.number LEFT JOIN t2 ON r.title = t2.title AND r.year = t2.year AND r.number = t2.number LEFT JOIN t3 ON r.title = t3.title AND r.year = t3.year AND r.type = t3.type LEFT JOIN t4 ON r.title = t4.title AND r.year = t4.year),
f AS (SELECT DISTINCT m.title, m.year, t4.i, jaro_similarity(m.title, t4.title) AS s FROM m JOIN t4 ON m.year = t4.year WHERE coalesce(i1, i2, i3, i4) IS NULL),
b AS (SELECT title, year, arg_max(i, (s, -i)) AS i5 FROM f WHERE s >= 0.85 GROUP BY 1, 2)
SELECT m.ref_id, coalesce(i1, i2, i3, i4, i5, -1) AS legislation_id, CASE WHEN i1 IS NOT NULL THEN 1 WHEN i2 IS NOT NULL THEN 2 WHEN i3 IS NOT NULL THEN 3 WHEN i4 IS NOT NULL THEN 4 WHEN i5 IS NOT NULL THEN 5 ELSE 6 END AS tier FROM m LEFT JOIN b ON m.title = b.title AND m.year = b.year"""


@query(D09)
def d09_legislation_tiers(s, d):
    l = T.legislation(s, d)
    k = F.col("id") % 6
    refs = l.select(
        F.col("id").alias("ref_id"),
        F.when(k == 0, "no such title").when(k == 4, F.concat("title", F.lit("s"))).otherwise(F.col("title")).alias("title"),
        F.when(k != 5, F.col("year")).alias("year"),
        F.when(k.isin(1, 3, 4), "other").otherwise(F.col("type")).alias("type"),
        F.when(k.isin(2, 3, 4), "none").otherwise(F.col("number")).alias("number"),
    )
    return E.match_legislation(refs, l).select("ref_id", F.coalesce("legislation_id", F.lit(-1)).alias("legislation_id"), "tier")


def _company(s: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace(lower(trim({s})), '.', ''), '\\bltd\\b', 'limited', 'g'), '\\s+', ' ', 'g'))"


def _similar(left: str, right: str) -> str:
    """SQL of g, the pairs (a, b) of texts with common trigrams and their similarity s, by counting what they share."""
    return f"""ta AS (SELECT DISTINCT n FROM {left}), tb AS (SELECT DISTINCT n FROM {right}), ga AS (SELECT n, unnest({TRGM.format('n')}) AS g FROM ta), gb AS (SELECT n, unnest({TRGM.format('n')}) AS g FROM tb),
na AS (SELECT n, count(*) AS c FROM ga GROUP BY 1), nb AS (SELECT n, count(*) AS c FROM gb GROUP BY 1),
g AS (SELECT x.a, x.b, x.c / (na.c + nb.c - x.c) AS s FROM (SELECT ga.n AS a, gb.n AS b, count(*) AS c FROM ga JOIN gb ON ga.g = gb.g GROUP BY 1, 2) x JOIN na ON x.a = na.n JOIN nb ON x.b = nb.n)"""


OFFENDERS = f""", k AS (SELECT id, {_company("title || ' limited'")} AS n, CASE WHEN id % 7 <> 0 THEN upper(type) END AS p, CASE WHEN id % 5 = 0 THEN lpad(CAST(id AS VARCHAR), 8, '0') END AS number FROM legislation),
i AS (SELECT id AS ref, {_company("CASE id % 5 WHEN 0 THEN upper(title) || '  LTD.' WHEN 1 THEN title || ' ltd' WHEN 2 THEN title || 's limited' WHEN 3 THEN title || ' and sons limited' ELSE 'nobody' END")} AS n,
CASE WHEN id % 3 = 0 THEN NULL WHEN id % 4 = 1 THEN 'ELSEWHERE' ELSE upper(type) END AS p, CASE WHEN id % 2 = 0 THEN lpad(CAST(id AS VARCHAR), 8, '0') ELSE ' ' END AS number FROM legislation),
t2 AS (SELECT n, min(id) AS t2 FROM k GROUP BY 1)"""
TIERS = """f AS (SELECT g.a AS n, arg_max(t2.t2, (g.s, -t2.t2)) AS t3 FROM g JOIN t2 ON g.b = t2.n WHERE g.s > {0} GROUP BY 1)
SELECT ref, coalesce(t1, t2.t2, t3, -1) AS offender_id, CASE WHEN t1 IS NOT NULL THEN 1 WHEN t2.t2 IS NOT NULL THEN 2 WHEN t3 IS NOT NULL THEN 3 ELSE 4 END AS tier FROM m LEFT JOIN t2 ON m.n = t2.n LEFT JOIN f ON m.n = f.n"""


def _offenders(s, d):
    l = T.legislation(s, d)
    k = F.col("id") % 5
    number = F.lpad(F.col("id").cast("string"), 8, "0")
    known = l.select("id", F.concat("title", F.lit(" limited")).alias("name"), F.when(F.col("id") % 7 != 0, F.col("type")).alias("postcode"), F.when(k == 0, number).alias("number"))
    name = F.when(k == 0, F.concat(F.upper("title"), F.lit("  LTD."))).when(k == 1, F.concat("title", F.lit(" ltd"))).when(k == 2, F.concat("title", F.lit("s limited"))).when(k == 3, F.concat("title", F.lit(" and sons limited"))).otherwise("nobody")
    place = F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 4 == 1, "elsewhere").otherwise(F.col("type"))
    return l.select(F.col("id").alias("ref"), name.alias("name"), place.alias("postcode"), F.when(F.col("id") % 2 == 0, number).otherwise(" ").alias("number")), known


@query(OFFENDERS + f""", t1 AS (SELECT n, p, min(id) AS t1 FROM k WHERE p IS NOT NULL GROUP BY 1, 2), m AS (SELECT i.ref, i.n, t1.t1 FROM i LEFT JOIN t1 ON i.n = t1.n AND i.p = t1.p), {_similar('i', 'k')}, {TIERS.format(0.85)}""")
def d07_offender_tiers(s, d):
    return E.match_offenders(*_offenders(s, d)).select("ref", F.coalesce("offender_id", F.lit(-1)).alias("offender_id"), "tier")


@query(OFFENDERS + f""", t1 AS (SELECT number, min(id) AS t1 FROM k GROUP BY 1), m AS (SELECT i.ref, i.n, t1.t1 FROM i LEFT JOIN t1 ON i.number = t1.number), {_similar('i', 'k')}, {TIERS.format(0.8)}""")
def d08_offender_by_number(s, d):
    return E.match_by_number(*_offenders(s, d)).select("ref", F.coalesce("offender_id", F.lit(-1)).alias("offender_id"), "tier")


@query(OFFENDERS + f""", {_similar('i', 'k')}, w AS (SELECT DISTINCT a, b, string_split(a, ' ') AS x, string_split(b, ' ') AS y, jaro_similarity(a, b) AS j FROM g WHERE s >= 0.5),
v AS (SELECT a, b, CASE WHEN j > 0.85 THEN greatest(t, 0.9) ELSE t END AS s FROM (SELECT a, b, j, len(list_intersect(list_distinct(x), y)) / len(list_distinct(list_concat(x, y))) AS t FROM w)),
c AS (SELECT i.ref, k.id, i.p IS NOT DISTINCT FROM k.p AS same, CASE WHEN same AND v.s > 0.6 THEN least(v.s + 0.15, 1.0) ELSE v.s END AS score FROM i JOIN v ON i.n = v.a JOIN k ON v.b = k.n WHERE i.p IS NULL OR k.p IS NULL OR i.p = k.p),
best AS (SELECT ref, arg_max(id, (score, same, -id)) AS id, max(score) AS score FROM c WHERE score > 0.7 GROUP BY 1)
SELECT i.ref, coalesce(best.id, -1) AS offender_id, round(coalesce(best.score, 0), 6) AS score FROM i LEFT JOIN best ON i.ref = best.ref""")
def d06_best_candidate(s, d):
    found = E.best_candidate(*_offenders(s, d))
    return found.select("ref", F.coalesce("offender_id", F.lit(-1)).alias("offender_id"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))


@query(""", c AS (SELECT a.id AS ref, a.title || 's' AS name, b.id AS candidate_id, b.title AS candidate, a.type = b.type AS ok FROM legislation a LEFT JOIN legislation b ON a.year = b.year AND a.number = b.number AND a.type = b.type),
g AS (SELECT ref, count(candidate_id) AS n, max(jaro_similarity(name, candidate)) AS score, bool_or(ok) AS ok FROM c GROUP BY 1)
SELECT ref, n, round(score, 6) AS score, CASE WHEN n = 0 THEN 'none' WHEN n = 1 AND score >= 0.9 AND ok THEN 'auto' WHEN n <= 3 THEN 'review' ELSE 'skip' END AS decision FROM g""")
def d10_register_decision(s, d):
    l = T.legislation(s, d)
    a = l.select(F.col("id").alias("ref"), F.concat("title", F.lit("s")).alias("name"), "year", "number", "type")
    b = l.select(F.col("id").alias("candidate_id"), F.col("title").alias("candidate"), "year", "number", "type")
    return E.register_decision(a, b, ["year", "number", "type"], "ref", "name", "candidate", F.lit(True))


D13 = """, sc AS (SELECT *, CASE WHEN number LIKE '%3' THEN 50 ELSE 100 END + length(title) AS score FROM legislation), c AS (SELECT id, first_value(id) OVER (PARTITION BY title ORDER BY score DESC, id) AS canonical_id FROM sc)"""


def _canonical(s, d):
    l = T.legislation(s, d).withColumn("number", F.when(~F.col("number").endswith("3"), F.col("number")))
    return E.canonical(l, ["title"], values.canonical_score(F.col("title"), F.col("year"), F.col("number")))


@query(D13 + " SELECT id, canonical_id FROM c")
def d13_canonical(s, d):
    # y19, the score, decides.
    return _canonical(s, d)


@query(D13 + " SELECT c.canonical_id AS legislation_id, count(*) AS offences, CAST(sum(fine) AS DOUBLE) AS fines FROM offences o JOIN c ON o.legislation_id = c.id GROUP BY 1")
def d11_merge_and_recompute(s, d):
    # a32, the totals that a merge would give, is this result.
    moved = E.repoint(T.offences(s, d), _canonical(s, d), "legislation_id")
    return moved.groupBy("legislation_id").agg(F.count("*").alias("offences"), F.sum("fine").cast("double").alias("fines"))


@query(""", c AS (SELECT offender_id, action_date, action_type FROM notices GROUP BY ALL) SELECT n.id FROM notices n WHERE NOT (n.id % 2 = 1 AND EXISTS (SELECT 1 FROM notices m WHERE m.offender_id = n.offender_id AND m.action_date = n.action_date AND m.id % 2 = 0))""")
def d12_drop_incomplete(s, d):
    n = T.notices(s, d)
    complete = n.where("id % 2 = 0").select("offender_id", "action_date")
    bad = n.where("id % 2 = 1").join(complete, ["offender_id", "action_date"], "left_semi").select("id")
    return n.join(bad, "id", "left_anti").select("id")


@query(""", t AS (SELECT DISTINCT title FROM legislation), x AS (SELECT title, jaro_similarity('small ring', title) AS s FROM t) SELECT title, round(s, 6) AS score FROM x WHERE s >= 0.7""")
def d15_fuzzy_search(s, d):
    return E.spelled_like(T.legislation(s, d), "title", "small ring", 0.7).select("title", F.round("score", 6).alias("score"))


@query(f""", i AS (SELECT title AS n FROM legislation), {_similar('i', 'i')} SELECT a, b, round(s, 6) AS similarity FROM g WHERE a < b AND s >= 0.5""")
def x31_trigram_pairs(s, d):
    t = T.legislation(s, d).select(F.col("title").alias("a"))
    pairs = E.similar_texts(t, t, "a", 0.5).withColumnRenamed("other", "b").where("a < b")
    return pairs.select("a", "b", F.round("score", 6).alias("similarity"))


@query(""", t AS (SELECT DISTINCT title FROM legislation) SELECT title, round(jaro_similarity(title, 'large pipe'), 6) AS jaro FROM t""")
def x32_jaro(s, d):
    return T.legislation(s, d).select("title").distinct().select("title", F.round(similarity.jaro(F.col("title"), F.lit("large pipe")), 6).alias("jaro"))


@query(""", t AS (SELECT DISTINCT title, string_split(title, ' ') AS w FROM legislation), j AS (SELECT title, len(list_intersect(list_distinct(w), ['small', 'ring'])) / len(list_distinct(list_concat(w, ['small', 'ring']))) AS k, jaro_similarity(title, 'small ring') AS s FROM t)
SELECT title, round(CASE WHEN s > 0.85 THEN greatest(k, 0.9) ELSE k END, 6) AS similarity FROM j""")
def x33_name_similarity(s, d):
    return T.legislation(s, d).select("title").distinct().select("title", F.round(similarity.name_similarity(F.col("title"), F.lit("small ring")), 6).alias("similarity"))


@query(""" SELECT record_type, count(*) AS n FROM facts f WHERE EXISTS (SELECT 1 FROM offenders o WHERE o.id = f.offender_id AND o.balance < 0) GROUP BY 1""")
def j05_semi_join(s, d):
    o = T.offenders(s, d).where("balance < 0").select(F.col("id").alias("offender_id"))
    return U.unified(T.cases(s, d), T.notices(s, d)).join(o, "offender_id", "left_semi").groupBy("record_type").agg(F.count("*").alias("n"))
