import json
import math
import random
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwarden.operators import entities as E
from sparkwarden.operators import filtering as Q
from sparkwarden.operators import reports as R
from sparkwarden.sources import files, html
from sparkwarden.streaming import feed


def test_table_records(spark):
    page = "<table><tr><th>a</th><th>b</th></tr><tr class='x'><td> 1 &amp; 2 </td><td><a href='#'>t<b>w</b>o</a></td></tr><tr><td>short</td></tr></table>"
    df = spark.createDataFrame([(1, page), (2, ""), (3, None)], "id int, html string")
    assert [tuple(r) for r in html.table_records(df, "html", ["x", "y"], ["id"]).collect()] == [(1, "a", "b"), (1, "1 & 2", "t w o")]


def test_details_and_blocks(spark):
    page = "<dl><dt>Total fine:</dt><dd>£5</dd></dl><table><tr><td>Town</td><td>Leeds</td></tr></table><h2>Toys</h2><h3>Acme</h3><p>unsafe</p><h3>Beta</h3>text<h2>Cars</h2><h3>Gamma</h3>x"
    df = spark.createDataFrame([(1, page), (2, "")], "id int, html string")
    assert [tuple(r) for r in html.details(df, "html", {"fine": "Total fine", "town": "town", "county": "County"}, ["id"]).collect()] == [(1, "£5", "Leeds", None), (2, None, None, None)]
    assert [tuple(r) for r in html.headed_blocks(df, "html", "h2", "h3", ["id"]).collect()] == [(1, "Toys", "Acme", "unsafe"), (1, "Toys", "Beta", "text"), (1, "Cars", "Gamma", "x")]


def test_labelled_text(spark):
    df = spark.createDataFrame([(1, "Page 1\nDefendant: A Smith\nCourt: Leeds\nDefendant: B Jones\nFine: £5")], "id int, body_text string")
    rows = html.split_records(df, "body_text", "Defendant:", ["id"])
    f = html.labelled_fields(F.col("body"), ["Defendant:", "Court:", "Fine:"])
    assert [tuple(r) for r in rows.select(*[c.alias(k) for k, c in f.items()]).collect()] == [("A Smith", "Leeds", None), ("B Jones", None, "£5")]


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"records": [{"id": 1, "n": "x"}, {"id": 2}]}))
    got = files.json_records(spark, str(tmp_path / "a.json"), T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.StringType())]))
    assert [tuple(r) for r in got.collect()] == [(1, "x"), (2, None)]
    (tmp_path / "p.json").write_text(json.dumps({"draw": 1, "data": [["a", "b"], ["c"]]}))
    assert [tuple(r) for r in files.positional_json(spark, str(tmp_path / "p.json"), ["x", "y"]).collect()] == [("a", "b"), ("c", None)]
    (tmp_path / "l.csv").write_text('Title,Year\n"A, Act",1974\n,1980\n')
    good, bad = files.csv_with_required(spark, str(tmp_path / "l.csv"), ["Title", "Year"], ["Title", "Year"])
    assert [tuple(r) for r in good.collect()] == [("A, Act", "1974")] and bad.count() == 1
    out = str(tmp_path / "out")
    files.write_csv(good, out, {"Title": "title", "Year": "year"})
    assert [tuple(r) for r in spark.read.csv(out, header=True, escape='"').collect()] == [("A, Act", "1974")]
    table = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    one.write.parquet(table)
    assert files.append_new(spark.createDataFrame([(2, "x"), (3, "c")], one.schema), table, "id") == {"created": 1, "skipped": 1}
    assert sorted(tuple(r) for r in spark.read.parquet(table).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_feed(spark, tmp_path):
    messages = [(1, 1, "insert", "a"), (1, 2, "update", "b"), (2, 3, "insert", "c"), (2, 4, "delete", None), (3, 5, "update", "d"), (4, 6, "insert", "e"), (1, 7, "insert", "ignored"), (4, 8, "delete", None), (4, 9, "update", "ignored"), (4, 10, "insert", "f"), (4, 11, "update", "g")]
    df = spark.createDataFrame(messages, "id long, seq long, operation string, v string")
    for i, part in enumerate((df.where("seq <= 2"), df.where("seq between 3 and 6"), df.where("seq > 6"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/p{i}")
        # Each part is read by a table object of its own, as after a restart.
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        table = feed.SnapshotTable(spark, f"{tmp_path}/state", "id bigint, seq bigint, v string", "id")
        feed.run_feed(source, table, lambda: F.col("seq"), f"{tmp_path}/progress")
    want = [(1, 2, "b"), (4, 11, "g")]
    assert sorted(tuple(r) for r in table.read().collect()) == want
    # A batch that is run again starts from what the one before it left.
    changes = feed.apply_changes(table.read(2), df.where("seq > 6"), "id", F.col("seq"))
    assert sorted(tuple(r) for r in changes.collect()) == [(4, 11, "g", False)]
    table.write(changes, 2)
    assert sorted(tuple(r) for r in table.read().collect()) == want == sorted(tuple(r) for r in table.compacted(f"{tmp_path}/compact").read().collect())
    assert [tuple(r) for r in feed.apply_changes(table.read(), df.where("seq = 4").withColumn("id", F.lit(1)), "id", F.col("seq")).collect()] == [(1, None, None, True)]


def test_similar_texts_find_every_pair(spark):
    rng = random.Random(4)
    words = ["acme", "acne", "north", "northern", "steel", "steels", "works", "of", "york", "new"]
    names = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(80)] + [None, "", "--"]
    a, b = (spark.createDataFrame([(x,) for x in part], "name string") for part in (names[:50] + names[-3:], names[30:]))

    def grams(x):
        return {f"  {w} "[i : i + 3] for w in re.findall("[a-z0-9]+", x) for i in range(len(w) + 1)}

    for least in (0.3, 0.6, 0.85):
        want = {(x, y) for x in names[:50] for y in names[30:80] if len(grams(x) & grams(y)) / len(grams(x) | grams(y)) >= least}
        assert {(r["name"], r.other) for r in E.similar_texts(a, b, "name", least).collect()} == want


def test_offender_tiers(spark):
    known = spark.createDataFrame([(1, "Acme Steel Works Ltd", "AB1 2CD", "0012"), (2, "North York Farm", None, " "), (3, "Acme Steel Works Ltd", "XY9 9ZZ", None)], "id int, name string, postcode string, number string")
    rows = [("a", "ACME STEEL WORKS LIMITED", "xy9 9zz", None), ("b", "acme steel works ltd.", None, "00 12"), ("c", "North York Farms", "ZZ1 1ZZ", ""), ("d", "nobody", None, None), ("e", None, None, "0012")]
    incoming = spark.createDataFrame(rows, "ref string, name string, postcode string, number string")
    assert {r.ref: (r.offender_id, r.tier) for r in E.match_offenders(incoming, known, 0.6).collect()} == {"a": (3, 1), "b": (1, 2), "c": (2, 3), "d": (None, 4), "e": (None, 4)}
    assert {r.ref: (r.offender_id, r.tier) for r in E.match_by_number(incoming, known, 0.6).collect()} == {"a": (1, 2), "b": (1, 1), "c": (2, 3), "d": (None, 4), "e": (1, 1)}
    best = {r.ref: (r.offender_id, r.score) for r in E.best_candidate(incoming, known).collect()}
    assert best["a"] == (3, 1.0) and best["b"][0] == 1 and best["d"] == (None, None) == best["e"] and best["c"] == (2, 0.9)
    assert E.match_offenders(incoming.limit(0), known).count() == 0


def test_ranks(spark):
    values = [5.0, 1.0, 1.0, None, 2.0, 9.0, 2.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = R.nearest_rank(df, "v", [1, 50, 95, 100]).first()
    ordered = sorted(v for v in values if v is not None)
    assert list(got) == [ordered[max(0, math.ceil(6 * p / 100) - 1)] for p in (1, 50, 95, 100)]
    assert tuple(R.nearest_rank(df.limit(0), "v", [50]).first()) == (None,)
    assert R.statistics(df, F.col("v")).first().median == 2.0


def test_edges(spark):
    df = spark.createDataFrame([(1, None, None), (2, 0.0, "a"), (3, 1000.0, "a"), (4, 100000.0, ""), (5, 999.99, "b")], "id int, fine double, k string")
    h = {r.low: r.n for r in R.histogram(df, F.col("fine"), [0.0, 1000.0, 100000.0]).collect()}
    assert h == {0.0: 3, 1000.0: 1, 100000.0: 1}
    assert {r.label: r.n for r in R.by_group(df, F.col("k"), F.col("fine")).collect()} == {"Unknown": 2, "a": 2, "b": 1}
    assert tuple(R.statistics(df.limit(0), F.col("fine")).first()) == (0, 0.0, 0.0, 0.0, 0.0, 0.0)
    good, bad = Q.validate(df, {"fine": F.col("fine") >= 500, "k": F.col("k") != ""})
    assert sorted(r.id for r in good.collect()) == [1, 3, 5] and {r.id: r.broken_rules for r in bad.collect()} == {2: ["fine"], 4: ["k"]}
    rows = [("g1", 3, m) for m in (1, 2, 3)] + [("g2", 2, m) for m in (3, 4)] + [("g3", 2, m) for m in (5, 6)] + [("g4", 2, m) for m in (1, 2)]
    groups = spark.createDataFrame(rows, "g string, n int, member int")
    assert sorted((r.g, r.member) for r in E.largest_groups(groups, "g").collect()) == [(g, m) for g, _, m in rows if g != "g4"]
    twins = spark.createDataFrame([("a", " "), ("b", " "), ("c", None), ("d", "x"), ("e", "x")], "id string, k string")
    assert sorted(map(tuple, E.duplicate_members(twins, {"k": F.col("k")}, F.col("id")).collect())) == [("x", 2, "d"), ("x", 2, "e")]
