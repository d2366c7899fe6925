"""Tables in which few names stand again and again: results by brute force, and work that does not square."""

import random
from collections import Counter

from pyspark.sql import functions as F

from sparkwarden.functions import grammar, similarity, text
from sparkwarden.operators import entities as E
from sparkwarden.operators import reports as R
from sparkwarden.queries import QUERIES, stateful
from sparkwarden.sources import markup, paged, reports
from tests.joined import joined_rows


def test_best_candidate(spark):
    rng = random.Random(5)
    rows = lambda n: [(i, rng.choice(["Small Ring Ltd", "small ring limited", "small rings ltd", "big bolt ltd", "small ring and sons ltd", None]), rng.choice(["A", "b ", None])) for i in range(n)]
    incoming, known = spark.createDataFrame(rows(150), "ref int, name string, postcode string"), spark.createDataFrame(rows(150), "id int, name string, postcode string")
    got = {r.ref: (r.offender_id, r.score and round(r.score, 9)) for r in E.best_candidate(incoming, known).collect()}
    norm = lambda df: df.select(df.columns[0], text.company_name(F.col("name")).alias("n"), F.upper(F.trim("postcode")).alias("p"))
    pairs = norm(incoming).crossJoin(norm(known).select("id", F.col("n").alias("m"), F.col("p").alias("q"))).where(similarity.trigram_similarity(F.col("n"), F.col("m")) >= 0.5).withColumn("s", similarity.name_similarity(F.col("n"), F.col("m")))
    best = {}
    for r in pairs.collect():
        if r.p is None or r.q is None or r.p == r.q:
            score = min(r.s + 0.15, 1.0) if r.p == r.q and r.s > 0.6 else r.s
            if score > 0.7:
                best[r.ref] = max(best.get(r.ref, (0, False, 0)), (score, r.p == r.q, -r.id))
    assert got == {i: (-best[i][2], round(best[i][0], 9)) if i in best else (None, None) for i in range(150)}


def test_best_candidate_of_copies(spark):
    names = lambda key: spark.range(2000).select(F.col("id").alias(key), F.lit("small ring ltd").alias("name"), F.lit(None).cast("string").alias("postcode"))
    found = E.best_candidate(names("ref"), names("id"))
    assert joined_rows(found) <= 4000 and {r.offender_id for r in found.collect()} == {0}


def test_register_decision_of_copies(spark):
    a = spark.range(2000).select(F.col("id").alias("ref"), F.concat(F.lit("ring"), (F.col("id") % 3).cast("string")).alias("name"), (F.col("id") % 1000 == 0).cast("int").alias("k"))
    b = spark.createDataFrame([(0, "ring1", 0)] * 2000 + [(2000, "ring1", 1), (2001, None, 2)], "id int, candidate string, k int")
    found = E.register_decision(a.unionByName(spark.createDataFrame([(5000, "x", 2), (5001, "x", 3), (5002, None, 1), (5003, "x", None)], "ref long, name string, k int")), b, ["k"], "ref", "name", "candidate", F.lit(True))
    assert joined_rows(found) <= 4100
    got = {r.ref: (r.n, r.score, r.decision) for r in found.collect()}
    assert got[1] == (2000, 1.0, "skip") and got[0] == (1, round(13 / 15, 6), "review") and got[1000] == (1, 1.0, "auto")
    assert got[5000] == (1, None, "review") and got[5001] == (0, None, "none") == got[5003] and got[5002] == (1, None, "review") and len(got) == 2004


def test_sections_in_blocks(spark, tmp_path):
    """Wherever blocks end, lines keep their section; what only looks like a heading is a line; a row is a line."""
    path, sections, want = f"{tmp_path}/report.csv", [], Counter()
    for k, n in enumerate((300, 0, 1, 40)):
        sections += ["", f"## S{k}", "## header" if k == 3 else "header"]
        body = ["", "x"] if k == 1 else [f"{'## ' if i % 5 == 3 else ''}line {i} \r" for i in range(n)]
        want.update((f"S{k}", x) for x in body if x)
        sections += body
    open(path, "w", newline="").write("\n".join(["# T", *sections]) + "\n")
    for size in (37, 64, 1 << 20):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        try:
            found = reports.read_sections(spark, path)
            assert Counter(map(tuple, found.collect())) == want, size
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()  # no section is one value


def test_pages_in_blocks(spark, tmp_path):
    """Many pages are few files and partitions, filters skip blocks and pages, and the driver has one entry for each block."""
    path, columns = str(tmp_path / "pages"), ["id", "kind"]
    rows = spark.range(6000).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("k"), F.floor(F.col("id") / 3000).cast("string"))).alias("kind"))
    paged.write_pages(rows, path, F.floor(F.col("id") / 2), columns, ["kind"])
    every = paged.read_pages(spark, path, columns)
    assert every.count() == 6000 == every.distinct().count() and every.rdd.getNumPartitions() < 20 and len(list((tmp_path / "pages").iterdir())) < 40
    assert every.where("kind = 'k1'").count() == sum(i % 7 > 0 for i in range(3000, 6000)) and every.where("kind = 'z'").count() == 0


def test_industry_is_judged_once(spark):
    df = spark.createDataFrame([("construction and building of food processing plants",), ("x",), (None,)], "t string").select(text.industry(F.col("t")).alias("i"))
    plan = df.select("i.industry", "i.confidence", "i.needs_review", "i.alternatives")
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("food.*processing") == 1
    assert sorted(map(str, plan.collect())) == sorted(map(str, df.select("i.*").collect()))
    assert [tuple(r) for r in plan.collect()] == [("Construction", 1.0, False, ["Manufacturing"]), (None, None, True, None), (None, None, True, None)]


def test_parsed_once(spark):
    df = spark.createDataFrame([(i, ["Safety Act 1974, Section 2(1)", "Fine: £5", None][i % 3]) for i in range(9)], "id int, t string")
    once = grammar.parsed_once(df, {"b": ("t", grammar.breach), "c": ("t", grammar.components)})
    assert sorted(map(str, once.collect())) == sorted(map(str, df.withColumns({"b": grammar.breach(F.col("t")), "c": grammar.components(F.col("t"))}).collect()))
    assert "Aggregate" in once._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_cut_once(spark):
    texts = ["Pat Example, 45, of Hull. At Hull Crown Court, contrary to Sections 2(1) and 3 and 4 of the Safety Act 1974 and Regulation 5, fined £1,200", "Section 2 and", "9", "", None]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    parses = {"d": grammar.defendant, "court": grammar.court, "p": grammar.components, "o": grammar.citations, "s": grammar.sentence}
    one = df.select("t", grammar.together(F.col("t"), parses).alias("x")).select("t", "x.*")
    each = df.select("t", *[f(F.col("t")).alias(n) for n, f in parses.items()])
    assert one._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 2 and sorted(map(str, one.collect())) == sorted(map(str, each.collect()))
    assert [x["section"] for x in one.collect()[0].o] == ["Section 2(1) and 3 and 4", "Regulation 5"]


def test_elements_are_scanned_in_batches(spark):
    page = "<body><h2>A <b>b</b></h2><br>x<table><tr><td>1<td>x<table><tr><td>in</td></tr></table>y</td></tr></table>z<p>open"
    df = spark.createDataFrame([(i, page if i % 3 else None) for i in range(30)], "id int, html string")
    found = markup.elements(df, "html", ["id"])
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.tag, r.text) for r in found.where("page_id = 1").collect()}
    assert got == {("body", "A b x 1 x in y z open"), ("h2", "A b"), ("b", "b"), ("br", ""), ("table", "1 x in y"), ("tr", "1 x in y"), ("td", "1"), ("td", "x in y"), ("table", "in"), ("tr", "in"), ("td", "in"), ("p", "open")}
    assert found.count() == 20 * found.where("page_id = 1").count()


def test_feed_files_are_bounded(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(stateful, "BATCH_MESSAGES", 10)
    monkeypatch.setattr(stateful, "shared_path", lambda s, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(stateful.feed, "run_buffered", lambda *a, **k: None)
    stateful.st03_buffered_feed(spark, "/root/testdata/sf0.001")
    sizes = [pq.ParquetFile(f).metadata.num_rows for f in (tmp_path / "messages").glob("*.parquet")]
    assert max(sizes) <= 10 and sum(sizes) == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_usage_in_parts_by_size(spark):
    df = spark.range(1000)
    assert R.parts_by_size(df, each=100) == 80 and R.parts_by_size(df) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = QUERIES["a43_legislation_usage"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "distinct" not in plan and plan.count("Exchange hashpartitioning(case_id") == 2  # no second deal of all rows
