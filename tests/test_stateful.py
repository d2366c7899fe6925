"""Versioned tables, the metric store, sync in phases, buffered feeds, nested markup and traversal."""

import random

import pytest
from pyspark.sql import functions as F

from sparkwarden.operators import traversal
from sparkwarden.operators.metric_store import MetricStore
from sparkwarden.operators.registry import Registry, numbered_densely
from sparkwarden.plans.versioned import Conflict, VersionedTable, retried
from sparkwarden.sources import markup, paged, reports
from sparkwarden.streaming import feed
from sparkwarden.streaming.log import EventLog


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t", "x int", "part")
    rows = lambda *r: spark.createDataFrame(list(r), "x int, part int")
    assert t.version() == 0 and t.read().count() == 0
    t.replace(rows((1, 1), (2, 2)), [1, 2])
    seen = t.read(1)
    assert t.replace(rows((3, 2)), [2, 3]) == 2
    assert sorted(map(tuple, seen.collect())) == [(1, 1), (2, 2)]  # a reader keeps its version
    assert sorted(map(tuple, t.read().collect())) == [(1, 1), (3, 2)]
    assert t.folders(1)[1] == t.folders(2)[1] and t.folders(1)[2] != t.folders(2)[2]  # what is not touched is shared
    with pytest.raises(ValueError):
        t.replace(rows((9, 9)), [1])
    with pytest.raises(Conflict):
        t._publish(2, {})
    tries = []

    def attempt():
        tries.append(1)
        if len(tries) < 3:
            raise Conflict
        return t.replace(spark.createDataFrame([], "x int, part int"), [1])

    assert retried(attempt) == 3 and sorted(map(tuple, t.read().collect())) == [(3, 2)]


def test_metric_store(spark, tmp_path):
    rng = random.Random(2)
    schema = "record_type string, action_date string, agency_id int, offender_id long, fine decimal(18,2), costs decimal(18,2)"
    rows = [(rng.choice(["case", "notice"]), rng.choice(["2024-05-03", "2024-05-28", "2024-05-31", "2023-12-31", "2020-01-01", None]), rng.choice([1, 2, None]), rng.randrange(5), None, None) for _ in range(200)]
    facts = spark.createDataFrame(rows, schema).withColumn("action_date", F.to_date("action_date"))
    store, periods = MetricStore(spark, f"{tmp_path}/m"), {"week": 7, "year": 365}
    whole = lambda: {(r.period, r.agency_id, r.is_total): (r.cases, r.notices, r.offenders) for r in store.metrics(periods).collect()}
    store.refresh(facts.where("action_date < '2024-05-30'"))
    months = store.changed_months(spark.createDataFrame([("2024-05-31",), (None,)], "day string").withColumn("day", F.to_date("day")))
    assert months == [2024 * 12 + 4]
    before = store.table.folders()
    store.refresh(facts, months)
    assert sum(before[m] != f for m, f in store.table.folders().items()) == 1
    want = {}
    for name, days in periods.items():
        near = [r for r in rows if r[1] and (days == 365 and r[1] > "2023-05" or r[1] > "2024-05-20")]
        for key, total in [*((a, False) for a in {r[2] for r in near}), (None, True)]:
            own = [r for r in near if total or r[2] == key]
            n = sum(r[0] == "case" for r in own)
            want[name, key, total] = (n, len(own) - n, len({r[3] for r in own}))
    assert whole() == want


def messages(n=600, seed=1):
    rng = random.Random(seed)
    return [(rng.randrange(40), seq, float(seq) if rng.random() < 0.9 else None, "delete" if rng.random() < 0.2 else "update", f"2024-01-{1 + seq * 28 // n:02d}") for seq in range(n)]


def newest(rows):
    last = {}
    for r in rows:
        last[r[0]] = r
    return sorted((k, r[1], r[2]) for k, r in last.items() if r[3] != "delete")


SCHEMA = "id long, seq long, value double, operation string, day string"


def test_two_phases_in_any_order(spark, tmp_path):
    rows = messages()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("day", F.to_date("day"))
    ranges = [("2024-01-08", "2024-01-15"), ("2024-01-01", "2024-01-08")]
    for i, order in enumerate(["rblb", "lrbb", "bbrl", "blbr"]):
        path = f"{tmp_path}/{i}"
        for step in order:  # every step in a process of its own
            table = feed.LatestTable(spark, path, "id bigint, seq bigint, value double", "id")
            sync = feed.TwoPhaseSync(table, df.where("seq < 550"), "day", "2024-01-15", ranges)
            if step == "r":
                sync.recent()
                sync.recent()
            elif step == "l":
                sync.live(df.where("seq >= 550"), "x")
                sync.live(df.where("seq >= 550"), "x")
            else:
                sync.backfill(1)
        assert sync.backfill() and sorted(map(tuple, table.read().collect())) == newest(rows)
        assert table.loads() == {"none", "recent", "live-x", *(f"history-{a}-{b}" for a, b in ranges)}
    # A load that broke off has no success mark and is done again.
    other = feed.LatestTable(spark, f"{tmp_path}/broken", "id bigint, seq bigint, value double", "id")
    sync = feed.TwoPhaseSync(other, df, "day", "2024-01-15", ranges)
    sync.recent()
    import os

    os.remove(f"{tmp_path}/broken/load=recent/_SUCCESS")
    assert "recent" not in other.loads()
    sync.recent()
    sync.backfill()
    assert sorted(map(tuple, other.read().collect())) == newest(rows)


def test_buffers(spark, tmp_path):
    rows = [r[:4] for r in messages()]
    df = spark.createDataFrame(rows, "id long, seq long, value double, operation string")
    for k in range(4):
        df.where(f"seq div 150 = {k}").coalesce(1).write.parquet(f"{tmp_path}/in/p{k}")
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    columns = ["id", "seq", "value", "operation"]
    table = feed.LatestTable(spark, f"{tmp_path}/state", "id bigint, seq bigint, value double", "id")
    seen = []
    load = table.load
    table.load = lambda rows, name: (seen.extend(map(tuple, rows.collect())), load(rows, name))
    args = dict(size=20, idle_ms=400, buffers=3)
    feed.run_buffered(stream(), table, columns, f"{tmp_path}/progress", batches=2, **args)  # stopped between batches
    assert len({r[1] for r in seen}) < len(rows)
    feed.run_buffered(stream(), table, columns, f"{tmp_path}/progress", **args)
    assert sorted(map(tuple, table.read().collect())) == newest(rows)
    flushes = {}
    for *_, seq, _, _, buffer, flush, place in [(r[0], r[1], r[2], r[3], r[4], r[5], r[6]) for r in seen]:
        flushes.setdefault((buffer, flush), {})[place] = seq
    assert sorted(s for f in flushes.values() for s in f.values()) == list(range(len(rows)))  # each once
    assert max(map(len, flushes.values())) == 20 and all(list(f) == sorted(f) and [f[k] for k in sorted(f)] == sorted(f.values()) for f in flushes.values())


def test_markup(spark):
    page = "<body><h2>A</h2><table><tr><th>n<th>v</tr><tr><td>1<td>x<table><tr><td>in</td></tr></table>y</td></tr></table><h2>B</h2><h3>b</h3><ul><li>p<li>q<ul><li>r</ul></ul><p>one<p>two<br>three<script>var t='<p>';</script></body>"
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "plain"), (5, "</b><p>open")], "id int, html string")
    found = markup.elements(df, "html", ["id"]).cache()
    assert {r.page_id for r in found.collect()} == {1, 5}
    paths = {(r.path, r.own) for r in found.where("page_id = 1").collect()}
    assert {("body/ul/li", "p"), ("body/ul/li", "q"), ("body/ul/li/ul/li", "r"), ("body/p", "one"), ("body/p", "two three"), ("body/p/script", "")} <= paths
    cells = sorted((r.table, r["row"], r.cell, r.own, r.text) for r in markup.table_cells(found, ["id"]).collect())
    outer, inner = cells[0][0], cells[-1][0]
    assert cells == [(outer, 1, 1, "n", "n"), (outer, 1, 2, "v", "v"), (outer, 2, 1, "1", "1"), (outer, 2, 2, "x y", "x in y"), (inner, 1, 1, "in", "in")]
    heads = markup.under_headings(found, ["id"], ["h2", "h3"], F.col("tag").isin("table", "ul")).collect()
    assert [(r.tag, r.h2, r.h3) for r in sorted(heads, key=lambda r: r.place)] == [("table", "A", None), ("table", "A", None), ("ul", "B", "b"), ("ul", "B", "b")]
    spark.udtf.register("elements", markup.Elements)
    df.createOrReplaceTempView("some_pages")
    assert spark.sql("SELECT count(*) FROM some_pages, LATERAL elements(html) WHERE tag = 'li'").first()[0] == 3


def test_traversal(spark):
    links = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 6), (6, 6), (None, 1), (4, None), (2, 3)]
    df = spark.createDataFrame(links, "page long, to long")
    start = spark.createDataFrame([(1,), (1,), (9,), (None,)], "page long")
    assert sorted(map(tuple, traversal.reachable(df, start).collect())) == [(1, 0), (2, 1), (3, 2), (4, 3), (9, 0)]
    assert sorted(map(tuple, traversal.reachable(df, start, 1).collect())) == [(1, 0), (2, 1), (9, 0)]
    assert traversal.reachable(df, start.limit(0)).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(50)], "page long, to long")
    got = traversal.families(chain.unionByName(df.where("page > 4").selectExpr("page + 100 as page", "to + 100 as to")), spark.createDataFrame([(25,), (106,), (999,)], "page long")).collect()
    assert sorted(map(tuple, got)) == [(25, i) for i in range(51)] + [(106, 105), (106, 106), (999, 999)]


def test_log_as_of(spark, tmp_path):
    rows = [(r[0], r[2], r[1], r[3]) for r in messages(300)]
    df = spark.createDataFrame(rows, "id long, value double, version long, operation string")
    log = EventLog(spark, f"{tmp_path}/log", "id bigint, value double", "id", segment=50)
    assert log.as_of(10).count() == 0
    for low, high in ((0, 120), (100, 200), (200, 300)):  # one stretch is appended twice
        log.append(df.where(f"version >= {low} and version < {high}"))
    for v in (149, 249, 149):
        log.snapshot(v)
    assert log.snapshots() == [149, 249]
    for v in (0, 60, 148, 149, 150, 260, 299, 1000):
        want = newest([(i, version, value, op) for i, value, version, op in rows if version <= v])
        assert sorted((r.id, r.version, r.value) for r in log.as_of(v).collect()) == want
    # What is read is the snapshot and the segments behind it.
    plan = log.as_of(260)._jdf.queryExecution().executedPlan().toString()
    pruned = [x.split("]")[0] for x in plan.split("PartitionFilters: [")[1:]]
    assert len(pruned) == 2 and any("segment#" in x and ">= 5" in x and "<= 5" in x for x in pruned)
    assert {r[0] for r in log.tail(249, 260).select(F.expr("version div 50")).distinct().collect()} == {5}


def test_registry(spark, tmp_path):
    schema = "ref string, name string, postcode string"
    one = spark.createDataFrame([("a", "Acme Ltd", "AB1"), ("b", "ACME LIMITED", " ab1 "), ("c", "Acme Ltd", None), ("d", " ", "X"), ("e", None, None), ("f", "Beta", "B1")], schema)
    two = spark.createDataFrame([("g", "acme ltd.", "AB1"), ("h", "Gamma", None), ("i", "Beta", "B1"), ("j", "Acme Ltdd", "AB1")], schema)
    r = Registry(spark, f"{tmp_path}/r")
    inner = []
    first = r.find_or_create(one, similar=False, before_publish=lambda: inner or inner.append(r.find_or_create(two, similar=False)))
    ids = {x.ref: (x.offender_id, x.created) for x in [*first.collect(), *inner[0].collect()]}
    rows = r.rows().collect()
    assert len({(x.key, x.postcode) for x in rows}) == len(rows) == 5 == len({x.id for x in rows})
    assert ids["a"][0] == ids["b"][0] == ids["g"][0] != ids["c"][0] and ids["f"][0] == ids["i"][0]
    assert ids["d"] == ids["e"] == (None, False) and not ids["a"][1] and ids["g"][1] and ids["c"][1]
    again = r.find_or_create(one)
    assert {x.ref: x.offender_id for x in again.collect()} == {k: v[0] for k, v in ids.items() if k in "abcdef"} and r.rows().count() == 5
    near = r.find_or_create(spark.createDataFrame([("k", "Gamma Ltd", None), ("l", "Betaa", "B1")], schema))
    assert {x.ref: (x.offender_id, x.created) for x in near.collect()}["l"] == (ids["f"][0], False)
    dense = numbered_densely(spark.range(100).withColumn("k", F.col("id") * 7 % 100).drop("id"), ["k"], 5)
    assert sorted((x.k, x.id) for x in dense.collect()) == [(k, k + 5) for k in range(100)]


def test_sectioned_report(spark, tmp_path):
    rows = spark.range(500).select("id", F.format_string("line %03d", 499 - F.col("id")).alias("line"))
    path = f"{tmp_path}/report.csv"
    reports.write_report(spark, [("One", "h1", rows, ["line"]), ("Two", "h2", rows.limit(0), ["line"]), ("Three", "h3", rows.where("id > 497").withColumn("line", reports.quoted(F.lit('a "b"'))), ["id"])], path, "T")
    want = ["# T", "", "## One", "h1", *[f"line {k:03d}" for k in range(500)], "", "## Two", "h2", "", "## Three", "h3", '"a ""b"""', '"a ""b"""']
    assert open(path).read().splitlines() == want
    assert sorted(p.name for p in tmp_path.iterdir()) == ["report.csv"]
    assert spark.createDataFrame([], "x int").count() == 0 and {r.section: r.n for r in reports.read_sections(spark, path).groupBy("section").agg(F.count("*").alias("n")).collect()} == {"One": 500, "Three": 2}
    bad = rows.withColumn("line", F.when(F.col("id") == 250, F.raise_error(F.lit("broken"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="broken"):
        reports.write_report(spark, [("One", "h1", bad.repartition(4), ["id"])], f"{tmp_path}/bad.csv", "T")
    assert not (tmp_path / "bad.csv").exists()


def test_paged_source(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"n{i}", "ab"[i // 50] if i % 7 else None) for i in range(100)], "id int, name string, kind string")
    columns, path = ["id", "name", "kind"], str(tmp_path / "pages")
    paged.write_pages(rows, path, F.col("id") / 10, columns, ["kind"])
    every = paged.read_pages(spark, path, columns)
    assert every.count() == 100 and every.rdd.getNumPartitions() == 10
    some = every.where("kind = 'a' and name like '%3'")
    assert sorted(r.id for r in some.collect()) == sorted(str(i) for i in range(50) if i % 7 and i % 10 == 3)
    assert some.rdd.getNumPartitions() == 5
    assert every.where("kind in ('b', 'z')").where("kind = 'z'").count() == 0
    assert sorted(r.id for r in every.where("kind is null").collect()) == sorted(str(i) for i in range(0, 100, 7))
