"""Nulls in any column, empty and long texts, repeated rows, clashing column names."""

from sparkwarden.llm import bpe, common, exact_dedup, near_dedup, quality, token_files, url_filter
import public_tokenizers as P


def test_exact_and_index(spark, monkeypatch):
    rows = [(3, "a b\tc"), (1, "abc"), (2, "a bc"), (4, None), (5, ""), (6, " \n"), (7, "x" * 200000), (7, "x" * 200000), (None, "abc"), (8, "z")]
    df = spark.createDataFrame([(i, t, 0, False) for i, t in rows], "doc_id long, text string, keep_id int, kept boolean").repartition(3)
    index = exact_dedup.DigestIndex(spark, buckets=3)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(df, index).collect()), key=str)
    # null, "" and white space are equal texts; of them the longest, " \n", stays; "a b\tc" is the longest of its four
    assert got == sorted([(3, 3, 4, True), (1, 3, 4, False), (2, 3, 4, False), (4, 6, 3, False), (5, 6, 3, False), (6, 6, 3, True), (7, 7, 2, True), (7, 7, 2, True), (None, 3, 4, False), (8, 8, 1, True)], key=str)
    more = spark.createDataFrame([(20, "z z"), (21, "z"), (22, "new")], "doc_id long, text string")
    second = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.deduplicate(more, index).collect()}
    assert second == {20: (20, True), 21: (8, False), 22: (22, True)}
    assert index.rows().count() == 6
    # a batch that is run again finds its own rows; compaction leaves one file a bucket and the same answers
    third = spark.createDataFrame([(30, "n e w"), (31, "newer"), (32, "newer "), (33, "z")], "doc_id long, text string")
    answers = []
    files = lambda i: len([f for f in i.rows().inputFiles() if spark.read.parquet(f).count()])
    for n in range(3):
        i = index.compacted() if n == 2 else index
        before = files(i)
        answers.append(sorted(map(tuple, exact_dedup.deduplicate(third, i, batch="third").collect())))
    assert answers[0] == answers[1] == answers[2] and [(a[0], a[1], a[3]) for a in answers[0]] == [(30, 22, False), (31, 32, False), (32, 32, True), (33, 8, False)]
    assert before == files(i) <= 3 < files(index) and sorted(map(str, i.rows().collect())) == sorted(map(str, index.rows().collect()))
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(df).collect()), key=str) == got
    kept = exact_dedup.keep_first(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 6, 7, 8]
    assert exact_dedup.deduplicate(df.limit(0)).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/x?y", "https://example.org/en/12#f", "https://org/", "https://org", "https://xorg/", "http://a.com/de/", "http://a.com:80/de/", "x://y.net/casino/1", "https://spam.a.com/fr/1", "http://b.net/Spam", "a://b://c.com/fr/", "http://a.com?u=http://b.com/de/x", "http://x.net#://example.org/es/", "http://a.com/fr/?u=http://b.com/de/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(0, None, "h"), (None, urls[3], "h")], "page_id int, url string, host string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()]
    one = {r[0]: r[1:] for r in got}
    assert len(got) == 19
    assert one[0] == one[1] == one[2] == ("", "", None, "allow")
    assert one[3] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert one[4] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert one[5] == ("org", "/", "org/", "allow") and one[6] == ("org", "", None, "allow") and one[7][2] is None
    assert one[8][2:] == ("com/de/", "block") and one[9] == ("a.com:80", "/de/", None, "allow")
    assert one[10][2:] == (None, "block") and one[11][2:] == ("com/fr/", "allow") and one[12][2:] == (None, "allow")
    assert one[13] == ("b:", "//c.com/fr/", None, "allow")
    assert one[14] == ("a.com", "", None, "allow") and one[15] == ("x.net", "", None, "allow") and one[16][1:] == ("/fr/", "com/fr/", "allow")
    assert url_filter.judge(df.limit(0)).count() == 0
    rules = spark.createDataFrame([("a.com/", "block", "^a[.]com/", ["a", "com"], 1)], "name string, verdict string, pattern string, tokens array<string>, rank int")
    assert {r.page_id for r in url_filter.judge(df, rules).where("verdict = 'block'").collect()} == {8, 16}
    long = spark.createDataFrame([(1, "http://a.com/" + "de/" * 100000), (2, "http://" + "x" * 200000)], "page_id int, url string")
    assert sorted((r.page_id, r.rule, len(r.path)) for r in url_filter.judge(long).collect()) == [(1, "com/de/", 300001), (2, None, 0)]


def test_hot_url(spark, monkeypatch):
    df = spark.createDataFrame([(i, "http://a.com/de/" if i % 2 else None if i % 3 else f"http://b.org/{i}") for i in range(60)], "page_id int, url string")
    want = sorted(map(str, url_filter.judge(df).collect()))
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    assert sorted(map(str, url_filter.judge(df).collect())) == want
    monkeypatch.setattr(common, "HOT_KEYS", 0)
    assert sorted(map(str, url_filter.judge(df).collect())) == want


def test_tokens(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "hi there", 1), (None, "hi there", 1)], "doc_id long, text string, n_tokens int")
    out = bpe.encode_documents(df, P.path("byte_bpe_multi_50k.tiktoken"))
    assert sorted(r.n_tokens for r in out.collect())[:2] == [0, 0] and out.count() == 4
    assert bpe.encode_documents(df.limit(0), P.path("byte_bpe_multi_50k.tiktoken")).count() == 0


def test_keep_one(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(2, long), (1, long + " more"), (1, "other text"), (3, None), (4, None), (2, long)]
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, class_id long")
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, (r.text or "")[-4:]) for r in kept.collect()) == [(1, "more"), (1, "text"), (3, ""), (4, "")]


def test_quality_with_clashing_columns(spark):
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "BUY!!! $$$ ") * 20, 1.0, "x", "y", i) for i in range(40)] + [(None, None, None, None, None, None), (1, "good words here " * 20, 1.0, "x", "y", 1)], "doc_id long, text string, score double, _text string, _scored string, _label int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted([*range(1, 40, 2), 1])
    model = quality.train(docs, labels, common.F.lit(True))
    scored = quality.score(docs, model)
    assert sorted(scored.columns) == sorted([*docs.columns, "n_passages", "focus"]) and scored.count() == 42
    assert quality.score(docs.limit(0), model).count() == 0 == quality.keep_good(docs.limit(0), labels).count()


def test_tokens_of_any_id(spark, tmp_path):
    df = spark.createDataFrame([("b", "x y", 1, 2), ("a", None, 1, 2), (None, "z", 1, 2)], "doc_id string, text string, start int, _id int")
    got = token_files.read_documents(token_files.write_token_files(df, P.path("byte_bpe_50k.json"), str(tmp_path))).collect()
    assert [(r.doc_id, r.n_tokens) for r in sorted(got, key=lambda r: r.start)] == [(None, 2), ("a", 1), ("b", 3)]
