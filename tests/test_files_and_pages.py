import json
from datetime import date

from pyspark.sql import functions as F

from marketweave.operators import extract as X
from marketweave.operators import modelling as M
from marketweave.operators import reports as P
from marketweave.operators import selection as S
from marketweave.plans import pipelines
from marketweave.sources import files as IO


def test_rate_file(spark, tmp_path):
    (tmp_path / "r.csv").write_text("NO;Tanggal;Kurs JISDOR\n1;02/09/2021;15.100\n\n2;01/09/2021;15.000\n")
    got = IO.read_rates(spark, str(tmp_path / "r.csv")).collect()
    assert [(r.tanggal, r.kurs) for r in got] == [("02/09/2021", "15.100"), ("01/09/2021", "15.000")]
    assert IO.find_column(["No", " Harga RATE "], ["kurs", "rate"]) == " Harga RATE " and IO.find_column(["a"], ["b"]) is None


def test_shards(spark, tmp_path):
    good = {"url": "u1", "title": "a b"}
    (tmp_path / "a.jsonl").write_text(json.dumps(good, ensure_ascii=False) + "\n\n{bad\n", encoding="utf-8")
    rows = IO.read_shards(spark, str(tmp_path)).collect()
    assert sum(r._bad is not None for r in rows) == 1 and any(r.title == "a b" for r in rows)
    audit = IO.shard_audit(spark, str(tmp_path)).first()
    assert (audit.lines, audit.bad_lines) == (2, 1)


def test_csv_and_split(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"\nc'), (2, None)], "i int, t string")
    IO.write_csv(df, str(tmp_path / "c"))
    assert {r.t for r in IO.read_csv(spark, str(tmp_path / "c")).collect()} == {'a,"b"\nc', None}
    try:
        IO.write_csv(df, str(tmp_path / "c"), overwrite=False)
        raise AssertionError("overwrote")
    except Exception as e:
        assert "exists" in str(e).lower()
    IO.split_write(df, F.col("t").startswith("a"), str(tmp_path / "k"), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "k")).count() == spark.read.parquet(str(tmp_path / "r")).count() == 1


PAGE = """<html><head><title>x</title><meta property="og:title" content="Meta title"><meta name="article:section" content="Oil">
<script type="application/ld+json">{broken</script>
<script type="application/ld+json">[{"@type": "NewsArticle", "headline": "Linked", "author": [{"name": "A"}, {"name": "B"}], "datePublished": "2022-01-01T00:00:00Z"}]</script></head>
<body><article><p>One <b>bold</b></p><p>Two</p><p>Three</p></article></body></html>"""


def test_pages():
    f = X.page_fields(PAGE)
    assert (f["title"], f["author"], f["section"], f["body"]) == ("Linked", "A, B", "Oil", "One bold Two Three")
    assert X.page_fields(PAGE.replace("<p>Three</p>", ""))["body"] is None
    assert X.page_fields(None)["title"] is None and X.page_fields("<p>open")["body"] is None
    assert X.page_fields('<meta property="og:title" content="M">')["title"] == "M"


def test_archive_links(spark):
    html = """<a href="/2022/01/02/some-slug-here.html"> A title that is long </a><a href="/2022/01/02/some-slug-here.html">Another long title</a>
    <a href="https://a.example/2022/01/03/other.html">Long enough title</a><a href="/2022/01/02/x.html">short</a><a href="/about">About this website</a>"""
    pages = spark.createDataFrame([("p", date(2022, 1, 2), html)], "page_id string, date date, html string")
    loose = X.archive_links(pages, "https://a.example", "a.example").collect()
    assert {(r.title, r.url) for r in loose} == {("A title that is long", "https://a.example/2022/01/02/some-slug-here.html"), ("Long enough title", "https://a.example/2022/01/03/other.html")}
    assert X.archive_links(pages, "https://a.example", "a.example", strict=True).count() == 1


def test_sample_and_reports(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 700, "a").when(F.col("id") < 990, "b").alias("s"))
    got = {r.s: r["count"] for r in S.stratified_sample(df, F.col("s"), "id", 100).groupBy("s").count().collect()}
    assert got == {"a": 70, "b": 29}
    f = P.funnel(df, [("has s", F.col("s").isNotNull()), ("a", F.col("s") == "a")]).orderBy("step").collect()
    assert [(r.rows, r.pct) for r in f] == [(1000, None), (990, -1.0), (700, -29.3)]
    assert S.stratified_sample(df.limit(0), F.col("s"), "id", 10).count() == 0


def test_model(spark):
    rows = [(i, "up" if i % 2 else "down", ("oil price rises today" if i % 2 else "war fears grow again") + f" w{i % 7}") for i in range(80)]
    df = spark.createDataFrame(rows, "i int, y string, t string")
    w = M.TermWeights(min_docs=2).fit(df, "t")
    assert "oil price" in w.vocabulary and "a" not in w.vocabulary
    x = M.balanced(w.transform(df).withColumn("k", (F.col("y") == "up").cast("double")), "y")
    model = M.fit_classifier(x, "k", max_iter=20)
    p = model.transform(x).select("y", F.when(F.col("prediction") == 1, "up").otherwise("down").alias("p"))
    m = {r.label: r for r in M.class_measures(p, "y", "p").collect()}
    assert m["accuracy"].f1 == 1.0 and m["macro avg"].support == 80
    never = spark.createDataFrame([("a", "b"), ("b", "b")], "a string, p string")
    m = {r.label: (r.precision, r.recall, r.f1, r.support) for r in M.class_measures(never, "a", "p").collect()}
    assert m["a"] == (0.0, 0.0, 0.0, 1) and m["b"] == (0.5, 1.0, 2 / 3, 1)
    assert {r.actual: (r.a, r.b) for r in M.confusion(never, "a", "p", ["a", "b"]).collect()} == {"a": (0, 1), "b": (0, 1)}
    assert M.top_terms(model, w.vocabulary, ["down", "up"], 3)[0][:2] == ("down", 1)


def test_pipelines(spark):
    base = dict(published="2021-09-02T20:00:00+0000", modified=None, description="d", body="Some body text that is long.", author=None, index_date="2021-09-02", title_score=1, matched_terms="war")
    rows = [dict(base, seq=1, url=" u1", title="Trade war and tariffs", section="Oil"), dict(base, seq=2, url="u1", title="Other war sanctions", section="Oil"),
            dict(base, seq=3, url="u2", title="Trade war, and tariffs!", section="Oil"), dict(base, seq=4, url="u3", title="Sanctions war", section="Pro: x"),
            dict(base, seq=5, url="u4", title="Sanctions bite", section=None, published="junk"), dict(base, seq=6, url="u5", title="Embargo on celebrity oil", section="Oil"),
            dict(base, seq=7, url="u6", title="Embargo stays in place today", section="Oil", body=None)]
    schema = "seq long, url string, title string, published string, modified string, description string, body string, author string, section string, index_date string, title_score long, matched_terms string"
    records = S.merged_records(spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema))
    features = pipelines.news_features(records)
    assert {r.url for r in features.collect()} == {"u1", "u6"}
    rates = spark.createDataFrame([("2021-09-03", 1.0, 1), ("2021-09-06", 2.0, 3)], "date string, kurs double, gap_days long").withColumn("date", F.col("date").cast("date"))
    daily = {r.date.day: r for r in pipelines.daily_table(features, rates).collect()}
    assert daily[3].n_news == 2 and daily[6].n_news == 0 and daily[6].text_norm_concat == "" and daily[6].mean_relevance is None and daily[6].window_hours == 72.0
    t = {r.url: r for r in pipelines.transformer_news(records, rates).collect()}
    assert t["u6"].used_description_fallback and t["u4"].target_date is None and t["u1"].date == "2021-09-03 03:00:00 AM WIB"


def test_stream(spark, tmp_path):
    from marketweave.streaming.ingest import article_stream, land

    (tmp_path / "in").mkdir()
    lines = [{"url": "a", "index_date": "2022-01-02"}, {"url": "a", "index_date": "2022-01-02"}, {"url": "b", "index_date": "2022-02-02"}]
    (tmp_path / "in" / "x.jsonl").write_text("\n".join(map(json.dumps, lines)))
    land(article_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
