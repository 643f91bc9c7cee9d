import datetime as dt
import json

from pyspark.sql import functions as F

from noticeworks.sources import feeds, files, html, pdf
from noticeworks.streaming import events

PAGE = """<html><head><title> Jobs &amp;
 more</title><script>var a = '<a href="x.pdf">no</a>';</script></head><body>
<a href="#top">Top</a><a href="javascript:void(0)">Menu</a><a href="/home">Home</a>
<ul><li>Advt. No. ABC/12/2026 <a href="/recruitment/advt1.pdf">Recruitment of Lecturers</a><li><a href="/recruitment/advt1.pdf">again</a><li>plain</ul>
<table><tr><th>No</th><th>Title</th><th>Date</th></tr><tr><td>A/1</td><td>Professor of Law</td><td>01.02.2026</td><td><a href="l.pdf">pdf</a></td></tr><tr><td>x</td><td>y</td></tr></table>
<p>Physics: needs teachers of optics. Law: needs none.</p></body></html>"""


def pages(spark, *bodies):
    return spark.createDataFrame([(f"https://u.example/p{i}", b, dt.datetime(2026, 1, 1)) for i, b in enumerate(bodies)], "url string, html string, fetched_at timestamp")


def test_links_tables_items(spark):
    p = pages(spark, PAGE, "", "   ", "<", ">", None, "<body><table><tr><td>open")
    ads = html.link_ads(p).collect()
    assert [(r.url, r.title, r.ad_number, r.is_pdf) for r in ads] == [("https://u.example/recruitment/advt1.pdf", "Recruitment of Lecturers", "ABC/12/2026", True)]
    rows = html.table_ads(p, {"ad_number": 0, "title": 1, "closing": 2}).collect()
    assert [(r.ad_number, r.title, r.closing, r.url) for r in rows] == [("A/1", "Professor of Law", "01.02.2026", "https://u.example/l.pdf")]
    p.createOrReplaceTempView("noticeworks_pages")
    spark.udtf.register("items", html.PageItems)
    assert len(spark.sql("SELECT i.* FROM noticeworks_pages p, LATERAL items(p.html, p.url) i").collect()) == 2
    spark.udtf.register("blocks", html.UnitBlocks)
    got = spark.sql("SELECT b.unit, b.body FROM noticeworks_pages p, LATERAL blocks(p.html, array('Physics', 'Law')) b WHERE p.url LIKE '%p0'").collect()
    assert ("Law", "needs none.") in [tuple(r) for r in got]
    assert p.select(html.page_title(F.col("html"))).first()[0] == "Jobs &amp; more"
    spark.udtf.register("page_text", html.PageText)
    assert spark.sql("SELECT t.title FROM noticeworks_pages p, LATERAL page_text(p.html) t WHERE p.url LIKE '%p0'").first()[0] == "Jobs & more"


def test_parser_dispatch(spark):
    df = spark.createDataFrame([("tables",), ("new",), (None,)], "p string")
    assert [r[0] for r in df.select(html.parser_for(F.col("p"), ["tables"])).collect()] == ["tables", "generic", "generic"]


def test_portal_feed(spark):
    body = json.dumps({"data": [{"institution": "Royal College", "id": "", "postNo": "7", "post": "Lecturer", "totalVacancies": "3", "startDate": "01-02-2026", "closeDate": "bad"}, {"institution": "Known", "id": "1"}]})
    df = spark.createDataFrame([("u", body, None), ("v", "garbage", None)], "url string, body string, fetched_at timestamp")
    rows = feeds.portal_ads(df, {"Known": "known-inst"}).collect()
    assert [(r.institution_id, r.number_of_posts, r.publication_date, r.closing_date) for r in rows] == [("royal-college", 3, dt.date(2026, 2, 1), None), ("known-inst", None, None, None)]
    assert len({r.id for r in rows}) == 2


def test_fetch_log(spark):
    t = lambda h: dt.datetime(2026, 1, 1, h)
    log = spark.createDataFrame([("a", t(1), "ok"), ("a", t(9), "http-error"), ("b", t(8), "ok"), ("c", t(2), "network-error")], "url string, fetched_at timestamp, status string")
    got = {r.url: (r.status, r.stale) for r in feeds.cached(log, F.lit(t(10)), 6).collect()}
    assert got == {"a": ("ok", True), "b": ("ok", False), "c": ("network-error", False)}
    hits = spark.createDataFrame([("d", t(1)), ("d", t(1) + dt.timedelta(seconds=4)), ("e", t(1))], "domain string, fetched_at timestamp")
    assert feeds.too_fast(hits).count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "title": "x"}\nnot json\n{"id": "2"}\n')
    assert files.read_json(spark, str(tmp_path / "a.jsonl"), "id string, title string").count() == 2
    assert files.read_or_empty(spark, str(tmp_path / "none.jsonl"), "id string").count() == 0
    feed = {"generated_at": "2026-01-01T00:00:00Z", "ad_count": 1, "ads": [{"id": "1", "title": "t", "category_breakdown": {"ur": 1}, "unknown": 5}]}
    (tmp_path / "feed.json").write_text(json.dumps(feed))
    row = files.feed_rows(spark, str(tmp_path / "feed.json")).first()
    assert (row.id, row.category_breakdown.ur, row.seq) == ("1", 1, 0)
    ads = spark.createDataFrame([("1", "a", dt.date(2026, 1, 1)), ("2", "b", dt.date(2026, 1, 2))], "id string, title string, snapshot_date date")
    files.write_feed(ads, str(tmp_path / "t"))
    files.write_feed(ads.where("id = '2'").withColumn("title", F.lit("new")), str(tmp_path / "t"))
    assert {(r.id, r.title) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("1", "a"), ("2", "new")}
    assert files.export_feed(ads.drop("snapshot_date"), str(tmp_path / "out.json"), "now") == 2
    assert len(json.loads((tmp_path / "out.json").read_text())["ads"]) == 2
    up = files.upsert(ads.select("id", "title").withColumn("seq", F.lit(1)), spark.createDataFrame([("1", "z", 2)], "id string, title string, seq int"), "id", "seq")
    assert {(r.id, r.title) for r in up.collect()} == {("1", "z"), ("2", "b")}
    assert files.valid_overrides(spark.createDataFrame([("1", "i", "t"), ("2", "", "t"), (None, "i", "t")], "id string, institution_id string, title string")).count() == 1
    assert "| n |" in files.markdown_table(spark.createDataFrame([(1,)], "n int"), ["n"])
    f = spark.createDataFrame([("x/a.pdf", 2), ("y/a.pdf", 1)], "path string, seq int")
    assert files.unique_files(f, "path", "seq").first().path == "y/a.pdf"


def test_pdf_adapter(spark):
    df = spark.createDataFrame([("a", b"%PDF-1"), ("b", b"<html>"), ("c", None), ("d", b"%PDF-x")], "path string, content binary")

    def bad(content):
        raise ValueError

    got = {r.path: (r.text, r.status) for r in pdf.extracted(df, [bad, lambda c: "text" if c.endswith(b"1") else " "]).collect()}
    assert got == {"a": ("text", "ok"), "b": (None, "not-pdf"), "c": (None, "not-pdf"), "d": (None, "failed")}


def test_stream_equals_batch(spark, tmp_path):
    t = lambda d, h: dt.datetime(2026, 1, d, h)
    rows = [(t(1, 1), "a", 1.0), (t(1, 5), "a", 2.0), (t(2, 1), "b", 3.0)]
    schema = "ts timestamp, event_type string, value double"
    for k, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events.run_to_table(events.windowed(events.read_stream(spark, str(tmp_path / "in"), schema, 10)), "win", str(tmp_path / "cp")).stop()
    batch = events.windowed(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, spark.table("win").collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)


def test_sweep_stream_carries_forward(spark, tmp_path):
    schema = "id string, institution_id string"
    for k, rows in enumerate([[("1", "A"), ("2", "B")], [("3", "A")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events.sweep_stream(events.read_stream(spark, str(tmp_path / "in"), schema, 100), str(tmp_path / "state"), str(tmp_path / "cp"))
    assert {(r.id, r.carried) for r in spark.read.parquet(str(tmp_path / "state/v=1")).collect()} == {("3", False), ("2", True)}


def test_headings_and_fallback_chain(spark):
    p = pages(spark, "<h2>Chemistry</h2><div><p><a href='a.pdf'>Details</a></p></div><b>Physics</b><a href='b.pdf'>Details</a>", PAGE, "<a href='/recruitment/z'>Vacancy notice</a>")
    p.createOrReplaceTempView("noticeworks_heads")
    spark.udtf.register("headed", html.HeadedLinks)
    rows = spark.sql("SELECT h.heading FROM noticeworks_heads p, LATERAL headed(p.html, p.url) h WHERE p.url LIKE '%p0' ORDER BY h.seq").collect()
    assert [r.heading for r in rows] == ["Chemistry", "Physics"]
    both = html.first_that_finds(p, [lambda d: html.table_ads(d, {"ad_number": 0, "title": 1, "closing": 2}), html.link_ads])
    assert {(r.page_url[-2:], r.title) for r in both.collect()} == {("p1", "Professor of Law"), ("p2", "Vacancy notice")}


def test_release_deletes_what_was_spooled(spark):
    from noticeworks import storage

    storage.release(spark)
    df = storage.spool(spark.range(3))
    assert df.count() == 3 and storage.release(spark) == 1


def test_fetching_by_policy(spark):
    from noticeworks.sources import fetch

    rules = "User-agent: *\nDisallow: /private"
    assert fetch.allowed(None, "*", "https://a.example/private") and not fetch.allowed(rules, "*", "https://a.example/private/x") and fetch.allowed(rules, "*", "https://a.example/public")
    pauses, answers = [], iter([(503, ""), TimeoutError(), (200, "page")])

    def client(_):
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    got = fetch.fetch_one("u", client, fetch.Policy(), pauses.append)
    assert (got["status"], got["code"], got["body"], got["attempts"], got["waited"]) == ("ok", 200, "page", 3, 6.0) and pauses == [2.0, 4.0]
    assert fetch.fetch_one("u", lambda _: (404, ""), fetch.Policy(), pauses.append)["attempts"] == 1
    none = fetch.fetch_one("u", lambda _: 1 / 0, fetch.Policy(tries=2), lambda _: None)
    assert (none["status"], none["code"], none["attempts"]) == ("network-error", None, 2)
    log = spark.createDataFrame([("a", "ok", dt.datetime(2026, 1, 1, 10), "x"), ("b", "ok", dt.datetime(2025, 1, 1), "x"), ("c", "error", dt.datetime(2026, 1, 1, 10), None)], "url string, status string, fetched_at timestamp, body string")
    urls = spark.createDataFrame([(u, "d") for u in "abcd"] + [(None, "d"), ("e", None), ("d", "d")], "url string, domain string")
    todo = fetch.to_fetch(urls, log, F.lit("2026-01-01 12:00:00").cast("timestamp"), 6)
    assert {r.url for r in todo.where("url is not null and domain is not null").collect()} == {"b", "c", "d"}
    rows = fetch.fetched(todo, lambda: lambda u: (200, u), fetch.Policy(interval=0.0)).collect()
    assert sorted((r.url, r.status, r.body) for r in rows) == [("b", "ok", "b"), ("c", "ok", "c"), ("d", "ok", "d")]
    assert fetch.fetched(todo.limit(0), lambda: lambda u: (200, u)).count() == 0


def test_read_binary(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "b.txt").write_text("no")
    rows = files.read_binary(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], bytes(r.content), r.length) for r in rows] == [("a.pdf", b"%PDF-1.4", 8)]
