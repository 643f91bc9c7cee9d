"""Sources and sinks over the tables: what is written is read back, pages made of rows give the rows again, logs are judged."""

from __future__ import annotations

import io
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.functions.text import escape_html
from noticeworks.functions.urls import registered_domain
from noticeworks.operators import layout
from noticeworks.sources import feeds, fetch, files, html
from noticeworks.storage import remember, shared_folder, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query, with its SQL if SQL can state it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return remember(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")


_FEED = "id, institution_id, title, department, closing_date, number_of_posts, parse_confidence, raw_text_excerpt"


@query(f"SELECT {_FEED} FROM job_ads")
def feed_lines(spark: SparkSession, root: str) -> DataFrame:
    """The feed as JSON lines, read back with its schema."""
    path, columns = _folder(spark, "feed"), _FEED.split(", ")
    files.write_lines(table(spark, root, "job_ads").select(*columns), path)
    return files.read_or_empty(spark, path, files.AD_SCHEMA).select(*columns)


@query("SELECT CAST(snapshot_date AS VARCHAR) AS day, count(*) AS n, count(DISTINCT id) AS n_ads FROM ad_snapshots GROUP BY 1")
def feed_by_day(spark: SparkSession, root: str) -> DataFrame:
    """The feed as a table by day; a second delivery of a day replaces that day only."""
    path, rows = _folder(spark, "days"), table(spark, root, "ad_snapshots")
    files.write_feed(rows, path)
    last = rows.agg(F.max("snapshot_date")).first()[0]
    files.write_feed(rows.where(F.col("snapshot_date") == last), path)
    return spark.read.parquet(path).groupBy(F.col("snapshot_date").cast("string").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ads"))


def _page(*parts: Column | str) -> Column:
    return F.concat(F.lit("<html><head><title>Jobs</title></head><body>"), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("</body></html>"))


def _ads(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "job_ads").where("id is not null and original_url is not null and trim(title) <> ''").select("id", "original_url", "title", "ad_number", "department").distinct()


_BLANK = r"[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+"


def _tidy(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_BLANK}', ' ', 'g'))"


_FROM = "(SELECT DISTINCT id, original_url, title, ad_number, department FROM job_ads WHERE id IS NOT NULL AND original_url IS NOT NULL AND trim(title) <> '')"


@query(f"SELECT id, original_url AS url, left({_tidy('title')}, 250) AS text, regexp_matches(split_part(lower(original_url), '?', 1), '\\.pdf$') AS is_pdf FROM {_FROM}")
def page_links(spark: SparkSession, root: str) -> DataFrame:
    """Links of pages: the address and text of each, navigation and repeated addresses left out."""
    spark.udtf.register("noticeworks_links", html.PageLinks)
    link = F.concat(F.lit("<a href='"), escape_html(F.col("original_url")), F.lit("'>"), escape_html(F.col("title")), F.lit("</a>"))
    pages = _ads(spark, root).select("id", _page("<a href='#top'>Top</a><a href='javascript:void(0)'>Menu</a><p>", link, "</p>", link).alias("page"))
    return spark.sql("SELECT p.id, l.url, l.text, l.is_pdf FROM {pages} p, LATERAL noticeworks_links(p.page, 'https://x.example/') l", pages=pages)


@query(f"SELECT id, coalesce({_tidy('ad_number')}, '') AS ad_number, {_tidy('title')} AS title, original_url AS url FROM {_FROM} WHERE length({_tidy('title')}) >= 5")
def page_tables(spark: SparkSession, root: str) -> DataFrame:
    """Rows of tables by the role of their cells, heads left out."""
    cell = lambda c: F.concat(F.lit("<td>"), escape_html(F.coalesce(c, F.lit(""))), F.lit("</td>"))
    row = F.concat(F.lit("<table><tr><th>No.</th><th>Post</th><th>File</th></tr><tr>"), cell(F.col("ad_number")), cell(F.col("title")), F.lit("<td><a href='"), escape_html(F.col("original_url")), F.lit("'>view</a></td></tr></table>"))
    pages = _ads(spark, root).select(F.col("id").alias("url"), F.lit(None).cast("timestamp").alias("fetched_at"), _page(row).alias("html"))
    return html.table_ads(pages, {"ad_number": 0, "title": 1}).select(F.col("page_url").alias("id"), "ad_number", "title", "url")


@query(f"SELECT id, original_url AS url, left(trim({_tidy('title')} || ' ' || coalesce({_tidy('department')}, '')), 500) AS text FROM {_FROM}")
def page_items(spark: SparkSession, root: str) -> DataFrame:
    """List items that hold a link."""
    spark.udtf.register("noticeworks_items", html.PageItems)
    item = F.concat(F.lit("<ul><li>no link here</li><li><a href='"), escape_html(F.col("original_url")), F.lit("'>"), escape_html(F.col("title")), F.lit("</a> "), escape_html(F.coalesce("department", F.lit(""))), F.lit("</li></ul>"))
    pages = _ads(spark, root).select("id", _page(item).alias("page"))
    return spark.sql("SELECT p.id, l.url, l.text FROM {pages} p, LATERAL noticeworks_items(p.page, 'https://x.example/') l", pages=pages)


@query(f"SELECT id, {_tidy('title')} AS post, coalesce({_tidy('ad_number')}, '') AS number FROM {_FROM}")
def labelled_tables(spark: SparkSession, root: str) -> DataFrame:
    """Pages with one table of labels and values for each post."""
    spark.udtf.register("noticeworks_labelled", html.LabelledTables)
    line = lambda label, c: F.concat(F.lit(f"<tr><th>{label}:</th><td>"), escape_html(F.coalesce(c, F.lit(""))), F.lit("</td></tr>"))
    body = F.concat(F.lit("<table>"), line("Name of Post", F.col("title")), line("Advt No", F.col("ad_number")), line("Name of post", F.lit("again")), F.lit("</table>"))
    pages = _ads(spark, root).select("id", _page(body).alias("page"))
    return spark.sql("SELECT p.id, l.fields['name of post'] AS post, l.fields['advt no'] AS number FROM {pages} p, LATERAL noticeworks_labelled(p.page) l", pages=pages)


@query("SELECT id, inst_name, established FROM institutions")
def registry_sheet(spark: SparkSession, root: str) -> DataFrame:
    """The registry as a spreadsheet, read back; a registry is one sheet by definition."""
    book = io.BytesIO()
    files.export_sheet(table(spark, root, "institutions").select("id", "inst_name", "established"), book)
    head, *rows = files.read_sheet(book)
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{c} string" for c in head)).withColumn("established", F.col("established").cast("int"))


@query(f"SELECT id, original_url AS url, {_tidy('title')} AS heading FROM {_FROM}")
def headed_links(spark: SparkSession, root: str) -> DataFrame:
    """Links with the heading before them, looked for among their ancestors' siblings."""
    spark.udtf.register("noticeworks_headed", html.HeadedLinks)
    body = F.concat(F.lit("<div><h3>"), escape_html(F.col("title")), F.lit("</h3></div><div><p><span><a href='"), escape_html(F.col("original_url")), F.lit("'>Apply</a></span></p></div>"))
    pages = _ads(spark, root).select("id", _page(body).alias("page"))
    return spark.sql("SELECT p.id, l.url, l.heading FROM {pages} p, LATERAL noticeworks_headed(p.page, 'https://x.example/') l", pages=pages)


@query(f"SELECT doc_id, count(*) AS n_lines FROM (SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS line FROM documents WHERE text IS NOT NULL) WHERE {_tidy('line')} <> '' GROUP BY doc_id")
def page_lines(spark: SparkSession, root: str) -> DataFrame:
    """The text of a page by lines, scripts left out."""
    spark.udtf.register("noticeworks_text", html.PageText)
    body = F.concat(F.lit("<p>"), F.regexp_replace(escape_html(F.col("text")), r"\r\n|\r|\n", "</p><p>"), F.lit("</p><script>var x = 1;</script>"))
    pages = table(spark, root, "documents").where("text is not null").select("doc_id", F.concat(F.lit("<html><body>"), body, F.lit("</body></html>")).alias("page"))
    lines = spark.sql("SELECT p.doc_id, l.text FROM {pages} p, LATERAL noticeworks_text(p.page) l", pages=pages)
    return lines.where("text <> ''").select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


@query("""SELECT id, substr(sha256('portal' || chr(0) || id || chr(0) || coalesce(ad_number, '') || chr(0) || coalesce(institution_id, '') || chr(0)), 1, 16) AS portal_id, title, ad_number, number_of_posts, closing_date FROM job_ads WHERE id IS NOT NULL AND institution_id IS NOT NULL""")
def portal_feed(spark: SparkSession, root: str) -> DataFrame:
    """A portal's JSON answers, one for each row, read into ads."""
    rows = table(spark, root, "job_ads").where("id is not null and institution_id is not null")
    one = F.struct(F.col("institution_id").alias("institution"), "id", F.col("ad_number").alias("postNo"), F.col("title").alias("post"), F.col("number_of_posts").cast("string").alias("totalVacancies"), F.col("closing_date").cast("string").alias("closeDate"))
    pages = rows.select(F.col("id").alias("url"), F.col("snapshot_fetched_at").alias("fetched_at"), F.to_json(F.struct(F.array(one).alias("data"))).alias("body"))
    ads = feeds.portal_ads(pages)
    return ads.select(F.col("original_url").alias("id"), F.col("id").alias("portal_id"), "title", "ad_number", "number_of_posts", "closing_date")


_DOMAIN = "regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)"


@query(f"""SELECT doc_id, round(gap, 3) AS gap FROM (SELECT doc_id, (epoch_us(fetched_at) - epoch_us(lag(fetched_at) OVER (PARTITION BY source ORDER BY fetched_at, doc_id))) / 1e6 AS gap FROM documents WHERE fetched_at IS NOT NULL) WHERE gap < 3600""")
def requests_too_fast(spark: SparkSession, root: str) -> DataFrame:
    """Requests that came to a source sooner than an hour after the one before."""
    log = table(spark, root, "documents").where("fetched_at is not null").select("doc_id", F.col("source").alias("domain"), "fetched_at")
    return feeds.too_fast(log, 3600, order="doc_id").select("doc_id", F.round("gap", 3).alias("gap"))


@query("""SELECT url, status, stale FROM (SELECT original_url AS url, CASE WHEN parse_confidence >= 0.5 THEN 'ok' ELSE 'error' END AS status, snapshot_fetched_at < TIMESTAMP '2026-01-15 00:00:00' - INTERVAL 4380 HOURS AND coalesce(parse_confidence >= 0.5, false) AS stale,
row_number() OVER (PARTITION BY original_url ORDER BY CASE WHEN parse_confidence >= 0.5 AND snapshot_fetched_at >= TIMESTAMP '2026-01-15 00:00:00' - INTERVAL 4380 HOURS THEN 0 WHEN parse_confidence >= 0.5 THEN 1 ELSE 2 END, snapshot_fetched_at DESC) AS n FROM job_ads WHERE original_url IS NOT NULL) WHERE n = 1""")
def cached_answers(spark: SparkSession, root: str) -> DataFrame:
    """The answer to use for each address: a fresh good one, a stale good one, a failure."""
    ok = F.coalesce(F.col("parse_confidence") >= 0.5, F.lit(False))
    log = table(spark, root, "job_ads").where("original_url is not null").select(F.col("original_url").alias("url"), F.when(ok, "ok").otherwise("error").alias("status"), F.col("snapshot_fetched_at").alias("fetched_at"))
    return feeds.cached(log, F.lit("2026-01-15 00:00:00").cast("timestamp"), 4380).select("url", "status", "stale")


@query("SELECT count(*) AS n FROM job_ads WHERE trim(coalesce(id, '')) <> '' AND trim(coalesce(institution_id, '')) <> '' AND trim(coalesce(title, '')) <> ''")
def usable_overrides(spark: SparkSession, root: str) -> DataFrame:
    return files.valid_overrides(table(spark, root, "job_ads")).agg(F.count("*").alias("n"))


@query("SELECT regexp_extract(filename, '([^/]+)$', 1) AS basename, min(filename) AS filename FROM pdf_manifest GROUP BY 1")
def unique_files(spark: SparkSession, root: str) -> DataFrame:
    return files.unique_files(table(spark, root, "pdf_manifest").select("filename", "fetch_status"), "filename", "filename").select("basename", "filename")


@query("SELECT sha256(text) AS sha256, min(url) AS path FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0) GROUP BY 1")
def new_contents(spark: SparkSession, root: str) -> DataFrame:
    """Contents that a known half of the documents does not hold."""
    docs = table(spark, root, "documents").where("text is not null").select(F.sha2("text", 256).alias("sha256"), F.col("url").alias("path"), "doc_id")
    return files.new_files(docs, docs.where("doc_id % 2 = 0")).select("sha256", "path")


@query(f"SELECT domain, count(*) AS n FROM (SELECT CASE WHEN h = '' THEN '' WHEN len(string_split(h, '.')) <= 2 THEN h ELSE array_to_string(string_split(h, '.')[-2:], '.') END AS domain FROM (SELECT {_DOMAIN} AS h FROM documents)) GROUP BY domain")
def document_domains(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").groupBy(registered_domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS ls FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM l),
k AS (SELECT *, CASE WHEN trim(line) = '' THEN 'spacer' WHEN regexp_matches(line, '^\\s*(?:[A-Z][A-Z &,/-]{6,}|(?:annexure|schedule|section|part)\\s+[-–]?\\s*[A-Z0-9]{1,4}\\b.*)\\s*:?\\s*$') THEN 'header' WHEN regexp_matches(line, '(?i)^\\s*(?:[-•*▪●]\\s+|\\(?[a-z0-9]{1,3}[.)]\\s+)') THEN 'list' ELSE 'paragraph' END AS kind FROM u),
s AS (SELECT *, sum(CASE WHEN kind = 'header' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM k WHERE kind <> 'spacer')
SELECT doc_id, CAST(section AS BIGINT) AS section, count(*) AS n FROM s GROUP BY ALL""")
def section_sizes(spark: SparkSession, root: str) -> DataFrame:
    """The lines of each section of a document: a section starts at a header."""
    rows = layout.text_lines(table(spark, root, "documents"))
    return layout.section_lines(rows).groupBy("doc_id", "section").agg(F.count("*").alias("n"))


def _answers() -> fetch.Client:
    """A client whose answers follow from the length of the address: good, missing, overloaded, and silent at the first try."""
    tried: dict[str, int] = {}

    def answer(url: str) -> tuple[int, str]:
        tried[url] = tried.get(url, 0) + 1
        kind = len(url) % 4
        if kind == 3 and tried[url] == 1:
            raise TimeoutError
        return {0: 200, 1: 404, 2: 503, 3: 200}[kind], "x"

    return answer


@query("""SELECT status, code, attempts, count(*) AS n, CAST(sum(CASE attempts WHEN 2 THEN 2 WHEN 3 THEN 6 ELSE 0 END) AS DOUBLE) AS waited FROM (
SELECT CASE WHEN blocked THEN 'robots-blocked' WHEN k IN (1, 2) THEN 'http-error' ELSE 'ok' END AS status, CASE WHEN blocked THEN NULL WHEN k = 1 THEN 404 WHEN k = 2 THEN 503 ELSE 200 END AS code, CASE WHEN blocked THEN 0 WHEN k = 2 THEN 3 WHEN k = 3 THEN 2 ELSE 1 END AS attempts
FROM (SELECT DISTINCT url, length(url) % 4 AS k, regexp_matches(url, '^https?://[^/]+/files/1') AS blocked FROM pdf_manifest WHERE url IS NOT NULL)) GROUP BY status, code, attempts""")
def fetch_outcomes(spark: SparkSession, root: str) -> DataFrame:
    """The files of the manifest read by policy from a client with set answers."""
    urls = table(spark, root, "pdf_manifest").select("url", registered_domain(F.col("url")).alias("domain"))
    robots = urls.select("domain").distinct().withColumn("rules", F.lit("User-agent: *\nDisallow: /files/1"))
    rows = fetch.fetched(urls, _answers, fetch.Policy(interval=0.0), robots=robots, sleep=lambda _: None)
    return rows.groupBy("status", "code", "attempts").agg(F.count("*").alias("n"), F.sum("waited").alias("waited"))
