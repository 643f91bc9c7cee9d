"""Reports: rates, realised shares, timelines, probes, ordered positions, look-ups, scales."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeworks.functions.text import normalized
from noticeworks.operators import matching, ranking, reports, sweep, vectors
from noticeworks.plans.feed_queries import _CATS, _LATEST, AS_OF, ORACLE as _FEED_SQL, _category_rows, latest_ads, position_matches
from noticeworks.storage import table

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


_OPEN = f"""v AS (SELECT coalesce(institution_id, 'none') AS institution_id, coalesce(number_of_posts, 1) AS posts, closing_date IS NULL OR closing_date >= DATE '{AS_OF}' AS open FROM ads)"""


@query(f"""WITH {_LATEST}, {_OPEN} SELECT CASE WHEN grouping(institution_id) = 1 THEN 'all' ELSE institution_id END AS institution_id, CAST(sum(posts) AS BIGINT) AS posts, CAST(coalesce(sum(posts) FILTER (open), 0) AS BIGINT) AS open_posts,
round(coalesce(sum(posts) FILTER (open), 0) * 100.0 / sum(posts), 4) AS open_rate FROM v GROUP BY ROLLUP (institution_id)""")
def open_rates(spark: SparkSession, root: str) -> DataFrame:
    """Posts and open posts of each institution and of all."""
    ads = latest_ads(spark, root, "institution_id", "number_of_posts", "closing_date")
    is_open = F.col("closing_date").isNull() | (F.col("closing_date") >= F.lit(AS_OF))
    v = ads.select(F.coalesce("institution_id", F.lit("none")).alias("institution_id"), F.coalesce("number_of_posts", F.lit(1)).cast("long").alias("posts"), is_open.alias("open"))
    sums = v.rollup("institution_id").agg(F.sum("posts").alias("posts"), F.coalesce(F.sum(F.when(F.col("open"), F.col("posts"))), F.lit(0)).alias("open_posts"), F.grouping("institution_id").alias("g"))
    return sums.select(F.when(F.col("g") == 1, "all").otherwise(F.col("institution_id")).alias("institution_id"), "posts", "open_posts", F.round(F.col("open_posts") * 100.0 / F.col("posts"), 4).alias("open_rate"))


_TARGET = " ".join(f"WHEN '{c}' THEN {t}" for c, t in reports.MANDATE.items())
_REAL = f"{_CATS}, s AS (SELECT category, CAST(sum(posts) AS BIGINT) AS posts, CAST(CASE category {_TARGET} END AS DOUBLE) AS target FROM cats WHERE category <> 'pwbd' GROUP BY 1), t AS (SELECT sum(posts) AS a FROM s)"


@query(f"WITH {_REAL} SELECT category, posts, round(target * a / 100, 3) AS expected, round(target * a / 100 - posts, 3) AS shortfall, round(least(110, posts * 10000.0 / a / target), 3) AS realised, posts * 10000.0 / a / target < 95 AS under FROM s, t")
def realised_shares(spark: SparkSession, root: str) -> DataFrame:
    """Posts of each category against those that the mandate gives, the realised share clipped at 110."""
    gap = reports.mandate_gap(_category_rows(spark, root))
    total = gap.agg(F.sum("posts").alias("a"))  # one row
    a = total.first().a or 0
    exact = F.col("posts") * 10000.0 / F.lit(max(1, a)) / F.col("target")
    expected = F.col("target") * a / 100
    return gap.select("category", "posts", F.round(expected, 3).alias("expected"), F.round(expected - F.col("posts"), 3).alias("shortfall"), F.round(F.least(F.lit(110.0), exact), 3).alias("realised"), (exact < 95).alias("under"))


@query("""SELECT count(*) AS n, count(*) FILTER (fetch_status = 'downloaded') AS n_downloaded, count(*) FILTER (fetch_status = 'error') AS n_errors, count(*) FILTER (coalesce(url, '') = '') AS n_no_url, count(*) FILTER (byte_count IS NOT NULL AND byte_count > 0) AS n_sized,
count(*) FILTER (len(ad_refs) > 1) AS n_shared FROM pdf_manifest""")
def probe_summary(spark: SparkSession, root: str) -> DataFrame:
    m, status = table(spark, root, "pdf_manifest"), F.col("fetch_status")
    return m.agg(
        F.count("*").alias("n"), F.count_if(status == "downloaded").alias("n_downloaded"), F.count_if(status == "error").alias("n_errors"), F.count_if(F.coalesce("url", F.lit("")) == "").alias("n_no_url"), F.count_if(F.col("byte_count") > 0).alias("n_sized"), F.count_if(F.size("ad_refs") > 1).alias("n_shared")
    )


_COVER = """cover AS (SELECT i.id AS institution_id, i.inst_type, coalesce(c.n, 0) AS ads_found,
CASE WHEN coalesce(c.n, 0) > 0 THEN 'ok' WHEN i.career_page_url_guess IS NULL OR i.career_page_url_guess = '' THEN 'no-url' ELSE 'empty' END AS status
FROM institutions i LEFT JOIN (SELECT institution_id, count(DISTINCT id) AS n FROM job_ads WHERE institution_id IS NOT NULL GROUP BY 1) c ON i.id = c.institution_id)"""


@query(f"WITH {_COVER} SELECT count(*) AS attempted, count(*) FILTER (status = 'ok') AS succeeded, count(*) FILTER (ads_found > 0) AS with_ads, CAST(coalesce(sum(ads_found), 0) AS BIGINT) AS ads_total FROM cover WHERE inst_type = 'Technical'")
def target_coverage(spark: SparkSession, root: str) -> DataFrame:
    """The summary of a run over some sources."""
    return sweep.coverage_summary(sweep.coverage(table(spark, root, "institutions").where("inst_type = 'Technical'"), table(spark, root, "job_ads")))


@query("""WITH l AS (SELECT source, doc_id, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS line FROM documents WHERE text IS NOT NULL),
m AS (SELECT source, doc_id, CASE WHEN regexp_matches(lower(line), '\\bspecial drive\\b') THEN 'drive' WHEN regexp_matches(lower(line), '\\bcontinuous process\\b') THEN 'process' WHEN regexp_matches(lower(line), '\\bvacant\\b') THEN 'vacant' END AS kind FROM l)
SELECT source, kind, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM m WHERE kind IS NOT NULL GROUP BY ALL""")
def matching_lines(spark: SparkSession, root: str) -> DataFrame:
    lines = table(spark, root, "documents").where("text is not null").select("source", "doc_id", F.explode(F.split("text", r"\r\n|\r|\n")).alias("line"))
    low = F.lower("line")
    kind = F.when(low.rlike(r"\bspecial drive\b"), "drive").when(low.rlike(r"\bcontinuous process\b"), "process").when(low.rlike(r"\bvacant\b"), "vacant")
    return lines.select("source", "doc_id", kind.alias("kind")).where("kind is not null").groupBy("source", "kind").agg(F.count("*").alias("n_lines"), F.count_distinct("doc_id").alias("n_docs"))


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT label, list(m ORDER BY pos) AS centre FROM (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT e.label, vec_id, list_cosine_similarity(v, centre) AS similarity FROM e JOIN c ON e.label = c.label), n AS (SELECT label, count(*) AS size FROM e GROUP BY 1)
SELECT label, vec_id, rank, size FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(similarity, 9) DESC, vec_id) AS rank FROM s) JOIN n USING (label) WHERE rank <= 8""")
def cluster_titles(spark: SparkSession, root: str) -> DataFrame:
    """The eight vectors most like the centre of each label, with the label's size."""
    v = table(spark, root, "embeddings")
    means = vectors.centroids(v, "label")
    # A label's centre is one array of the vectors' length.
    centre = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda x: x["mean"]).alias("centre"), F.max("n").alias("size"))
    scored = v.join(centre, "label").select("label", "size", "vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("centre")), 9).alias("s"))
    return ranking.best_of_large(scored, ["label"], [F.col("s").desc(), F.col("vec_id")], 8, "vec_id", "rank").select("label", "vec_id", "rank", "size")


@query("""WITH p AS (SELECT DISTINCT ON (position_id) * FROM extracted_positions)
SELECT pdf_filename, position_id, row_number() OVER (PARTITION BY pdf_filename ORDER BY -CAST(floor(coalesce(extraction_confidence, 0) * 100) AS INT), -coalesce(len(areas), 0), -length(coalesce(raw_section_text, '')), position_id) AS place FROM p""")
def ordered_positions(spark: SparkSession, root: str) -> DataFrame:
    """The positions of each file, the surest and richest first."""
    p = table(spark, root, "extracted_positions").select("pdf_filename", "position_id", F.floor(F.coalesce("extraction_confidence", F.lit(0.0)) * 100).cast("int").alias("c"), F.coalesce(F.when(F.col("areas").isNotNull(), F.size("areas")), F.lit(0)).alias("a"), F.length(F.coalesce("raw_section_text", F.lit(""))).alias("r")).dropDuplicates(["position_id"])
    w = Window.partitionBy("pdf_filename").orderBy(F.col("c").desc(), F.col("a").desc(), F.col("r").desc(), "position_id")
    return p.select("pdf_filename", "position_id", F.row_number().over(w).alias("place"))


def _fold(x: str) -> str:
    return f"trim(regexp_replace(replace(lower(coalesce({x}, '')), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH {_LATEST}, n AS (SELECT {_fold('canonical_name')} AS k, min(ref_id) AS ref_id FROM canonical_names GROUP BY 1), h AS (SELECT replace(k, ' ', '') AS k, min(ref_id) AS ref_id FROM n GROUP BY 1),
c AS (SELECT id, unnest([{{'p': 0, 'k': {_fold('discipline')}}}, {{'p': 1, 'k': {_fold('department')}}}, {{'p': 2, 'k': {_fold('title')}}}], recursive := true) FROM ads),
f AS (SELECT c.id, p, n.ref_id FROM c JOIN n ON c.k = n.k WHERE c.k <> '' UNION ALL SELECT c.id, p + 3, h.ref_id FROM c JOIN h ON replace(c.k, ' ', '') = h.k WHERE c.k <> '')
SELECT id, CAST(min_by(ref_id, p * 1000000 + ref_id) AS INT) AS ref_id FROM f GROUP BY id""")
def section_lookup(spark: SparkSession, root: str) -> DataFrame:
    """Each ad's entry by discipline, department, then title: equal words first, then regardless of hyphens and blanks."""
    names = table(spark, root, "canonical_names").select(normalized(F.col("canonical_name"), ascii_only=True).alias("k"), "ref_id")
    exact = names.groupBy("k").agg(F.min("ref_id").alias("ref_id"))
    tight = exact.groupBy(F.replace("k", F.lit(" "), F.lit("")).alias("k")).agg(F.min("ref_id").alias("ref_id"))
    both = exact.select(F.concat(F.lit("e "), "k").alias("k"), "ref_id").unionByName(tight.select(F.concat(F.lit("t "), "k").alias("k"), "ref_id"))
    keys = [normalized(F.col(c), ascii_only=True) for c in ("discipline", "department", "title")]
    some = lambda kind, k: F.when(k != "", F.concat(F.lit(kind), k))
    tried = [some("e ", k) for k in keys] + [some("t ", F.replace(k, F.lit(" "), F.lit(""))) for k in keys]
    return matching.prioritised_lookup(latest_ads(spark, root, "title", "department", "discipline"), tried, both, "k", "ref_id")


@query(f"WITH m AS ({_FEED_SQL['position_matches']}) SELECT count(*) AS n_pairs, count(DISTINCT filename) AS n_files, count(DISTINCT ad_id) AS n_ads, count(DISTINCT position_id) AS n_positions FROM m")
def attached_counts(spark: SparkSession, root: str) -> DataFrame:
    return position_matches(spark, root).agg(F.count("*").alias("n_pairs"), F.count_distinct("filename").alias("n_files"), F.count_distinct("ad_id").alias("n_ads"), F.count_distinct("position_id").alias("n_positions"))


@query("""WITH m AS (SELECT filename, max_by(fetch_status, coalesce(url, '')) AS fetch_status FROM pdf_manifest GROUP BY 1), p AS (SELECT DISTINCT ON (position_id) position_id, pdf_filename FROM extracted_positions)
SELECT coalesce(fetch_status, 'none') AS fetch_status, count(*) AS n_positions, count(DISTINCT pdf_filename) AS n_files FROM p LEFT JOIN m ON p.pdf_filename = m.filename GROUP BY 1""")
def positions_by_fetch(spark: SparkSession, root: str) -> DataFrame:
    """Positions with the last state of their file."""
    m = table(spark, root, "pdf_manifest").groupBy(F.col("filename").alias("pdf_filename")).agg(F.max_by("fetch_status", F.coalesce("url", F.lit(""))).alias("fetch_status"))
    p = table(spark, root, "extracted_positions").select("position_id", "pdf_filename").dropDuplicates(["position_id"])
    return p.join(m, "pdf_filename", "left").groupBy(F.coalesce("fetch_status", F.lit("none")).alias("fetch_status")).agg(F.count("*").alias("n_positions"), F.count_distinct("pdf_filename").alias("n_files"))


@query(f"""WITH {_LATEST}, n AS (SELECT i.inst_type, count(*) AS n FROM ads a JOIN institutions i ON a.institution_id = i.id GROUP BY 1) SELECT inst_type, n, round(n * 1.0 / (SELECT n FROM n WHERE inst_type = 'Technical'), 6) AS ratio FROM n""")
def type_ratios(spark: SparkSession, root: str) -> DataFrame:
    inst = table(spark, root, "institutions").select(F.col("id").alias("institution_id"), "inst_type")
    n = latest_ads(spark, root, "institution_id").join(inst, "institution_id").groupBy("inst_type").agg(F.count("*").alias("n"))
    return reports.ratio_to(n, "inst_type", "n", "Technical")


@query("""WITH s AS (SELECT inst_type, median(established) AS middle, min(established) AS low, max(established) AS high, quantile_cont(established, 0.25) AS quarter FROM institutions WHERE established IS NOT NULL GROUP BY 1), a AS (SELECT min(established) AS lo, max(established) AS hi FROM institutions)
SELECT inst_type, CAST(middle AS DOUBLE) AS middle, CAST(quarter AS DOUBLE) AS quarter, round((low - lo) * 1.0 / (hi - lo), 6) AS low, round((high - lo) * 1.0 / (hi - lo), 6) AS high FROM s, a""")
def scaled_years(spark: SparkSession, root: str) -> DataFrame:
    """Median and quarter of a value by group, and its range scaled to the range of all; one row for each registered source comes in."""
    inst = table(spark, root, "institutions").where("established is not null")
    ends = inst.agg(F.min("established").alias("lo"), F.max("established").alias("hi")).first()
    scaled = lambda c: F.round((c - ends.lo) / max(1, (ends.hi or 0) - (ends.lo or 0)), 6)
    return inst.groupBy("inst_type").agg(F.percentile("established", 0.5).alias("middle"), F.percentile("established", 0.25).alias("quarter"), scaled(F.min("established")).alias("low"), scaled(F.max("established")).alias("high"))


@query("""SELECT count(*) FILTER (NOT list_contains(string_split(local_path, '/'), 'archive')) AS n_kept, count(*) FILTER (list_contains(string_split(local_path, '/'), 'corpus')) AS n_corpus, count(*) FILTER (regexp_matches(coalesce(url, ''), '(?i)recruit|career|files')) AS n_worded FROM pdf_manifest""")
def path_filters(spark: SparkSession, root: str) -> DataFrame:
    parts = F.split("local_path", "/")
    return table(spark, root, "pdf_manifest").agg(F.count_if(~F.array_contains(parts, "archive")).alias("n_kept"), F.count_if(F.array_contains(parts, "corpus")).alias("n_corpus"), F.count_if(F.coalesce("url", F.lit("")).rlike("(?i)recruit|career|files")).alias("n_worded"))


@query("SELECT year, count(*) AS n FROM (SELECT substr(CAST(publication_date AS VARCHAR), 1, 4) AS year FROM job_ads) WHERE year >= '2020' GROUP BY year")
def years_as_text(spark: SparkSession, root: str) -> DataFrame:
    """Years compared as text, so that '0000' and '' stay out."""
    return table(spark, root, "job_ads").select(F.substring(F.col("publication_date").cast("string"), 1, 4).alias("year")).where("year >= '2020'").groupBy("year").agg(F.count("*").alias("n"))


@query(f"""SELECT original_url, max(snapshot_fetched_at) AS snapshot_fetched_at, max(snapshot_fetched_at) < TIMESTAMP '{AS_OF} 00:00:00' - INTERVAL 720 HOURS AS stale FROM job_ads WHERE original_url IS NOT NULL AND parse_confidence >= 0.5 GROUP BY 1""")
def stale_addresses(spark: SparkSession, root: str) -> DataFrame:
    log = table(spark, root, "job_ads").where("original_url is not null")
    return sweep.fresh_or_stale(log, "original_url", "snapshot_fetched_at", F.col("parse_confidence") >= 0.5, F.lit(f"{AS_OF} 00:00:00").cast("timestamp_ntz"), 720)


@query("SELECT filename FROM pdf_manifest WHERE filename NOT IN (SELECT pdf_filename FROM extracted_positions WHERE pdf_filename IS NOT NULL)")
def files_to_read(spark: SparkSession, root: str) -> DataFrame:
    """The files that no position was read from yet."""
    done = table(spark, root, "extracted_positions").select(F.col("pdf_filename").alias("filename"))
    return sweep.not_done(table(spark, root, "pdf_manifest").select("filename"), done, ["filename"])


@query(f"""WITH {_LATEST}, s AS (SELECT state, count(*) AS n, count(DISTINCT a.institution_id) AS n_inst FROM ads a JOIN institutions i ON a.institution_id = i.id GROUP BY state) SELECT row_number() OVER (ORDER BY n DESC, state) AS place, state, n, n_inst FROM s WHERE state IS NOT NULL""")
def states_ranked(spark: SparkSession, root: str) -> DataFrame:
    inst = table(spark, root, "institutions").select(F.col("id").alias("institution_id"), "state")
    n = latest_ads(spark, root, "institution_id").join(inst, "institution_id").where("state is not null").groupBy("state").agg(F.count("*").alias("n"), F.count_distinct("institution_id").alias("n_inst"))
    return ranking.top_rows(n, [F.col("n").desc(), F.col("state")], 1000).select(F.col("rank").alias("place"), "state", "n", "n_inst")


@query("SELECT id, row_number() OVER (ORDER BY lower(inst_name), id) AS place FROM institutions")
def names_in_order(spark: SparkSession, root: str) -> DataFrame:
    """Sources in the order of a dictionary: case does not count."""
    inst = table(spark, root, "institutions").select("id", F.collate("inst_name", "UNICODE_CI").alias("name"))
    return ranking.top_rows(inst, [F.col("name"), F.col("id")], 100_000).select("id", F.col("rank").alias("place"))
