"""Queries over the feed: facets, sorts, classes, coverage, identity, matching, reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.functions import dates, fields, text, urls
from noticeworks.ids import stable_id, unique_ids
from noticeworks.operators import chunks, facets, layout, matching, ranking, reports, sweep, validation, vectors
from noticeworks.plans import banks
from noticeworks.rules import all_matches, first_match, phrase_counts, scoped_match
from noticeworks.storage import spread, table

AS_OF = date(2026, 1, 15)
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


def latest(rows: DataFrame, *columns: str) -> DataFrame:
    """(id, snapshot_fetched_at, columns): each id once, by its latest delivery.

    Only the columns asked for are shuffled, and only the time and a hash decide, so
    that no text is compared; derive flags before, and texts need not travel.
    """
    order = F.struct("snapshot_fetched_at", F.xxhash64(F.lit(0), *columns))
    kept = rows.where("id is not null").groupBy("id").agg(F.max_by(F.struct("snapshot_fetched_at", *columns), order).alias("r"))
    return kept.select("id", "r.*")


def latest_ads(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """Each ad once, by its latest delivery."""
    return latest(table(spark, root, "job_ads"), *columns)


_LATEST = "ads AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY snapshot_fetched_at DESC) AS rn FROM job_ads WHERE id IS NOT NULL) WHERE rn = 1)"


def enriched(spark: SparkSession, root: str, *columns: str, spec: facets.FilterSpec | None = None) -> DataFrame:
    """Ads with their institution and the classifier columns asked for.

    Every column is derived where the row is read; ``query_hit`` answers the query of
    ``spec``. What is not asked for is not even read.
    """
    inst = table(spark, root, "institutions").select(F.col("id").alias("institution_id"), "inst_name", "short_name", "inst_type", "state", "city")
    x = spread(table(spark, root, "job_ads")).join(inst, "institution_id", "left")
    core = F.lower(F.concat_ws(" | ", "title", "department", "discipline"))
    sp = F.col("structured_position")
    flags = facets.rank_flags(F.col("title"), sp["ranks"], F.col("post_type"))
    tags = all_matches(core, banks.FIELDS)
    x = x.withColumn("fields", F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("Other"))))
    x = x.withColumns({f"is_{k}": F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    relevance = F.when(F.exists("fields", lambda f: f.isin(*banks.HUMANITIES)), "hss").when(F.col("fields")[0] == "Other", "other").otherwise("non-hss")
    hay = text.haystack(*[F.col(c) for c in ("city", "state", "title", "department", "discipline", "inst_name", "short_name", "raw_text_excerpt", "pdf_excerpt")], sp["department"], sp["discipline"], F.concat_ws(" ", sp["areas"]))
    x = x.withColumns({"field": F.col("fields")[0], "relevance": relevance, "is_reserved": facets.reserved(F.col("category_breakdown"), F.concat_ws(" ", "title", "raw_text_excerpt"))})
    if spec and spec.query.strip():
        x = x.withColumn("query_hit", text.search_condition(text.normalized(hay, ascii_only=True), spec.query))
        columns = (*columns, "query_hit")
    return latest(x, *columns)


def _sql_fields(core: str) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches({core}, '(?i){r.pattern}') THEN '{r.label}' END" for r in banks.FIELDS)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


_HSS = ", ".join(f"'{f}'" for f in banks.HUMANITIES)
_ENRICHED = rf"""{_LATEST}, e0 AS (
  SELECT a.id, a.institution_id, a.title, a.post_type, a.closing_date, a.publication_date, a.category_breakdown AS cb, a.raw_text_excerpt, i.inst_name, i.inst_type, i.state, i.lat, i.lon, i.city,
         a.department, a.discipline, a.structured_position.ranks AS ranks, i.short_name, a.pdf_excerpt, a.structured_position.department AS sp_department, a.structured_position.discipline AS sp_discipline, a.structured_position.areas AS sp_areas, lower(concat_ws(' | ', a.title, a.department, a.discipline)) AS core
  FROM ads a LEFT JOIN institutions i ON a.institution_id = i.id
), e1 AS (
  SELECT *, {_sql_fields("core")} AS tags, lower(concat_ws(' | ', nullif(list_aggregate(coalesce(ranks, []), 'string_agg', ' | '), ''))) AS listed,
         lower(concat_ws(' ', title, nullif(list_aggregate(coalesce(ranks, []), 'string_agg', ' '), ''))) AS t, lower(coalesce(title, '')) AS head, coalesce(post_type, '') AS kind,
         trim(regexp_replace(replace(lower(concat_ws(' ', city, state, title, department, discipline, inst_name, short_name, raw_text_excerpt, pdf_excerpt, sp_department, sp_discipline, nullif(list_aggregate(coalesce(sp_areas, []), 'string_agg', ' '), ''))), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS folded
  FROM e0
), e AS (
  SELECT *, CASE WHEN len(tags) > 0 THEN tags ELSE ['Other'] END AS fields, CASE WHEN len(tags) > 0 THEN tags[1] ELSE 'Other' END AS field,
    CASE WHEN len(list_intersect(tags, [{_HSS}])) > 0 THEN 'hss' WHEN len(tags) = 0 THEN 'other' ELSE 'non-hss' END AS relevance,
    regexp_matches(t, '\bassistant\s+professor\b') OR (kind = 'Faculty' AND NOT regexp_matches(t, '\bassociate\s+professor\b|\bprofessor\b|\bvisiting\b|\bpostdoc')) OR regexp_matches(head, '\b(?:asst|assistant)\s*/\s*(?:assoc|associate)\b') AS is_faculty,
    regexp_matches(t, '\bassociate\s+professor\b') OR regexp_matches(head, 'assoc(?:iate)?\s*/') AS is_associate,
    len(list_filter(coalesce(ranks, []), lambda r: lower(trim(r)) IN ('professor', 'full professor'))) > 0 OR (regexp_matches(t, '\bprofessor\b') AND NOT regexp_matches(t, '\b(?:assistant|associate|visiting|adjunct)\s+professor\b')) OR regexp_matches(head, '/\s*prof(?:essor)?\b') AS is_full,
    kind IN ('Research', 'Scientific', 'Postdoc') OR regexp_matches(t, 'postdoc|post[- ]doc|research\s+fellow') AS is_research,
    kind = 'Visiting' OR regexp_matches(t, '\bvisiting\s+(?:faculty|professor|fellow|scholar|lecturer)\b') AS is_visiting,
    CASE WHEN coalesce(cb.ur, 0) > 0 OR coalesce(cb.sc, 0) > 0 OR coalesce(cb.st, 0) > 0 OR coalesce(cb.obc, 0) > 0 OR coalesce(cb.ews, 0) > 0 OR coalesce(cb.pwbd, 0) > 0
      THEN coalesce(cb.sc, 0) > 0 OR coalesce(cb.st, 0) > 0 OR coalesce(cb.obc, 0) > 0 OR coalesce(cb.ews, 0) > 0 OR coalesce(cb.pwbd, 0) > 0
      ELSE coalesce(regexp_matches(concat_ws(' ', title, raw_text_excerpt), '(?i)\b(?:special\s+recruitment\s+drive|mission\s+mode\s+recruitment|recruitment\s+drive\s+for\s+(?:SC|ST|OBC|EWS|PwBD|PwD|reserved))'), false) END AS is_reserved
  FROM e1
)"""

RANKS = [f"is_{r}" for r in facets.RANK_GROUPS]
FACETS = ["fields", "relevance", "inst_type", "state", *RANKS]
SPEC = facets.FilterSpec(query="postdoctoral quantum", relevance=frozenset(["non-hss", "hss"]), ranks=frozenset(["research", "faculty"]))
_ALIAS = "(" + " OR ".join(f"contains(' ' || folded || ' ', ' {v} ')" for v in ("postdoc", "post doc", "postdoctoral", "post doctoral")) + ")"
_SPEC = {"relevance": "relevance IN ('hss', 'non-hss')", "rank": "(is_research OR is_faculty)", "query": f"({_ALIAS} AND contains(folded, 'quantum'))"}


@query(f"WITH {_ENRICHED} SELECT id, field, relevance FROM e WHERE {' AND '.join(_SPEC.values())}")
def facet_filter(spark: SparkSession, root: str) -> DataFrame:
    return facets.filtered(enriched(spark, root, "field", "relevance", *RANKS, spec=SPEC), SPEC, AS_OF).select("id", "field", "relevance")


@query(f"WITH {_ENRICHED} SELECT id, closing_date FROM e WHERE date_diff('day', DATE '{AS_OF}', closing_date) BETWEEN 0 AND 7 AND is_reserved")
def closing_soon_reserved(spark: SparkSession, root: str) -> DataFrame:
    return facets.filtered(enriched(spark, root, "closing_date", "is_reserved"), facets.FilterSpec(closing_within=7, reserved_only=True), AS_OF).select("id", "closing_date")


def _facet_sql(active: dict[str, str]) -> str:
    dims = {
        "field": "unnest(fields)", "relevance": "relevance", "type": "inst_type", "state": "state",
        "rank": "unnest(list_filter([CASE WHEN is_faculty THEN 'faculty' END, CASE WHEN is_associate THEN 'associate' END, CASE WHEN is_full THEN 'full' END, CASE WHEN is_research THEN 'research' END, CASE WHEN is_visiting THEN 'visiting' END], lambda x: x IS NOT NULL))",
    }
    parts = [f"SELECT '{d}' AS dimension, value, count(*) AS n FROM (SELECT {e} AS value FROM e WHERE {' AND '.join(['true', *[p for k, p in active.items() if k != d]])}) WHERE value IS NOT NULL GROUP BY ALL" for d, e in dims.items()]
    return f"WITH {_ENRICHED} " + " UNION ALL ".join(parts)


@query(_facet_sql({}))
def facet_counts_static(spark: SparkSession, root: str) -> DataFrame:
    return facets.facet_counts(enriched(spark, root, *FACETS), facets.FilterSpec(), AS_OF)


@query(_facet_sql(_SPEC))
def facet_counts_reactive(spark: SparkSession, root: str) -> DataFrame:
    return facets.facet_counts(enriched(spark, root, *FACETS, spec=SPEC), SPEC, AS_OF)


_PLACE = f"CASE WHEN list_position([{', '.join(repr(f) for f in banks.FIELD_ORDER)}], field) > 0 THEN list_position([{', '.join(repr(f) for f in banks.FIELD_ORDER)}], field) ELSE {len(banks.FIELD_ORDER) + 1} END"
_DEADLINE = f"CASE WHEN closing_date IS NULL THEN 9999 WHEN closing_date < DATE '{AS_OF}' THEN 9998 ELSE date_diff('day', DATE '{AS_OF}', closing_date) END"
_SORTS = {
    "closing": f"{_DEADLINE}, {_PLACE}, field, coalesce(inst_name, ''), id",
    "newest": f"coalesce(CAST(publication_date AS VARCHAR), '') DESC, {_DEADLINE}, {_PLACE}, field, id",
    "field": f"{_PLACE}, field, {_DEADLINE}, coalesce(inst_name, ''), id",
    "inst": f"coalesce(inst_name, ''), {_PLACE}, field, {_DEADLINE}, id",
}


def _page(sort: str):
    def run(spark: SparkSession, root: str) -> DataFrame:
        return ranking.top_rows(enriched(spark, root, "field", "inst_name", "closing_date", "publication_date"), facets.sort_order(sort, AS_OF, banks.FIELD_ORDER), 25).select("rank", "id", "field")

    run.__name__ = f"sort_{sort}_page"
    return run


for _sort, _order in _SORTS.items():
    query(f"WITH {_ENRICHED} SELECT row_number() OVER (ORDER BY {_order}) AS rank, id, field FROM e ORDER BY rank LIMIT 25")(_page(_sort))


@query(
    f"""WITH {_LATEST} SELECT id, CASE WHEN d IS NULL THEN 'unknown' WHEN d < 0 THEN 'closed' WHEN d <= 7 THEN 'critical' WHEN d <= 30 THEN 'soon' ELSE 'ok' END AS urgency,
CASE WHEN d IS NULL THEN '' WHEN d < 0 THEN 'closed' WHEN d = 0 THEN 'closes today' WHEN d = 1 THEN '1 day left' ELSE 'in ' || d || ' days' END AS countdown,
CASE WHEN d IS NULL THEN 'rolling' WHEN d < 0 THEN 'closed' WHEN d > 60 THEN 'date' ELSE 'countdown' END AS tier,
greatest(date_diff('day', CAST(snapshot_fetched_at AS DATE), DATE '{AS_OF}'), 0) AS checked_days,
greatest(date_diff('day', CAST(snapshot_fetched_at AS DATE), DATE '{AS_OF}'), 0) >= 14 AS stale, coalesce(parse_confidence < 0.45, false) AS rough
FROM (SELECT *, date_diff('day', DATE '{AS_OF}', closing_date) AS d FROM ads)"""
)
def urgency_tiers(spark: SparkSession, root: str) -> DataFrame:
    ads = latest_ads(spark, root, "closing_date", "parse_confidence")
    seen = dates.days_since(F.to_date("snapshot_fetched_at"), AS_OF)
    c = F.col("closing_date")
    return ads.select("id", dates.urgency(c, AS_OF).alias("urgency"), dates.countdown(c, AS_OF).alias("countdown"), dates.deadline_tier(c, AS_OF).alias("tier"), seen.alias("checked_days"), (seen >= 14).alias("stale"), F.coalesce(F.col("parse_confidence") < 0.45, F.lit(False)).alias("rough"))


@query(f"""WITH {_LATEST} SELECT id, {_sql_fields("lower(concat_ws(' | ', title, department, discipline))")} AS tags,
CASE {" ".join(f"WHEN regexp_matches(core, '(?i){r.pattern}') THEN '{r.label}'" for bank in (banks.CORE_A, banks.CORE_B, banks.CORE_NOT) for r in bank)}
{" ".join(f"WHEN regexp_matches(whole, '(?i){r.pattern}') THEN '{r.label}'" for bank in (banks.CORE_A, banks.CORE_B, banks.HINT) for r in bank)} ELSE 'excluded' END AS profile
FROM (SELECT *, lower(concat_ws(' | ', title, department, discipline)) AS core, lower(concat_ws(' | ', title, department, discipline, raw_text_excerpt)) AS whole FROM ads)""")
def field_tags(spark: SparkSession, root: str) -> DataFrame:
    ads = latest_ads(spark, root, "title", "department", "discipline", "raw_text_excerpt")
    core, whole = F.lower(F.concat_ws(" | ", "title", "department", "discipline")), F.lower(F.concat_ws(" | ", "title", "department", "discipline", "raw_text_excerpt"))
    profile = scoped_match([(core, [*banks.CORE_A, *banks.CORE_B, *banks.CORE_NOT]), (whole, [*banks.CORE_A, *banks.CORE_B, *banks.HINT])], F.lit("excluded"))
    return ads.select("id", all_matches(core, banks.FIELDS).alias("tags"), profile.alias("profile"))


@query(f"""WITH {_LATEST} SELECT trap, count(*) AS n FROM (SELECT unnest(list_filter([{", ".join(f"CASE WHEN regexp_matches(lower(coalesce(raw_text_excerpt, '')), '(?i){r.pattern}') THEN '{r.label}' END" for r in banks.TRAPS)}], lambda x: x IS NOT NULL)) AS trap FROM ads) GROUP BY trap""")
def clause_flags(spark: SparkSession, root: str) -> DataFrame:
    ads = latest_ads(spark, root, "raw_text_excerpt")
    return ads.select(F.explode(all_matches(F.lower(F.coalesce("raw_text_excerpt", F.lit(""))), banks.TRAPS)).alias("trap")).groupBy("trap").agg(F.count("*").alias("n"))


_TEXT_KINDS = " ".join(f"WHEN regexp_matches(lower(left(coalesce(text, ''), 1500)), '{p}') THEN '{k}'" for k, p in banks.NOTICE_BY_TEXT)
_NAME_KINDS = " ".join(f"WHEN regexp_matches(lower(coalesce(url, '')), '{p}') THEN '{k}'" for k, p in banks.NOTICE_BY_NAME)


@query(f"SELECT kind, count(*) AS n, count(DISTINCT source) AS n_sources FROM (SELECT source, CASE {_NAME_KINDS} WHEN length(trim(coalesce(text, ''))) < 50 THEN 'extraction-failed' {_TEXT_KINDS} ELSE 'manual-queue' END AS kind FROM documents) GROUP BY kind")
def notice_triage(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    kind = layout.triage(F.col("url"), F.col("text"), banks.NOTICE_BY_NAME, banks.NOTICE_BY_TEXT)
    return docs.select("source", kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"))


_COVER = """cover AS (SELECT i.id AS institution_id, i.coverage_status, coalesce(c.n, 0) AS ads_found, c.last_read,
CASE WHEN coalesce(c.n, 0) > 0 THEN 'ok' WHEN i.career_page_url_guess IS NULL OR i.career_page_url_guess = '' THEN 'no-url' ELSE 'empty' END AS status
FROM institutions i LEFT JOIN (SELECT institution_id, count(DISTINCT id) AS n, max(snapshot_fetched_at) AS last_read FROM job_ads WHERE institution_id IS NOT NULL GROUP BY 1) c ON i.id = c.institution_id)"""


@query(f"WITH {_COVER} SELECT institution_id, ads_found, status, CASE status WHEN 'no-url' THEN 0 WHEN 'empty' THEN 1 WHEN 'ok' THEN 2 ELSE 3 END AS severity FROM cover")
def coverage_rows(spark: SparkSession, root: str) -> DataFrame:
    rows = sweep.coverage(table(spark, root, "institutions"), table(spark, root, "job_ads"))
    return rows.select("institution_id", "ads_found", "status", sweep.severity(F.col("status"), ["no-url", "empty", "ok"]).cast("int").alias("severity"))


@query(f"WITH {_COVER} SELECT count(*) AS attempted, count(*) FILTER (status = 'ok') AS succeeded, count(*) FILTER (ads_found > 0) AS with_ads, CAST(sum(ads_found) AS BIGINT) AS ads_total FROM cover")
def coverage_summary(spark: SparkSession, root: str) -> DataFrame:
    return sweep.coverage_summary(sweep.coverage(table(spark, root, "institutions"), table(spark, root, "job_ads")))


@query("SELECT DISTINCT id, institution_id FROM job_ads WHERE institution_id IS NOT NULL AND institution_id NOT IN (SELECT id FROM institutions)")
def unknown_institutions(spark: SparkSession, root: str) -> DataFrame:
    inst = table(spark, root, "institutions").select(F.col("id").alias("institution_id"))
    return table(spark, root, "job_ads").select("id", "institution_id").where("institution_id is not null").join(inst, "institution_id", "left_anti").distinct()


@query("SELECT DISTINCT j.id FROM job_ads j WHERE j.id IN (SELECT r.ad_id FROM (SELECT unnest(ad_refs) AS r FROM pdf_manifest))")
def referenced_ads(spark: SparkSession, root: str) -> DataFrame:
    refs = matching.references(table(spark, root, "pdf_manifest")).select(F.col("ad_id").alias("id"))
    return table(spark, root, "job_ads").select("id").join(refs, "id", "left_semi").distinct()


_SNAP = "ranked AS (SELECT *, dense_rank() OVER (ORDER BY snapshot_date DESC) AS age FROM (SELECT snapshot_date, id, max(institution_id) AS institution_id, epoch_us(min(fetched_at)) AS seq FROM ad_snapshots GROUP BY 1, 2))"


def _two_snapshots(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    snaps = table(spark, root, "ad_snapshots").groupBy("snapshot_date", "id").agg(F.max("institution_id").alias("institution_id"), F.min("fetched_at").cast("timestamp").alias("at"))
    days = [r[0] for r in snaps.select("snapshot_date").distinct().orderBy(F.col("snapshot_date").desc()).limit(2).collect()]
    return tuple(snaps.where(F.col("snapshot_date") == d).select("id", "institution_id", F.unix_micros("at").alias("seq")) for d in days)


@query(f"WITH {_SNAP} SELECT id, institution_id, false AS carried FROM ranked WHERE age = 1 UNION ALL SELECT id, institution_id, true FROM ranked WHERE age = 2 AND institution_id IS NOT NULL AND institution_id NOT IN (SELECT institution_id FROM ranked WHERE age = 1 AND institution_id IS NOT NULL)")
def carried_forward(spark: SparkSession, root: str) -> DataFrame:
    now, before = _two_snapshots(spark, root)
    return sweep.carry_forward(now.drop("seq"), before.drop("seq"), "institution_id")


@query(f"""WITH {_SNAP}, targets AS (SELECT id AS institution_id FROM institutions WHERE inst_type = (SELECT min(inst_type) FROM institutions)),
old AS (SELECT id, institution_id, seq FROM ranked WHERE age = 2), new AS (SELECT id, institution_id, seq FROM ranked WHERE age = 1)
SELECT id, institution_id, seq, seq AS slot, NULL::VARCHAR AS late_key FROM old WHERE institution_id IS NULL OR institution_id NOT IN (SELECT institution_id FROM targets)
UNION ALL SELECT n.id, n.institution_id, n.seq, f.slot, CASE WHEN f.slot IS NULL THEN n.institution_id END FROM new n
LEFT JOIN (SELECT institution_id, min(seq) AS slot FROM old GROUP BY 1) f ON n.institution_id = f.institution_id WHERE n.institution_id IN (SELECT institution_id FROM targets)""")
def targeted_replace(spark: SparkSession, root: str) -> DataFrame:
    now, before = _two_snapshots(spark, root)
    inst = table(spark, root, "institutions")
    kind = inst.agg(F.min("inst_type")).first()[0]
    return sweep.replace_keys(before, now, inst.where(F.col("inst_type") == kind).select(F.col("id").alias("institution_id")), "institution_id", "seq").select("id", "institution_id", "seq", "slot", "late_key")


@query("""SELECT id, fetched_at, closing_date, first_fetched FROM (SELECT id, fetched_at, closing_date, min(fetched_at) OVER (PARTITION BY id) AS first_fetched,
row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC, closing_date DESC NULLS LAST) AS rn FROM ad_snapshots) WHERE rn = 1""")
def upsert_last_wins(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "ad_snapshots").select("id", "fetched_at", "closing_date")
    return ranking.last_wins(rows, ["id"], ["fetched_at"]).select("id", "fetched_at", "closing_date", F.col("first_seq.fetched_at").alias("first_fetched"))


@query("SELECT institution_id, title, min(fetched_at) AS fetched_at FROM ad_snapshots WHERE institution_id IS NOT NULL GROUP BY 1, 2")
def first_wins_distinct(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "ad_snapshots").where("institution_id is not null").select("institution_id", "title", "fetched_at")
    return ranking.first_wins(rows, ["institution_id", "title"], ["fetched_at"])


_SID = "substr(sha256(coalesce(institution_id, '') || chr(0) || coalesce(title, '') || chr(0)), 1, 16)"


@query(f"WITH {_LATEST} SELECT id, {_SID} AS stable FROM ads")
def stable_ids(spark: SparkSession, root: str) -> DataFrame:
    return latest_ads(spark, root, "institution_id", "title").select("id", stable_id(F.col("institution_id"), F.col("title")).alias("stable"))


@query(f"""WITH {_LATEST}, b AS (SELECT id, {_SID} AS base, row_number() OVER (PARTITION BY {_SID} ORDER BY id) AS n FROM ads)
SELECT id, CASE WHEN n = 1 THEN base ELSE substr(sha256(base || chr(0) || id || chr(0) || id || chr(0)), 1, 16) END AS uid FROM b""")
def collision_free_ids(spark: SparkSession, root: str) -> DataFrame:
    ads = latest_ads(spark, root, "institution_id", "title").select("id", "institution_id", "title")
    return unique_ids(ads, stable_id(F.col("institution_id"), F.col("title")), [F.col("id")], [F.col("id")]).select("id", "uid")


@query(f"""WITH {_LATEST} SELECT id, CASE WHEN original_url IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY original_url) END AS peers,
coalesce(number_of_posts >= 2, false) OR (original_url IS NOT NULL AND count(*) OVER (PARTITION BY original_url) >= 2) OR coalesce(regexp_matches(raw_text_excerpt, '(?i)\\b(?:various|multiple|several)\\s+(?:posts|positions|disciplines|departments)\\b'), false) AS composite FROM ads""")
def peer_counts(spark: SparkSession, root: str) -> DataFrame:
    ads = ranking.peer_count(latest_ads(spark, root, "original_url", "number_of_posts", "raw_text_excerpt"), "original_url")
    return ads.select("id", "peers", fields.is_composite(F.col("raw_text_excerpt"), F.col("number_of_posts"), F.col("peers")).alias("composite"))


@query("SELECT id, count(*) AS n FROM job_ads GROUP BY id HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, root: str) -> DataFrame:
    return ranking.repeats(table(spark, root, "job_ads"), "id")


@query(f"""WITH d AS (SELECT DISTINCT snapshot_date AS day, date_diff('day', snapshot_date, DATE '{AS_OF}') AS age FROM ad_snapshots),
b AS (SELECT day, CASE WHEN age <= 45 THEN 'recent' WHEN age <= 84 THEN 'weekly' ELSE 'quarterly' END AS bucket FROM d)
SELECT day, bucket, bucket = 'recent' OR row_number() OVER (PARTITION BY bucket, CASE bucket WHEN 'weekly' THEN isoyear(day) * 100 + weekofyear(day) ELSE year(day) * 100 + quarter(day) END ORDER BY day) = 1 AS kept FROM b""")
def retention(spark: SparkSession, root: str) -> DataFrame:
    days = table(spark, root, "ad_snapshots").select(F.col("snapshot_date").alias("day"))
    return ranking.retained(days, AS_OF, keep_days=45, keep_weeks=12)


@query(f"""WITH {_LATEST}, refs AS (SELECT DISTINCT filename, r.ad_id AS ad_id FROM (SELECT filename, unnest(ad_refs) AS r FROM pdf_manifest) WHERE r.ad_id IS NOT NULL),
n AS (SELECT filename, count(*) AS n_refs FROM refs GROUP BY 1),
sw AS (SELECT ['and','or','the','a','an','of','in','for','to','with'] AS s),
a AS (SELECT id AS ad_id, f(title) AS t, f(department) AS d, f(discipline) AS c, w(concat_ws(' ', title, department, discipline, pdf_excerpt, raw_text_excerpt)) AS ww FROM ads),
p AS (SELECT DISTINCT ON (position_id) pdf_filename AS filename, position_id, f(department) AS d, f(discipline) AS c, w(concat_ws(' ', department, discipline, raw_section_text, nullif(list_aggregate(coalesce(areas, []), 'string_agg', ' '), ''))) AS ww,
      coalesce(raw_section_text, '') AS raw, coalesce(areas, []) AS areas FROM extracted_positions)
SELECT refs.filename, refs.ad_id, p.position_id, n_refs,
CAST((CASE WHEN a.d <> '' AND p.d <> '' AND (contains(a.d, p.d) OR contains(p.d, a.d)) THEN 12 WHEN a.d <> '' AND p.d <> '' THEN least(6, common(a.d, p.d) * 2) ELSE 0 END)
+ (CASE WHEN a.c <> '' AND a.c = p.c THEN 14 WHEN a.c <> '' AND p.c <> '' AND (contains(a.c, p.c) OR contains(p.c, a.c)) THEN 10 WHEN a.c <> '' AND p.c <> '' THEN least(8, common(a.c, p.c) * 3) ELSE 0 END)
+ (CASE WHEN p.c <> '' AND contains(a.t, p.c) THEN 10 ELSE 0 END) + (CASE WHEN p.d <> '' AND contains(a.t, p.d) THEN 8 ELSE 0 END)
+ least(12, len(list_intersect(a.ww, p.ww))) + (CASE WHEN length(p.raw) > 120 THEN 2 ELSE 0 END) + (CASE WHEN len(p.areas) > 0 THEN 2 ELSE 0 END) AS BIGINT) AS score
FROM refs JOIN n USING (filename) JOIN a USING (ad_id) JOIN p USING (filename)""".replace("f(title)", "{f:title}").replace("{f:title}", "trim(regexp_replace(replace(lower(coalesce(title, '')), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"))
def position_scores(spark: SparkSession, root: str) -> DataFrame:
    pairs = matching.scored_pairs(table(spark, root, "job_ads"), table(spark, root, "extracted_positions"), table(spark, root, "pdf_manifest"))
    return pairs.select("filename", "ad_id", "position_id", "n_refs", F.col("score").cast("long").alias("score"))


def _fold_sql(x: str) -> str:
    return f"trim(regexp_replace(replace(lower(coalesce({x}, '')), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


def _words_sql(x: str) -> str:
    stop = "'and','or','the','a','an','of','in','for','to','with'"
    return f"list_distinct(list_filter(string_split(trim(regexp_replace(replace(lower({x}), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' '), lambda v: length(v) > 1 AND v NOT IN ({stop})))"


def _common_sql(a: str, b: str) -> str:
    pick = "list_distinct(list_filter(string_split({0}, ' '), lambda v: length(v) > 1))"
    return f"len(list_intersect({pick.format(a)}, {pick.format(b)}))"


_sql = ORACLE["position_scores"]
for _name in ("department", "discipline"):
    _sql = _sql.replace(f"f({_name})", _fold_sql(_name))
for _name in ("concat_ws(' ', title, department, discipline, pdf_excerpt, raw_text_excerpt)", "concat_ws(' ', department, discipline, raw_section_text, nullif(list_aggregate(coalesce(areas, []), 'string_agg', ' '), ''))"):
    _sql = _sql.replace(f"w({_name})", _words_sql(_name))
ORACLE["position_scores"] = _sql.replace("common(a.d, p.d)", _common_sql("a.d", "p.d")).replace("common(a.c, p.c)", _common_sql("a.c", "p.c"))
ORACLE["position_matches"] = f"""WITH s AS ({ORACLE["position_scores"]}),
r AS (SELECT *, row_number() OVER (PARTITION BY filename, ad_id ORDER BY score DESC, position_id) AS rn, lead(score) OVER (PARTITION BY filename, ad_id ORDER BY score DESC, position_id) AS nxt FROM s WHERE n_refs > 1)
SELECT filename, ad_id, position_id, score FROM s WHERE n_refs = 1 UNION ALL
SELECT filename, ad_id, position_id, score FROM r WHERE rn = 1 AND score >= 10 AND (nxt IS NULL OR score - nxt >= 2 OR score >= 18)"""


@query()
def position_matches(spark: SparkSession, root: str) -> DataFrame:
    return matching.chosen_pairs(position_scores(spark, root))


@query("""WITH p AS (SELECT DISTINCT ON (position_id) * FROM extracted_positions),
r AS (SELECT *, coalesce(len(areas), 0) * 3 + floor(coalesce(length(raw_section_text), 0) / 80) + floor(coalesce(extraction_confidence, 0) * 4) AS richness FROM p)
SELECT pdf_filename, department, discipline, position_id, CAST(richness AS BIGINT) AS richness FROM (SELECT *, row_number() OVER (PARTITION BY pdf_filename, department, discipline ORDER BY richness DESC, position_id) AS rn FROM r) WHERE rn = 1""")
def richest_positions(spark: SparkSession, root: str) -> DataFrame:
    return matching.richest(table(spark, root, "extracted_positions")).select("pdf_filename", "department", "discipline", "position_id", F.col("richness").cast("long").alias("richness"))


@query(f"""WITH {_LATEST}, u AS (SELECT id, 'original_url' AS f, original_url AS url FROM ads UNION ALL SELECT id, 'apply_url', apply_url FROM ads)
SELECT lower(regexp_replace(regexp_replace(trim(url), '/+$', ''), '^(?i)https?://', '')) AS url_key, count(DISTINCT id) AS n_ads, count(DISTINCT f) AS n_fields, min(id) AS first_ad FROM u WHERE url IS NOT NULL AND trim(url) <> '' GROUP BY 1""")
def url_references(spark: SparkSession, root: str) -> DataFrame:
    return matching.url_references(latest_ads(spark, root, "original_url", "apply_url"), ["original_url", "apply_url"])


@query("SELECT fetch_status, count(*) AS n, CAST(coalesce(sum(len(ad_refs)), 0) AS BIGINT) AS n_refs, count(*) FILTER (error_text IS NOT NULL) AS n_errors FROM pdf_manifest GROUP BY 1")
def manifest_status(spark: SparkSession, root: str) -> DataFrame:
    m = table(spark, root, "pdf_manifest")
    return m.groupBy("fetch_status").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("ad_refs").isNotNull(), F.size("ad_refs"))), F.lit(0)).alias("n_refs"), F.count("error_text").alias("n_errors"))


@query(f"""WITH {_LATEST} SELECT id, CASE WHEN host = '' THEN '' WHEN len(l) <= 2 THEN array_to_string(l, '.') WHEN array_to_string(l[-2:], '.') IN ({", ".join(repr(e) for e in urls.COMPOUND_ENDINGS)}) THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain,
coalesce(regexp_matches(original_url, '(?i)\\.pdf(?:$|[?#])'), false) AS is_pdf, coalesce(regexp_matches(original_url, '(?i)^https?://[^/\\s]+'), false) AS is_web
FROM (SELECT *, string_split(host, '.') AS l FROM (SELECT id, original_url, lower(regexp_extract(coalesce(original_url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)) AS host FROM ads))""")
def url_domains(spark: SparkSession, root: str) -> DataFrame:
    u = F.col("original_url")
    return latest_ads(spark, root, "original_url").select("id", urls.registered_domain(u).alias("domain"), urls.is_pdf_url(u).alias("is_pdf"), urls.is_web_url(u).alias("is_web"))


@query(f"""WITH {_LATEST} SELECT id, contains(h, 'quantum') AND (contains(' ' || h || ' ', ' ai ') OR contains(' ' || h || ' ', ' artificial intelligence ') OR true) AS quantum_hit,
({" OR ".join(f"contains(' ' || h || ' ', ' {v} ')" for v in ("econ", "economics", "economic sciences"))}) AND contains(h, 'markets') AS econ_hit
FROM (SELECT id, trim(regexp_replace(replace(lower(concat_ws(' ', title, department, discipline, raw_text_excerpt)), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS h FROM ads)""")
def search_hits(spark: SparkSession, root: str) -> DataFrame:
    h = text.normalized(text.haystack(F.col("title"), F.col("department"), F.col("discipline"), F.col("raw_text_excerpt")), ascii_only=True)
    ads = latest_ads(spark, root, "title", "department", "discipline", "raw_text_excerpt").select("id", h.alias("h"))
    return ads.select("id", text.search_condition(F.col("h"), "the Quantum").alias("quantum_hit"), text.search_condition(F.col("h"), "Econ & markets").alias("econ_hit"))


@query("SELECT year, count(*) FILTER (contract_status = 'Regular') AS n_regular, count(*) FILTER (contract_status = 'Contractual') AS n_contractual, count(*) FILTER (contract_status = 'Visiting') AS n_visiting, count(*) AS n_all FROM (SELECT year(publication_date) AS year, contract_status FROM job_ads) WHERE year IS NOT NULL GROUP BY 1")
def volume_pivot(spark: SparkSession, root: str) -> DataFrame:
    return reports.volume(table(spark, root, "job_ads"), F.year("publication_date"), "contract_status", ["Regular", "Contractual", "Visiting"])


_PCT = "floor(count(*) FILTER ({0}) * 100.0 / count(*) * 10 + 0.5) / 10"


@query(f"""WITH {_LATEST} SELECT year(publication_date) AS year, count(*) AS n, round(count(*) FILTER (category_breakdown IS NOT NULL) * 100.0 / count(*), 1) AS pct_disclosed,
round(count(*) FILTER (closing_date IS NULL) * 100.0 / count(*), 1) AS pct_rolling FROM ads WHERE publication_date IS NOT NULL GROUP BY 1""")
def disclosure_pct(spark: SparkSession, root: str) -> DataFrame:
    ads = latest_ads(spark, root, "publication_date", "category_breakdown", "closing_date")
    return reports.flag_shares(ads, F.year("publication_date"), {"disclosed": F.col("category_breakdown").isNotNull(), "rolling": F.col("closing_date").isNull()})


def _occurrences(p: str) -> str:
    return f"CAST(sum((length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), '{p}', ''))) / {len(p)}) AS BIGINT)"


@query(f"SELECT source, {', '.join(f'{_occurrences(p)} AS {n}' for n, p in banks.PHRASES.items())} FROM documents GROUP BY source")
def phrase_volumes(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    counted = docs.select("source", *[c.alias(n) for n, c in phrase_counts(F.col("text"), banks.PHRASES).items()])
    return counted.groupBy("source").agg(*[F.sum(n).cast("long").alias(n) for n in banks.PHRASES])


@query("SELECT source, coalesce(lang, 'none') AS lang, count(*) AS n, count(text) AS n_texts, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS n_chars, count(DISTINCT text) AS n_distinct FROM documents GROUP BY 1, 2")
def corpus_stats(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    return docs.groupBy("source", F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count("*").alias("n"), F.count("text").alias("n_texts"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("n_chars"), F.count_distinct(F.xxhash64("text"), F.when(F.col("text").isNotNull(), F.length("text"))).alias("n_distinct"))


_CATS = "cats AS (SELECT rank, c.category AS category, c.posts AS posts FROM (SELECT rank, unnest([{'category': 'ur', 'posts': b.ur}, {'category': 'sc', 'posts': b.sc}, {'category': 'st', 'posts': b.st}, {'category': 'obc', 'posts': b.obc}, {'category': 'ews', 'posts': b.ews}, {'category': 'pwbd', 'posts': b.pwbd}]) AS c FROM (SELECT DISTINCT ON (position_id) coalesce(ranks[1], 'unspecified') AS rank, reservation_breakdown AS b FROM extracted_positions)) WHERE c.posts IS NOT NULL)"


def _category_rows(spark: SparkSession, root: str) -> DataFrame:
    pos = table(spark, root, "extracted_positions").select("position_id", F.coalesce(F.get("ranks", F.lit(0)), F.lit("unspecified")).alias("rank"), "reservation_breakdown").dropDuplicates(["position_id"])
    return reports.category_rows(pos, "reservation_breakdown", ["rank"])


@query(f"WITH {_CATS} SELECT CASE WHEN grouping(rank) = 1 THEN 'all' ELSE rank END AS rank, CASE WHEN grouping(category) = 1 THEN 'all' ELSE category END AS category, CAST(sum(posts) AS BIGINT) AS total FROM cats GROUP BY CUBE (rank, category)")
def rank_category_cube(spark: SparkSession, root: str) -> DataFrame:
    return reports.cube_totals(_category_rows(spark, root), "rank", "category", "posts")


_TARGET = " ".join(f"WHEN '{c}' THEN {t}" for c, t in reports.MANDATE.items())


@query(f"""WITH {_CATS}, s AS (SELECT category, CAST(sum(posts) AS BIGINT) AS posts, CASE category {_TARGET} END AS target FROM cats WHERE category <> 'pwbd' GROUP BY 1), t AS (SELECT sum(posts) AS a FROM s)
SELECT category, posts, round(posts * 100.0 / a, 3) AS share, CAST(target AS DOUBLE) AS target, round(posts * 100.0 / a / target * 100, 3) AS index,
CASE WHEN posts * 100.0 / a / target * 100 > 110 THEN 'over' WHEN posts * 100.0 / a / target * 100 < 50 THEN 'severe' WHEN posts * 100.0 / a / target * 100 < 90 THEN 'under' ELSE 'met' END AS band FROM s, t""")
def mandate_gap(spark: SparkSession, root: str) -> DataFrame:
    return reports.mandate_gap(_category_rows(spark, root))


@query("""WITH x AS (SELECT i.state, i.inst_type, count(*) AS n FROM job_ads j JOIN institutions i ON j.institution_id = i.id GROUP BY 1, 2)
SELECT state, inst_type, n, CAST(sum(n) OVER (PARTITION BY state) AS BIGINT) AS group_total, round(n / sum(n) OVER (PARTITION BY state), 6) AS share FROM x WHERE state IS NOT NULL""")
def state_type_stack(spark: SparkSession, root: str) -> DataFrame:
    inst = table(spark, root, "institutions").select(F.col("id").alias("institution_id"), "state", "inst_type")
    return reports.stacked(table(spark, root, "job_ads").select("institution_id").join(inst, "institution_id"), "state", "inst_type")


@query("""WITH x AS (SELECT snapshot_date, CAST(sum(number_of_posts) AS BIGINT) AS posts FROM (SELECT snapshot_date, id, max(number_of_posts) AS number_of_posts FROM ad_snapshots GROUP BY 1, 2) GROUP BY 1)
SELECT snapshot_date, posts, CAST(sum(posts) OVER (ORDER BY snapshot_date) AS BIGINT) AS running, sum(posts) OVER (ORDER BY snapshot_date) / sum(posts) OVER () AS running_share FROM x""")
def posts_timeline(spark: SparkSession, root: str) -> DataFrame:
    snaps = table(spark, root, "ad_snapshots").groupBy("snapshot_date", "id").agg(F.max("number_of_posts").alias("n")).groupBy("snapshot_date").agg(F.sum("n").alias("posts"))
    # One row for each snapshot.
    return ranking.cumulative(snaps, [], [F.col("snapshot_date")], "posts")


@query("""WITH x AS (SELECT institution_id, post_type, count(*) AS n FROM job_ads WHERE institution_id IS NOT NULL AND post_type IS NOT NULL GROUP BY 1, 2)
SELECT institution_id, post_type, n FROM (SELECT *, row_number() OVER (PARTITION BY institution_id ORDER BY n DESC, post_type) AS rn FROM x) WHERE rn = 1""")
def leading_post_type(spark: SparkSession, root: str) -> DataFrame:
    n = table(spark, root, "job_ads").where("institution_id is not null and post_type is not null").groupBy("institution_id", "post_type").agg(F.count("*").alias("n"))
    return reports.argmax_rows(n, "institution_id", "n", "post_type")


@query(f"WITH {_ENRICHED} SELECT CAST(floor(lat / 2.0) AS BIGINT) AS row, CAST(floor(lon / 2.0) AS BIGINT) AS col, count(*) AS n_ads, count(DISTINCT institution_id) AS n_institutions FROM e WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1, 2")
def map_grid(spark: SparkSession, root: str) -> DataFrame:
    ads = latest_ads(spark, root, "institution_id").join(table(spark, root, "institutions").select(F.col("id").alias("institution_id"), "lat", "lon"), "institution_id")
    return facets.grid_counts(ads, 2.0)


@query(f"""WITH {_LATEST}, bands AS (SELECT DISTINCT snapshot_date AS lo, snapshot_date + 2 AS hi FROM ad_snapshots)
SELECT id, closing_date FROM ads WHERE closing_date IS NULL OR NOT EXISTS (SELECT 1 FROM bands WHERE closing_date BETWEEN lo AND hi)""")
def outside_bands(spark: SparkSession, root: str) -> DataFrame:
    bands = table(spark, root, "ad_snapshots").select(F.col("snapshot_date").alias("lo")).distinct().withColumn("hi", F.date_add("lo", 2))
    return matching.outside_bands(latest_ads(spark, root, "closing_date").select("id", "closing_date"), "closing_date", bands, "lo", "hi")


@query(f"""WITH {_LATEST}, rules AS (
SELECT coalesce(id, '<missing>') AS record, unnest(list_filter([
 CASE WHEN id IS NULL OR trim(id) = '' THEN 'missing id' END, CASE WHEN institution_id IS NULL OR trim(institution_id) = '' THEN 'missing institution' END, CASE WHEN title IS NULL OR trim(title) = '' THEN 'missing title' END,
 CASE WHEN coalesce(regexp_matches(raw_text_excerpt, '(?i)<\\s*script\\b|javascript\\s*:|\\bon(?:error|load|click)\\s*='), false) OR coalesce(regexp_matches(pdf_excerpt, '(?i)<\\s*script\\b|javascript\\s*:|\\bon(?:error|load|click)\\s*='), false) THEN 'unsafe text' END,
 CASE WHEN NOT parse_confidence BETWEEN 0 AND 1 THEN 'confidence out of range' END, CASE WHEN closing_date < publication_date THEN 'closes before it opens' END], lambda x: x IS NOT NULL)) AS rule FROM job_ads)
SELECT rule, record, count(*) AS n FROM rules GROUP BY 1, 2 UNION ALL
SELECT 'unknown institution', id, count(*) FROM job_ads WHERE institution_id IS NOT NULL AND institution_id NOT IN (SELECT id FROM institutions) GROUP BY 2 UNION ALL
SELECT 'duplicate id', id, count(*) - 1 FROM job_ads WHERE id IS NOT NULL GROUP BY 2 HAVING count(*) > 1""")
def validation_report(spark: SparkSession, root: str) -> DataFrame:
    ads = table(spark, root, "job_ads")
    own = validation.row_rules(ads, F.col("id"), validation.ad_rules(["original_url", "apply_url"], ["raw_text_excerpt", "pdf_excerpt"]))
    return own.unionByName(validation.orphans(ads, "institution_id", table(spark, root, "institutions"), "id", "id", "unknown institution")).unionByName(validation.duplicate_keys(ads, "id"))


@query("""SELECT 'both' AS kind, id FROM (SELECT id FROM institutions INTERSECT SELECT institution_id FROM job_ads) UNION ALL SELECT 'registry only', id FROM (SELECT id FROM institutions EXCEPT SELECT institution_id FROM job_ads)
UNION ALL SELECT 'ads only', id FROM (SELECT institution_id AS id FROM job_ads WHERE institution_id IS NOT NULL EXCEPT SELECT id FROM institutions)""")
def set_operations(spark: SparkSession, root: str) -> DataFrame:
    a = table(spark, root, "institutions").select("id")
    b = table(spark, root, "job_ads").where("institution_id is not null").select(F.col("institution_id").alias("id")).distinct()
    kinds = a.intersect(b).withColumn("kind", F.lit("both")).unionByName(a.subtract(b).withColumn("kind", F.lit("registry only"))).unionByName(b.subtract(a).withColumn("kind", F.lit("ads only")))
    return kinds.select("kind", "id")


@query("""WITH l AS (SELECT doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS ls FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM l),
k AS (SELECT *, CASE WHEN trim(line) = '' THEN 'spacer' WHEN regexp_matches(line, '^\\s*(?:[A-Z][A-Z &,/-]{6,}|(?:annexure|schedule|section|part)\\s+[-–]?\\s*[A-Z0-9]{1,4}\\b.*)\\s*:?\\s*$') THEN 'header' WHEN regexp_matches(line, '(?i)^\\s*(?:[-•*▪●]\\s+|\\(?[a-z0-9]{1,3}[.)]\\s+)') THEN 'list' ELSE 'paragraph' END AS kind FROM u)
SELECT kind, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM k GROUP BY kind""")
def line_kinds(spark: SparkSession, root: str) -> DataFrame:
    lines = layout.text_lines(table(spark, root, "documents"))
    return lines.select("doc_id", layout.line_class(F.col("line")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n_lines"), F.count_distinct("doc_id").alias("n_docs"))


_KIND = r"""CASE WHEN trim(line) = '' THEN 'spacer' WHEN regexp_matches(line, '^\s*(?:[A-Z][A-Z &,/-]{6,}|(?:annexure|schedule|section|part)\s+[-–]?\s*[A-Z0-9]{1,4}\b.*)\s*:?\s*$') THEN 'header' WHEN regexp_matches(line, '(?i)^\s*(?:[-•*▪●]\s+|\(?[a-z0-9]{1,3}[.)]\s+)') THEN 'list' ELSE 'paragraph' END"""


@query(rf"""WITH l AS (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS ls FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM l),
k AS (SELECT *, {_KIND} AS kind FROM u), p AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM k),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR kind <> before OR kind = 'header' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM p)
SELECT doc_id, CAST(section AS BIGINT) AS section, kind, count(*) AS n_lines, CAST(min(line_no) AS INT) AS first_line, string_agg(trim(line), ' ' ORDER BY line_no) AS text FROM s WHERE kind <> 'spacer' GROUP BY doc_id, section, kind""")
def text_sections(spark: SparkSession, root: str) -> DataFrame:
    return layout.sections(layout.text_lines(table(spark, root, "documents")))


@query()
def document_chunks(spark: SparkSession, root: str) -> DataFrame:
    return chunks.chunked(table(spark, root, "documents")).select("chunk_id", "doc_id", "idx", "char_start", "char_end")


@query()
def chunk_summary(spark: SparkSession, root: str) -> DataFrame:
    return chunks.chunk_stats(chunks.chunked(table(spark, root, "documents")))


_SAYS = r"\b(?:applications?|qualification|eligib|position|post of|vacanc|recruit|specialisation|teaching|doctora)"
#: Fixed value: what the example takes out of excerpts.
_TAKE_OUT = ["(?i)add to calendar", "[^.|]*[\u0900-\u097f]+[^.|]*"]


@query(rf"""WITH {_LATEST}, x AS (SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(raw_text_excerpt, ''), '{_TAKE_OUT[0]}', ' ', 'g'), '{_TAKE_OUT[1]}', ' ', 'g'), '\s+', ' ', 'g')) AS x FROM ads),
y AS (SELECT id, x, length(x) AS n, CAST(floor((length(x) - 1) / 2) AS INT) AS half, regexp_extract(x, '(?i)^(.{{80,}}?)(?:{_SAYS})', 1) AS lead FROM x)
SELECT id, CASE WHEN n % 2 = 1 AND half BETWEEN 1 AND 60 AND left(x, half) = right(x, half) OR n < 200 AND len(string_split(x, '|')) >= 3 OR n < 60 AND NOT regexp_matches(x, '(?i){_SAYS}') THEN ''
ELSE substr(x, 1 + CASE WHEN length(lead) < n - 50 THEN length(regexp_extract(lead, '^(.*\. )', 1)) ELSE 0 END) END AS excerpt FROM y""")
def excerpts_clean(spark: SparkSession, root: str) -> DataFrame:
    clean = text.clean_excerpt(F.col("raw_text_excerpt"), _SAYS, _TAKE_OUT)
    return latest(table(spark, root, "job_ads").withColumn("excerpt", clean), "excerpt").select("id", "excerpt")


def _date_sql(x: str, least: int) -> str:
    tidy = f"regexp_replace(trim(regexp_replace(regexp_replace({x}, '(\\d)(?:st|nd|rd|th)\\b', '\\1', 'gi'), ',', ' ', 'g')), '\\s+', ' ', 'g')"
    tried = ", ".join(f"try_strptime({tidy}, '{f}')" for f in ("%Y-%m-%d", "%d.%m.%Y", "%d-%m-%Y", "%d/%m/%Y", "%d %B %Y", "%d %b %Y", "%d-%b-%Y", "%B %d %Y", "%b %d %Y"))
    return f"(CASE WHEN year(coalesce({tried})) BETWEEN {least} AND 2035 THEN CAST(coalesce({tried}) AS DATE) END)"


_DUE = ", ".join(_date_sql(f"regexp_extract(x, '(?is){label}.{{0,60}}?\\b({dates.DATE})', 1)", 2020) for label in fields.DEADLINE_LABELS)
_CAMPUS = ", ".join(f"nullif(regexp_extract(x, '{p}', 1), '')" for p in (r"\bCampus[:\s]+([A-Z][a-zA-Z]+)\b", r"\b([A-Z][a-zA-Z]+)\s+[Cc]ampus\b", r"(?i)\b(?:based|located|positioned)\s+(?:in|at)\s+([A-Z][a-zA-Z]+)\b"))


@query(rf"""WITH {_LATEST}, t AS (SELECT id, coalesce(raw_text_excerpt, '') AS x FROM ads)
SELECT id, coalesce({_DUE}) AS deadline, len(list_filter(regexp_extract_all(x, '({dates.DATE})', 1), lambda d: {_date_sql("d", 2015)} IS NOT NULL)) AS n_dates, coalesce({_CAMPUS}) AS campus,
coalesce(array_to_string((SELECT list(v ORDER BY k) FROM (SELECT v, min(k) AS k FROM (SELECT unnest(p) AS v, generate_subscripts(p, 1) AS k FROM (SELECT regexp_extract_all(x, '((?:[Aa]t least )?\d+ (?:research )?(?:publications|papers)[^.]{{0,80}})', 1) AS p)) GROUP BY v))[1:3], ' | '), '') AS publications FROM t""")
def text_deadlines(spark: SparkSession, root: str) -> DataFrame:
    x = F.col("raw_text_excerpt")
    found = {"deadline": fields.deadline(x), "n_dates": F.size(dates.dates_in(x)), "campus": fields.campus(x), "publications": fields.publications(x)}
    return latest(table(spark, root, "job_ads").withColumns(found), *found).select("id", *found)


@query()
def text_rosters(spark: SparkSession, root: str) -> DataFrame:
    counts = latest_ads(spark, root, "raw_text_excerpt").where(F.col("raw_text_excerpt").rlike(f"(?i){fields.COUNTED}")).select("id", fields.roster(F.col("raw_text_excerpt")).alias("r"))
    return counts.select("id", "r.*", fields.roster_total(F.col("r")).alias("total")).where("total is not null")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, e.vec_id, list_cosine_similarity(q.v, e.embedding::DOUBLE[]) AS similarity FROM q JOIN embeddings e ON e.vec_id <> q.query_id)
SELECT query_id, vec_id, round(similarity, 5) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def vector_topk(spark: SparkSession, root: str) -> DataFrame:
    v = table(spark, root, "embeddings")
    return vectors.nearest(v, v.where("vec_id % 100 = 0")).select("query_id", "vec_id", F.round("similarity", 5).alias("similarity"), "rank")


@query()
def vector_topk_indexed(spark: SparkSession, root: str) -> DataFrame:
    """The same search through the index, for more queries than blocks can be sent for."""
    v = table(spark, root, "embeddings")
    return vectors.nearest_by_index(v, v.where("vec_id % 100 = 0")).select("query_id", "vec_id", F.round("similarity", 5).alias("similarity"), "rank")


@query("""SELECT label, pos - 1 AS pos, round(avg(x::DOUBLE), 6) AS mean, count(*) AS n FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2""")
def label_centroids(spark: SparkSession, root: str) -> DataFrame:
    return vectors.centroids(table(spark, root, "embeddings"), "label").withColumn("mean", F.round("mean", 6))


@query()
def vector_clusters(spark: SparkSession, root: str) -> DataFrame:
    v = table(spark, root, "embeddings")
    start = [r[0] for r in v.groupBy("label").agg(F.min("vec_id").alias("v")).orderBy("v").select("v").collect()]
    return vectors.kmeans(v, start)[0].groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg("similarity"), 6).alias("mean_similarity"))


@query("""SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3""")
def event_windows(spark: SparkSession, root: str) -> DataFrame:
    from noticeworks.streaming.events import windowed

    events = table(spark, root, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = windowed(events)
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS s FROM events),
n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events FROM n GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, root: str) -> DataFrame:
    from noticeworks.streaming.events import sessions

    out = sessions(table(spark, root, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n_events")
