"""Queries over derived columns: states, labels, units, cues, canonical records, coverage by state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.functions import cards, fields, text, urls
from noticeworks.ids import stable_id
from noticeworks.operators import ranking, sweep
from noticeworks.plans import banks
from noticeworks.plans.feed_queries import _LATEST, AS_OF, _sql_fields, _two_snapshots, latest, latest_ads
from noticeworks.rules import Rule, all_matches, first_match, matches
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


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


_X = "lower(coalesce(text, ''))"
_DISCLOSED = f"""d AS (SELECT year(fetched_at) AS year, regexp_matches({_X}, '{cards.TOTALS}') AS totals,
 len(regexp_extract_all({_X}, '{cards.CATEGORY_NUMBER}')) >= 3 AND regexp_matches({_X}, '{cards.CATEGORY_PAIR}') AS categories,
 len(regexp_extract_all({_X}, '{cards.INSTITUTION}')) >= 2 AND regexp_matches({_X}, '{cards.TOTALS}') AS institutions FROM documents)"""


def _disclosed(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select(F.year("fetched_at").alias("year"), *[c.alias(n) for n, c in cards.disclosure(F.col("text")).items()])


@query(f"WITH {_DISCLOSED} SELECT totals, categories, institutions, count(*) AS n FROM d GROUP BY ALL")
def disclosure_flags(spark: SparkSession, root: str) -> DataFrame:
    return _disclosed(spark, root).groupBy("totals", "categories", "institutions").agg(F.count("*").alias("n"))


@query(f"""WITH {_DISCLOSED} SELECT year, dim, count(*) FILTER (v) AS n_yes, count(*) FILTER (NOT v) AS n_no FROM
(SELECT year, unnest([{{'dim': 'totals', 'v': totals}}, {{'dim': 'categories', 'v': categories}}, {{'dim': 'institutions', 'v': institutions}}], recursive := true) FROM d) WHERE year IS NOT NULL GROUP BY year, dim""")
def disclosure_timeline(spark: SparkSession, root: str) -> DataFrame:
    dims = F.array(*[F.struct(F.lit(n).alias("dim"), F.col(n).alias("v")) for n in ("totals", "categories", "institutions")])
    rows = _disclosed(spark, root).where("year is not null").select("year", F.explode(dims).alias("x")).select("year", "x.dim", "x.v")
    return rows.groupBy("year", "dim").agg(F.count_if("v").alias("n_yes"), F.count_if(~F.col("v")).alias("n_no"))


_ALL = "lower(concat_ws(' ', title, raw_text_excerpt))"
_COUNTS = " OR ".join(f"coalesce(category_breakdown.{c}, 0) > 0" for c in fields.CATEGORIES)


@query(f"""WITH {_LATEST}, p AS (SELECT a.*, coalesce(i.inst_type = 'Private', false) AS private, CASE WHEN original_url IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY original_url) END AS peers FROM ads a LEFT JOIN institutions i ON a.institution_id = i.id),
s AS (SELECT *, coalesce({_COUNTS}, false) AS counted, coalesce(number_of_posts >= 2, false) OR peers >= 2 OR coalesce(regexp_matches(raw_text_excerpt, '(?i)\\b(?:various|multiple|several)\\s+(?:posts|positions|disciplines|departments)\\b'), false) AS composite FROM p)
SELECT state, count(*) AS n FROM (SELECT CASE WHEN private AND NOT counted THEN 'private' WHEN counted THEN 'counted' WHEN regexp_matches({_ALL}, '{cards.DRIVE}') THEN 'drive' WHEN composite THEN 'composite'
WHEN coalesce(number_of_posts = 1, false) OR (NOT composite AND regexp_matches({_ALL}, '{cards.SINGLE}')) THEN 'single' ELSE 'unknown' END AS state FROM s) GROUP BY state""")
def reservation_states(spark: SparkSession, root: str) -> DataFrame:
    inst = table(spark, root, "institutions").select(F.col("id").alias("institution_id"), (F.col("inst_type") == "Private").alias("private"))
    raw = table(spark, root, "job_ads")
    said = fields.is_composite(F.col("raw_text_excerpt"), F.col("number_of_posts"), F.lit(0))
    whole = F.lower(F.concat_ws(" ", "title", "raw_text_excerpt"))
    marks = raw.withColumns({"counted": F.coalesce(cards.has_counts(F.col("category_breakdown")), F.lit(False)), "said": said, "drive": whole.rlike(cards.DRIVE), "lone": whole.rlike(cards.SINGLE)})
    ads = ranking.peer_count(latest(marks, "institution_id", "original_url", "number_of_posts", "counted", "said", "drive", "lone"), "original_url").join(inst, "institution_id", "left")
    composite, private = F.col("said") | (F.col("peers") >= 2), F.coalesce("private", F.lit(False))
    state = cards.reservation_state(private, F.col("counted"), F.col("drive"), composite, (F.col("number_of_posts") == 1) | (~composite & F.col("lone")))
    return ads.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


_FALLBACK = [*banks.FIELDS[:6]]
_CORE = "lower(concat_ws(' | ', title, department, discipline))"
_WHOLE = "lower(concat_ws(' | ', title, department, discipline, pdf_excerpt, raw_text_excerpt))"


def _bank_sql(bank, x: str) -> str:
    return f"list_filter([{', '.join(f'''CASE WHEN regexp_matches({x}, '(?i){r.pattern}') THEN '{r.label}' END''' for r in bank)}], lambda v: v IS NOT NULL)"


@query(f"""WITH {_LATEST}, t AS (SELECT id, {_sql_fields(_CORE)} AS tags, {_bank_sql(_FALLBACK, _WHOLE)}[1:3] AS wide, regexp_matches({_CORE}, '(?i){banks.CORE_NOT[0].pattern}') AS outside, parse_confidence, regexp_matches({_WHOLE}, '(?i){banks.HINT[0].pattern}') AS hint FROM ads)
SELECT id, array_to_string(CASE WHEN len(tags) > 0 THEN tags WHEN outside THEN ['Other'] WHEN coalesce(parse_confidence < 0.45, false) THEN ['General'] WHEN len(wide) > 0 THEN wide WHEN hint THEN ['General'] ELSE ['Other'] END, '|') AS tags FROM t""")
def gated_field_tags(spark: SparkSession, root: str) -> DataFrame:
    core, whole = F.lower(F.concat_ws(" | ", "title", "department", "discipline")), F.lower(F.concat_ws(" | ", "title", "department", "discipline", "pdf_excerpt", "raw_text_excerpt"))
    tags, wide = all_matches(core, banks.FIELDS), F.slice(all_matches(whole, _FALLBACK), 1, 3)
    general, other = F.array(F.lit("General")), F.array(F.lit("Other"))
    chosen = (
        F.when(F.size(tags) > 0, tags).when(matches(core, banks.CORE_NOT[0].pattern), other).when(F.coalesce(F.col("parse_confidence") < 0.45, F.lit(False)), general)
        .when(F.size(wide) > 0, wide).when(matches(whole, banks.HINT[0].pattern), general).otherwise(other)
    )
    return latest(table(spark, root, "job_ads").withColumn("tags", F.array_join(chosen, "|")), "tags").select("id", "tags")


@query(f"""WITH {_LATEST} SELECT id, coalesce(nullif(trim(institution_id), ''), 'unlisted') AS institution_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, coalesce(post_type, 'Unknown') AS post_type, coalesce(contract_status, 'Unknown') AS contract_status,
CAST(closing_date AS VARCHAR) AS closing_date, CAST(publication_date AS VARCHAR) AS publication_date, strftime(snapshot_fetched_at, '%Y-%m-%dT%H:%M:%S') AS snapshot_fetched_at, coalesce(parse_confidence, 0.5) AS parse_confidence, coalesce(_source_method, 'unknown') AS source_method,
CASE WHEN closing_date IS NULL THEN 'rolling' END AS source_note FROM ads""")
def canonical_ads(spark: SparkSession, root: str) -> DataFrame:
    ads = latest_ads(spark, root, "institution_id", "title", "post_type", "contract_status", "closing_date", "publication_date", "parse_confidence", "_source_method")
    own = F.trim("institution_id")
    return ads.select(
        "id", F.coalesce(F.when(own != "", own), F.lit("unlisted")).alias("institution_id"), F.trim(F.regexp_replace("title", r"\s+", " ")).alias("title"), F.coalesce("post_type", F.lit("Unknown")).alias("post_type"),
        F.coalesce("contract_status", F.lit("Unknown")).alias("contract_status"), F.col("closing_date").cast("string").alias("closing_date"), F.col("publication_date").cast("string").alias("publication_date"),
        F.date_format("snapshot_fetched_at", "yyyy-MM-dd'T'HH:mm:ss").alias("snapshot_fetched_at"), F.coalesce("parse_confidence", F.lit(0.5)).alias("parse_confidence"), F.coalesce("_source_method", F.lit("unknown")).alias("source_method"),
        F.when(F.col("closing_date").isNull(), "rolling").alias("source_note"),
    )


@query("SELECT substr(sha256('rolling' || chr(0) || id || chr(0)), 1, 16) AS id, id AS institution_id, 'Rolling call (all areas)' AS title, 'Faculty' AS post_type, career_page_url_guess AS original_url, coalesce(nullif(trim(notes), ''), 'Standing call') AS excerpt FROM institutions WHERE parser_name = 'rolling'")
def rolling_stubs(spark: SparkSession, root: str) -> DataFrame:
    inst = table(spark, root, "institutions").where("parser_name = 'rolling'")
    note = F.trim("notes")
    return inst.select(stable_id(F.lit("rolling"), F.col("id")).alias("id"), F.col("id").alias("institution_id"), F.lit("Rolling call (all areas)").alias("title"), F.lit("Faculty").alias("post_type"), F.col("career_page_url_guess").alias("original_url"), F.coalesce(F.when(note != "", note), F.lit("Standing call")).alias("excerpt"))


@query(f"WITH {_LATEST} SELECT kind, count(*) AS n FROM (SELECT CASE WHEN structured_position IS NOT NULL AND len(structured_position.ranks) > 0 THEN 'listed' ELSE post_type END AS kind FROM ads) WHERE kind IS DISTINCT FROM 'NonFaculty' GROUP BY kind")
def faculty_projection(spark: SparkSession, root: str) -> DataFrame:
    sp = F.col("structured_position")
    kind = F.when(sp.isNotNull() & (F.size(sp["ranks"]) > 0), "listed").otherwise(F.col("post_type"))
    ads = latest(table(spark, root, "job_ads").withColumn("kind", kind), "kind")
    return ads.where(~F.col("kind").eqNullSafe("NonFaculty")).groupBy("kind").agg(F.count("*").alias("n"))


_LAST_TWO = "snap AS (SELECT institution_id, count(*) FILTER (age = 1) AS n_now, count(*) FILTER (age = 2) AS n_before FROM (SELECT institution_id, dense_rank() OVER (ORDER BY snapshot_date DESC) AS age FROM (SELECT snapshot_date, id, max(institution_id) AS institution_id FROM ad_snapshots GROUP BY 1, 2)) GROUP BY 1)"


@query(f"""WITH {_LAST_TWO}, s AS (SELECT i.id AS institution_id, CASE WHEN parser_name = 'generic' AND coverage_status = 'Unverified' THEN 'manual' WHEN coalesce(career_page_url_guess, '') = '' THEN 'no-url' WHEN coverage_status = 'Blocked' THEN 'robots-blocked' ELSE 'ok' END AS fetched,
parser_name = 'rolling' AS fallback, coalesce(n_now, 0) AS n_now, coalesce(n_before, 0) AS n_before FROM institutions i LEFT JOIN snap ON i.id = snap.institution_id)
SELECT institution_id, CASE WHEN fetched = 'manual' THEN 'manual' WHEN fetched = 'ok' AND n_now > 0 THEN 'ok' WHEN fallback THEN 'rolling-stub' WHEN n_before > 0 THEN 'stale-carried' WHEN fetched = 'ok' THEN 'ok-empty' ELSE fetched END AS outcome, n_now AS ads_found FROM s""")
def sweep_outcomes(spark: SparkSession, root: str) -> DataFrame:
    """Exactly one row for each source: what became of it in the last sweep."""
    now, before = _two_snapshots(spark, root)
    count = lambda rows, name: rows.where("institution_id is not null").groupBy("institution_id").agg(F.count("*").alias(name))
    inst = table(spark, root, "institutions").select(F.col("id").alias("institution_id"), "parser_name", "coverage_status", "career_page_url_guess")
    rows = inst.join(count(now, "n_now"), "institution_id", "left").join(count(before, "n_before"), "institution_id", "left").fillna({"n_now": 0, "n_before": 0})
    fetched = cards.first_true([((F.col("parser_name") == "generic") & (F.col("coverage_status") == "Unverified"), "manual"), (F.coalesce("career_page_url_guess", F.lit("")) == "", "no-url"), (F.col("coverage_status") == "Blocked", "robots-blocked")], "ok")
    state = sweep.outcome(fetched, F.lit(False), F.col("n_now"), F.col("n_before"), F.col("parser_name") == "rolling")
    return rows.select("institution_id", state.alias("outcome"), F.col("n_now").alias("ads_found"))


_SOURCES = [Rule("rolling call", "rolling"), Rule("document", "pdf"), Rule("feed", "json|mail"), Rule("page", "html|table")]
_CONTRACTS = {"Regular": "permanent", "TenureTrack": "permanent", "Contractual": "contract", "Guest": "visiting", "Visiting": "visiting"}


@query(f"""WITH {_LATEST} SELECT source, contract, count(*) AS n FROM (SELECT CASE {" ".join(f"WHEN regexp_matches(_source_method, '(?i){r.pattern}') THEN '{r.label}'" for r in _SOURCES)} ELSE 'other' END AS source,
CASE contract_status {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CONTRACTS.items())} END AS contract FROM ads) GROUP BY ALL""")
def source_labels(spark: SparkSession, root: str) -> DataFrame:
    contract = cards.first_true([(F.col("contract_status") == k, v) for k, v in _CONTRACTS.items()], None)
    marks = table(spark, root, "job_ads").withColumns({"source": first_match(F.col("_source_method"), _SOURCES, F.lit("other")), "contract": contract})
    return latest(marks, "source", "contract").groupBy("source", "contract").agg(F.count("*").alias("n"))


@query("""SELECT promoted, css, count(*) AS n FROM (SELECT CASE WHEN coverage_status = 'Blocked' THEN 'blocked' WHEN coalesce(career_page_url_guess, '') = '' THEN 'missing' WHEN coverage_status = 'Unverified' AND parser_name NOT IN ('generic', 'manual') THEN 'candidate' ELSE lower(coverage_status) END AS promoted,
CASE WHEN coverage_status = 'Working' THEN 'ok' WHEN coverage_status IN ('Partial', 'Unverified') THEN 'soft' ELSE 'error' END AS css FROM institutions) GROUP BY ALL""")
def registry_promotion(spark: SparkSession, root: str) -> DataFrame:
    c = F.col("coverage_status")
    promoted = cards.first_true([(c == "Blocked", "blocked"), (F.coalesce("career_page_url_guess", F.lit("")) == "", "missing"), ((c == "Unverified") & ~F.col("parser_name").isin("generic", "manual"), "candidate")], F.lower(c))
    css = cards.first_true([(c == "Working", "ok"), (c.isin("Partial", "Unverified"), "soft")], "error")
    return table(spark, root, "institutions").groupBy(promoted.alias("promoted"), css.alias("css")).agg(F.count("*").alias("n"))


@query(f"""WITH {_LATEST} SELECT route, count(*) AS n FROM (SELECT CASE WHEN i.city IS NOT NULL AND contains(lower(coalesce(raw_text_excerpt, '')), lower(i.city)) THEN i.id || '::' || i.city ELSE i.id END AS route FROM ads a JOIN institutions i ON a.institution_id = i.id) GROUP BY route""")
def campus_routes(spark: SparkSession, root: str) -> DataFrame:
    inst = table(spark, root, "institutions").select(F.col("id").alias("institution_id"), "city")
    here = F.lower(F.coalesce("raw_text_excerpt", F.lit(""))).contains(F.lower("city"))
    route = F.when(F.coalesce(here, F.lit(False)), F.concat_ws("::", "institution_id", "city")).otherwise(F.col("institution_id"))
    ads = latest(table(spark, root, "job_ads").join(inst, "institution_id").withColumn("route", route), "route")
    # An institution joins to one row, so the latest delivery of an ad keeps its route.
    return ads.groupBy("route").agg(F.count("*").alias("n"))


_UNIT = f"trim(regexp_replace(regexp_replace(trim(regexp_replace(trim(coalesce(department, '')), '\\s+', ' ', 'g')), '(?i){_q(cards.UNIT_BEFORE)}', ''), '(?i){_q(cards.UNIT_AFTER)}', ''))"


@query(f"""WITH {_LATEST}, u AS (SELECT nullif(CASE lower({_UNIT}) WHEN 'maths' THEN 'Mathematics' WHEN 'cse' THEN 'Computer Science' ELSE {_UNIT} END, '') AS own,
nullif(trim(regexp_extract(coalesce(title, ''), '\\(([^()]{{3,60}})\\)\\s*$', 1)), '') AS a, nullif(trim(regexp_extract(coalesce(title, ''), '\\b[Ii]n\\s+([A-Z][^()]{{2,60}})$', 1)), '') AS b, discipline FROM ads)
SELECT coalesce(own, a, b, nullif(trim(discipline), ''), 'unknown') AS unit, count(*) AS n FROM u GROUP BY 1""")
def unit_labels(spark: SparkSession, root: str) -> DataFrame:
    d = F.trim("discipline")
    unit = F.coalesce(cards.unit_name(F.col("department"), {"maths": "Mathematics", "cse": "Computer Science"}), cards.unit_from_title(F.col("title")), F.when(d != "", d), F.lit("unknown"))
    return latest(table(spark, root, "job_ads").withColumn("unit", unit), "unit").groupBy("unit").agg(F.count("*").alias("n"))


_HEAD = "trim(regexp_replace(coalesce(title, ''), '^(?:Recruitment|Appointment) of\\s+', ''))"


@query(f"""WITH {_LATEST} SELECT id, trim(regexp_extract({_HEAD}, '^(.*?)(?:\\s+in\\s+|\\s*\\(|$)', 1)) AS rank, trim(regexp_replace(regexp_extract({_HEAD}, '(?:\\s+in\\s+|\\s*\\()(.*)$', 1), '\\)\\s*$', '')) AS rest,
concat_ws(' · ', CASE WHEN trim(department) <> '' AND NOT contains(lower(coalesce(title, '')), lower(trim(department))) THEN trim(department) END, CASE WHEN trim(discipline) <> '' AND NOT contains(lower(coalesce(title, '')), lower(trim(discipline))) THEN trim(discipline) END) AS meta FROM ads""")
def headline_parts(spark: SparkSession, root: str) -> DataFrame:
    rank, rest = cards.headline(F.col("title"))
    return latest_ads(spark, root, "title", "department", "discipline").select("id", rank.alias("rank"), rest.alias("rest"), cards.meta_parts(F.col("title"), [F.col("department"), F.col("discipline")]).alias("meta"))


@query("""SELECT doc_id, len(items) AS n_items, array_to_string(items, '|') AS items FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '(?m)^[ \\t]*\\d{1,2}[.)][ \\t]+([^\\r\\n]{3,80})$', 1), lambda x: trim(x)), lambda x: NOT regexp_matches(lower(x), '^(?:apply|send|submit|attach|enclose|write|see)\\b'))[1:20] AS items FROM documents) WHERE len(items) > 0""")
def numbered_items(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", cards.numbered_items(F.col("text")).alias("items")).where(F.size("items") > 0)
    return docs.select("doc_id", F.size("items").alias("n_items"), F.array_join("items", "|").alias("items"))


@query(f"WITH {_LATEST} SELECT id, " + ", ".join(f"nullif(trim(regexp_extract(coalesce(raw_text_excerpt, ''), '{_q(p)}', 1)), '') AS {n}" for n, p in cards.CUES.items()) + " FROM ads")
def text_cues(spark: SparkSession, root: str) -> DataFrame:
    marks = table(spark, root, "job_ads").withColumns({n: cards.cue(F.col("raw_text_excerpt"), n) for n in cards.CUES})
    return latest(marks, *cards.CUES).select("id", *cards.CUES)


_STEPS = "shortlist|interview|seminar|written test|selection committee"


@query(f"""WITH {_LATEST} SELECT id, array_to_string(list_filter(list_transform(string_split_regex(coalesce(raw_text_excerpt, ''), '[.\\r\\n]+\\s*'), lambda p: trim(p)), lambda p: regexp_matches(p, '(?i){_STEPS}'))[1:2], '; ') AS evaluation FROM ads""")
def evaluation_summaries(spark: SparkSession, root: str) -> DataFrame:
    return latest(table(spark, root, "job_ads").withColumn("evaluation", cards.statements(F.col("raw_text_excerpt"), _STEPS)), "evaluation").select("id", "evaluation")


_RANKS = "list_filter(coalesce(structured_position.ranks, []), lambda r: r IS NOT NULL)"


@query(f"WITH {_LATEST} SELECT line, count(*) AS n FROM (SELECT CASE WHEN len({_RANKS}) = 0 THEN post_type WHEN len({_RANKS}) = 1 THEN {_RANKS}[1] ELSE {_RANKS}[1] || ' and ' || (len({_RANKS}) - 1) || ' more' END AS line FROM ads) GROUP BY line")
def rank_lines(spark: SparkSession, root: str) -> DataFrame:
    ranks = F.filter(F.coalesce(F.col("structured_position.ranks"), F.array().cast("array<string>")), lambda r: r.isNotNull())
    n, first = F.size(ranks), F.try_element_at(ranks, F.lit(1))
    line = F.when(n == 0, F.col("post_type")).when(n == 1, first).otherwise(F.concat(first, F.lit(" and "), (n - 1).cast("string"), F.lit(" more")))
    return latest(table(spark, root, "job_ads").withColumn("line", line), "line").groupBy("line").agg(F.count("*").alias("n"))


_STOP = ", ".join(f"'{w}'" for w in sorted(text.STOPWORDS))


def _words(x: str) -> str:
    return f"list_distinct(list_filter(string_split(trim(regexp_replace(replace(lower(coalesce({x}, '')), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' '), lambda v: length(v) > 1 AND v NOT IN ({_STOP})))"


@query(f"WITH {_LATEST} SELECT id, round(len(list_intersect({_words('title')}, {_words('raw_text_excerpt')})) / len({_words('title')}), 6) AS overlap FROM ads WHERE len({_words('title')}) > 0 AND length(raw_text_excerpt) <= 220")
def circular_excerpts(spark: SparkSession, root: str) -> DataFrame:
    """How much of its title a short excerpt repeats."""
    share = F.round(text.overlap_share(F.col("raw_text_excerpt"), F.col("title")), 6)
    marks = latest(table(spark, root, "job_ads").withColumns({"overlap": share, "size": F.length("raw_text_excerpt")}), "overlap", "size")
    return marks.where("overlap is not null and size <= 220").select("id", "overlap")


_HOST = "regexp_extract(lower(trim(coalesce(url, ''))), '^https?://(?:[^/@?#]*@)?([^/:?#]+)', 1)"


@query(f"""SELECT public, count(*) AS n FROM (SELECT {_HOST} <> '' AND NOT regexp_matches({_HOST}, '^(?:localhost|.*\\.local|.*\\.internal)$|^(?:0|10|127)\\.|^169\\.254\\.|^172\\.(?:1[6-9]|2[0-9]|3[01])\\.|^192\\.168\\.|^(?:22[4-9]|23[0-9]|24[0-9]|25[0-5])\\.|^\\[') AS public FROM documents) GROUP BY public""")
def public_addresses(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").groupBy(cards.public_address(F.col("url")).alias("public")).agg(F.count("*").alias("n"))


_KINDS = {"NationalInstitute": "national", "StateUniversity": "state", "CentralUniversity": "central", "Private": "private"}


@query(f"WITH {_LATEST} SELECT CASE i.inst_type {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in _KINDS.items())} ELSE lower(i.inst_type) END AS label, count(*) AS n FROM ads a JOIN institutions i ON a.institution_id = i.id GROUP BY 1")
def type_labels(spark: SparkSession, root: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
    inst = table(spark, root, "institutions").select(F.col("id").alias("institution_id"), F.coalesce(names[F.col("inst_type")], F.lower("inst_type")).alias("label"))
    return latest_ads(spark, root, "institution_id").join(inst, "institution_id").groupBy("label").agg(F.count("*").alias("n"))


_NOTES = f"list_filter(string_split_regex(regexp_replace(x, '\\s+', ' ', 'g'), '\\.\\s'), lambda p: regexp_matches(p, '{fields.RESERVED_PERCENT}'))[1]"


@query(f"""SELECT source, trim({_NOTES}) AS note, count(*) AS n FROM (SELECT 'documents' AS source, text AS x FROM documents UNION ALL SELECT 'positions', qualifications_text FROM extracted_positions UNION ALL SELECT 'ads', pdf_excerpt FROM job_ads)
WHERE {_NOTES} IS NOT NULL GROUP BY ALL""")
def reservation_notes(spark: SparkSession, root: str) -> DataFrame:
    parts = [("documents", "documents", "text"), ("positions", "extracted_positions", "qualifications_text"), ("ads", "job_ads", "pdf_excerpt")]
    rows = [table(spark, root, t).select(F.lit(n).alias("source"), fields.reservation_note(F.col(c)).alias("note")) for n, t, c in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).where("note is not null").groupBy("source", "note").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN regexp_matches(coalesce(original_url, ''), '(?i)\\.pdf(?:$|[?#])') THEN 'document' WHEN original_url IS NULL THEN 'none' ELSE 'page' END AS link, count(*) AS n FROM job_ads GROUP BY 1")
def link_labels(spark: SparkSession, root: str) -> DataFrame:
    u = F.col("original_url")
    return table(spark, root, "job_ads").groupBy(cards.first_true([(urls.is_pdf_url(u), "document"), (u.isNull(), "none")], "page").alias("link")).agg(F.count("*").alias("n"))


@query(f"WITH {_LATEST} SELECT row_number() OVER (ORDER BY coalesce(date_diff('day', DATE '{AS_OF}', closing_date), 9999), id) AS rank, id FROM ads ORDER BY rank LIMIT 25")
def saved_page(spark: SparkSession, root: str) -> DataFrame:
    """The first page of a saved list: days left ascending, past days first, without a date last."""
    days = F.coalesce(F.datediff("closing_date", F.lit(AS_OF)), F.lit(9999))
    return ranking.top_rows(latest_ads(spark, root, "closing_date").select("id", days.alias("days")), [F.col("days"), F.col("id")], 25).select("rank", "id")


@query("SELECT inst_type AS value, row_number() OVER (ORDER BY CASE inst_type WHEN 'CentralUniversity' THEN 0 WHEN 'NationalInstitute' THEN 1 ELSE 2 END, inst_type) AS place FROM (SELECT DISTINCT inst_type FROM institutions WHERE inst_type IS NOT NULL)")
def facet_options(spark: SparkSession, root: str) -> DataFrame:
    """The values of a facet, pinned ones first, then by name; one row for each value of a registry."""
    pinned = F.array_position(F.array(F.lit("CentralUniversity"), F.lit("NationalInstitute")), F.col("value"))
    values = table(spark, root, "institutions").select(F.col("inst_type").alias("value")).where("value is not null").distinct()
    return ranking.top_rows(values, [F.when(pinned == 0, 9).otherwise(pinned), F.col("value")], 1000).select("value", F.col("rank").alias("place"))
