"""The queries of problems 1-6 and 8-10, and their SQL where SQL can state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.llm import canonical, encoding, near_duplicates, packing, residue, scan_noise, spam, subjects, truncation
from noticeworks.storage import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return scan_noise.noise_kinds(scan_noise.scanned_texts(table(spark, root, "job_ads"), table(spark, root, "extracted_positions")))


def p1_repaired(spark: SparkSession, root: str) -> DataFrame:
    """Every scanned field in continuous paragraphs."""
    texts = scan_noise.scanned_texts(table(spark, root, "job_ads"), table(spark, root, "extracted_positions"))
    return scan_noise.repair_texts(texts).select("table_name", "rec_key", "field_name", "repaired").distinct()


def _residue(spark: SparkSession, root: str) -> DataFrame:
    return residue.residue(residue.vacancy_texts(table(spark, root, "job_ads"), table(spark, root, "extracted_positions")))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return _residue(spark, root).select("table_name", "rec_key").distinct()


def p2_kinds(spark: SparkSession, root: str) -> DataFrame:
    """The number of records with each kind of residue."""
    return _residue(spark, root).groupBy("table_name", "kind").agg(F.count("*").alias("n_records"))


def p2_clean_ads(spark: SparkSession, root: str) -> DataFrame:
    """The ids of the ads that stay when residue is set aside."""
    found = _residue(spark, root).where("table_name = 'job_ads'").select(F.col("rec_key").alias("id"))
    return table(spark, root, "job_ads").select("id").where("id is not null").distinct().join(found, "id", "left_anti")


def _mapped(spark: SparkSession, root: str) -> DataFrame:
    names = table(spark, root, "canonical_names")
    return canonical.map_to_canonical(canonical.typed_values(table(spark, root, "job_ads"), ["department", "discipline"]), names)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    names = table(spark, root, "canonical_names").select("field_name", F.col("canonical_name").alias("value")).distinct()
    return _mapped(spark, root).join(names, ["field_name", "value"], "left_anti").select("ad_id", "field_name", "ref_id")


def p3_misses(spark: SparkSession, root: str) -> DataFrame:
    """The typed values that the reference list lacks, by the number of ads."""
    return _mapped(spark, root).where("ref_id = 0").groupBy("field_name", "value").agg(F.count("*").alias("n_ads"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return truncation.cut_texts(table(spark, root, "job_ads"))


def p4_cut_shares(spark: SparkSession, root: str) -> DataFrame:
    """The share of cut texts of each source and field."""
    return truncation.cut_shares(table(spark, root, "job_ads"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return subjects.ad_subjects(table(spark, root, "job_ads"), table(spark, root, "extracted_positions"), table(spark, root, "subject_labels"), table(spark, root, "canonical_names"))


def p5_composition(spark: SparkSession, root: str) -> DataFrame:
    """The number of ads of each subject, and their share of all ads."""
    total = table(spark, root, "job_ads").where("id is not null").agg(F.count_distinct("id")).first()[0]
    return p5_found(spark, root).groupBy("subject_code").agg(F.count("*").alias("n_ads")).withColumn("share", F.round(F.col("n_ads") / F.lit(max(1, total)), 6))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return near_duplicates.similar_ads(table(spark, root, "job_ads")).select("ad_id_a", "ad_id_b")


def p6_groups(spark: SparkSession, root: str) -> DataFrame:
    """Every ad of a group with the group's id and its number of links."""
    return near_duplicates.ad_groups(table(spark, root, "job_ads"))


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, root, "documents"))


def p8_decoded(spark: SparkSession, root: str) -> DataFrame:
    """The corpus encoded and decoded again."""
    return encoding.decode_corpus(p8_ids(spark, root))


def _packed(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    packs = table(spark, root, "pack_sizes")
    return packing.pack(encoding.token_counts(table(spark, root, "documents")), packs), packs


def p9_containers(spark: SparkSession, root: str) -> DataFrame:
    return _packed(spark, root)[0]


def p9_fill(spark: SparkSession, root: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return packing.fill_report(*_packed(spark, root))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return spam.spam_pages(table(spark, root, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_repaired, p2_found, p2_kinds, p2_clean_ads, p3_found, p3_misses, p4_found, p4_cut_shares, p5_found, p5_composition,
        p6_found, p6_groups, p8_ids, p8_decoded, p9_containers, p9_fill, p10_found,
    )
}

ORACLE = {
    "p6_found": r"""
WITH ads AS (
  SELECT id, institution_id, w, list_distinct(list_concat(w, regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+'))) AS bag FROM (
    SELECT id, institution_id, title, list_distinct(regexp_extract_all(lower(raw_text_excerpt), '[a-z0-9]+')) AS w,
           row_number() OVER (PARTITION BY id ORDER BY snapshot_fetched_at DESC) AS rn
    FROM job_ads WHERE institution_id IS NOT NULL AND raw_text_excerpt IS NOT NULL) WHERE rn = 1 AND len(w) >= 60
)
SELECT a.id AS ad_id_a, b.id AS ad_id_b FROM ads a JOIN ads b ON a.institution_id = b.institution_id AND a.id < b.id
WHERE len(list_intersect(a.bag, b.bag)) >= 0.75 * (len(a.bag) + len(b.bag) - len(list_intersect(a.bag, b.bag)))""",
    "p6_groups": r"""
WITH RECURSIVE ads AS (
  SELECT id, institution_id, list_sort(list_distinct(list_concat(w, regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+')))) AS bag FROM (
    SELECT id, institution_id, title, list_distinct(regexp_extract_all(lower(raw_text_excerpt), '[a-z0-9]+')) AS w, row_number() OVER (PARTITION BY id ORDER BY snapshot_fetched_at DESC) AS rn
    FROM job_ads WHERE institution_id IS NOT NULL AND raw_text_excerpt IS NOT NULL) WHERE rn = 1 AND len(w) >= 60
), sets AS (SELECT institution_id, bag, row_number() OVER (ORDER BY institution_id, bag) AS s FROM (SELECT DISTINCT institution_id, bag FROM ads)),
m AS (SELECT ads.id AS ad_id, s FROM ads JOIN sets ON ads.institution_id = sets.institution_id AND ads.bag = sets.bag),
e AS (SELECT a.s AS a, b.s AS b FROM sets a JOIN sets b ON a.institution_id = b.institution_id AND a.s <> b.s WHERE len(list_intersect(a.bag, b.bag)) >= 0.75 * (len(a.bag) + len(b.bag) - len(list_intersect(a.bag, b.bag)))),
r(s, t) AS (SELECT s, s FROM sets UNION SELECT r.s, e.b FROM r JOIN e ON r.t = e.a), c AS (SELECT s, min(t) AS g FROM r GROUP BY s), n AS (SELECT a AS s, count(*) AS n_links FROM e GROUP BY a),
named AS (SELECT g, min(ad_id) AS group_id FROM m JOIN c ON m.s = c.s GROUP BY g HAVING count(*) > 1)
SELECT ad_id, group_id, coalesce(n_links, 0) AS n_links FROM m JOIN c ON m.s = c.s JOIN named ON c.g = named.g LEFT JOIN n ON m.s = n.s""",
    "p8_decoded": "SELECT doc_id, text FROM documents",
}
