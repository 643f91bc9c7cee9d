"""Problem 7: what changed between the deliveries of ad_snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.operators.snapshots import snapshot_changes
from noticeworks.storage import table


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    changes = snapshot_changes(table(spark, root, "ad_snapshots"))
    return changes.select(F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date"), F.col("id").alias("ad_id"), "change_kind")


def p7_change_counts(spark: SparkSession, root: str) -> DataFrame:
    """The number of changes of each kind in each snapshot."""
    return p7_found(spark, root).groupBy("snapshot_date", "change_kind").agg(F.count("*").alias("n_ads"))


_CHANGES = r"""
WITH latest AS (
  SELECT snapshot_date, id, trim(regexp_replace(title, '\s+', ' ', 'g')) AS title, closing_date,
         row_number() OVER (PARTITION BY snapshot_date, id ORDER BY fetched_at DESC NULLS LAST) AS rn
  FROM ad_snapshots WHERE id IS NOT NULL AND snapshot_date IS NOT NULL
), s AS (SELECT * FROM latest WHERE rn = 1),
d AS (SELECT snapshot_date, lead(snapshot_date) OVER (ORDER BY snapshot_date) AS nxt FROM (SELECT DISTINCT snapshot_date FROM s)),
old AS (SELECT d.nxt AS snapshot_date, s.id, s.title, s.closing_date FROM s JOIN d USING (snapshot_date) WHERE d.nxt IS NOT NULL),
new AS (SELECT s.* FROM s WHERE s.snapshot_date IN (SELECT nxt FROM d WHERE nxt IS NOT NULL)),
j AS (
  SELECT coalesce(old.snapshot_date, new.snapshot_date) AS snapshot_date, coalesce(old.id, new.id) AS ad_id,
         CASE WHEN old.id IS NULL THEN 'added' WHEN new.id IS NULL THEN 'removed'
              WHEN old.title IS DISTINCT FROM new.title OR old.closing_date IS DISTINCT FROM new.closing_date THEN 'changed' END AS change_kind
  FROM old FULL OUTER JOIN new ON old.snapshot_date = new.snapshot_date AND old.id = new.id
)
"""

QUERIES = {"p7_found": p7_found, "p7_change_counts": p7_change_counts}
ORACLE = {
    "p7_found": _CHANGES + "SELECT strftime(snapshot_date, '%Y-%m-%d') AS snapshot_date, ad_id, change_kind FROM j WHERE change_kind IS NOT NULL",
    "p7_change_counts": _CHANGES
    + "SELECT strftime(snapshot_date, '%Y-%m-%d') AS snapshot_date, change_kind, count(*) AS n_ads FROM j WHERE change_kind IS NOT NULL GROUP BY ALL",
}
