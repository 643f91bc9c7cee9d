"""Change detection between consecutive full snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tidy_text(value: Column) -> Column:
    """Trimmed, whitespace runs as one space, case kept."""
    return F.trim(F.regexp_replace(value, r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " "))


def row_hash(columns: Sequence[Column]) -> Column:
    """96 bits over the columns in order; null differs from every value, '' included."""
    parts = [p for c in columns for p in (F.coalesce(c.cast("string"), F.lit("")), c.isNull())]
    return F.struct(F.xxhash64(*parts).alias("hi"), F.hash(*parts).alias("lo"))


def snapshot_changes(
    deliveries: DataFrame,
    *,
    key: str = "id",
    snapshot: str = "snapshot_date",
    read_at: str = "fetched_at",
    compared: dict[str, Column] | None = None,
) -> DataFrame:
    """Keys added, removed or changed from each snapshot to the next.

    Returns (snapshot, key, change_kind): the later of two neighbouring snapshot
    values that occur, and 'added', 'removed' or 'changed'. The state of a key in
    a snapshot is its row with the latest ``read_at``; rows with equal ``read_at``
    are ordered by their hash, so repeated rows and ties give one defined state.

    Plan: the rows shrink to (snapshot, key, read_at, hash) in the scan, partial
    aggregation runs before the only shuffle by (snapshot, key), and a full outer
    join compares hashes. A key repeated in a third of all rows collapses map-side.

    Defined cases: a null key or snapshot has no identity and gives no row; null
    compared values are values; a null ``read_at`` loses to any other; an empty
    table or a single snapshot gives no rows; extra columns are ignored.
    """
    compared = compared or {"title": tidy_text(F.col("title")), "closing_date": F.col("closing_date")}
    slim = deliveries.select(
        F.col(snapshot).alias("_snap"), F.col(key).alias("_key"), F.col(read_at).alias("_read"), row_hash(list(compared.values())).alias("_hash")
    ).where(F.col("_snap").isNotNull() & F.col("_key").isNotNull())
    states = slim.groupBy("_snap", "_key").agg(F.max(F.struct("_read", "_hash"))["_hash"].alias("_hash"))
    # One row for each snapshot value: at most one a day, so bounded by the calendar.
    order = Window.orderBy("_snap")
    steps = slim.select("_snap").distinct().select("_snap", F.lead("_snap").over(order).alias("_next"), F.lag("_snap").over(order).alias("_prev"))
    before = states.join(F.broadcast(steps.where("_next is not null")), "_snap").select(
        F.col("_next").alias("_snap"), "_key", F.col("_hash").alias("_old")
    )
    after = states.join(F.broadcast(steps.where("_prev is not null").select("_snap")), "_snap").select("_snap", "_key", F.col("_hash").alias("_new"))
    kind = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    )
    return (
        before.join(after, ["_snap", "_key"], "full_outer")
        .select(F.col("_snap").alias(snapshot), F.col("_key").alias(key), kind.alias("change_kind"))
        .where("change_kind is not null")
    )
