"""Choosing rows within groups: best, first, last, peers, islands, retention."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group by ``order``, which should end in a unique column."""
    name = rank or "_rank"
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def last_wins(rows: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """Upsert: each key's row with the greatest ``seq``, and ``first_seq``, the place where the key was first inserted.

    Aggregates before the shuffle; a key in a third of all rows costs one row per task.
    """
    payload = [c for c in rows.columns if c not in keys and c not in seq]
    kept = rows.groupBy(*keys).agg(F.max(F.struct(*seq, *payload)).alias("_last"), F.min(F.struct(*seq)).alias("first_seq"))
    return kept.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in (*seq, *payload)], "first_seq")


def first_wins(rows: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """Ordered distinct: each key's row with the least ``seq``."""
    payload = [c for c in rows.columns if c not in keys and c not in seq]
    kept = rows.groupBy(*keys).agg(F.min(F.struct(*seq, *payload)).alias("_first"))
    return kept.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in (*seq, *payload)])


def with_margin(rows: DataFrame, keys: Sequence[str], score: str, ties: Sequence[Column]) -> DataFrame:
    """The best row of each group with ``margin``, its lead over the runner-up; null without one."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *ties)
    return rows.withColumns({"_rank": F.row_number().over(w), "_next": F.lead(score).over(w)}).where("_rank = 1").withColumn("margin", F.col(score) - F.col("_next")).drop("_rank", "_next")


def peer_count(rows: DataFrame, key: str, name: str = "peers") -> DataFrame:
    """How many rows share the key; a null key has no peers.

    Counted by aggregation and joined back, not by a window, so that a key that a
    third of all rows share is never one task's group.
    """
    sizes = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name))
    return rows.join(sizes, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def repeats(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of the keys that occur more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def retained(days: DataFrame, as_of: date, *, day: str = "day", keep_days: int = 30, keep_weeks: int = 52) -> DataFrame:
    """(day, bucket, kept) of each distinct day: all recent ones, then the first of each ISO week, then of each quarter."""
    age = F.datediff(F.lit(as_of), day)
    d = days.select(day).distinct().where(F.col(day).isNotNull()).withColumn("bucket", F.when(age <= keep_days, "recent").when(age <= keep_weeks * 7, "weekly").otherwise("quarterly"))
    slot = F.when(F.col("bucket") == "weekly", F.expr(f"extract(YEAROFWEEK FROM {day}) * 100 + extract(WEEK FROM {day})")).when(F.col("bucket") == "quarterly", F.year(day) * 100 + F.quarter(day))
    first = F.row_number().over(Window.partitionBy("bucket", "_slot").orderBy(day)) == 1
    return d.withColumn("_slot", slot).withColumn("kept", (F.col("bucket") == "recent") | first).drop("_slot")


def islands(rows: DataFrame, groups: Sequence[str], order: Sequence[Column], changes: Column, name: str = "island") -> DataFrame:
    """Numbers the runs of rows within each group; a run starts where ``changes`` holds."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return rows.withColumn(name, F.sum(F.when(F.coalesce(changes, F.lit(True)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def cumulative(rows: DataFrame, groups: Sequence[str], order: Sequence[Column], value: str, name: str = "running") -> DataFrame:
    """Running sum and running share of the group's total."""
    w = Window.partitionBy(*groups)
    running = F.sum(value).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumns({name: running, f"{name}_share": running / F.sum(value).over(w)})


def densest(rows: DataFrame, groups: Sequence[str], position: str, near: int) -> DataFrame:
    """The position of each group after which most rows follow within ``near``, the first of equals."""
    ahead = F.count("*").over(Window.partitionBy(*groups).orderBy(position).rangeBetween(0, near))
    return best_per_group(rows.withColumn("n_near", ahead), groups, [F.col("n_near").desc(), F.col(position)])


def top_rows(rows: DataFrame, order: Sequence[Column], n: int, skip: int = 0) -> DataFrame:
    """A page of the sorted rows with their rank from 1: each task keeps skip + n rows, so no global sort takes place."""
    page = rows.orderBy(*order).limit(skip + n)
    return page.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") > skip)


def best_of_large(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, unique: str, rank: str, salts: int = 64) -> DataFrame:
    """``best_per_group`` for groups of any size: the best ``n`` of each of ``salts`` parts first, then of those."""
    part = F.pmod(F.xxhash64(unique), F.lit(salts))
    return best_per_group(best_per_group(rows.withColumn("_part", part), [*keys, "_part"], order, n).drop("_part"), keys, order, n, rank)
