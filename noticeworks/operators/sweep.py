"""Keeping the last good state: outcomes of a sweep, carry-forward, targeted replacement, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Outcomes that count as a success.
SUCCESSES = ["ok", "rolling-stub", "stale-carried"]
#: Outcomes in the order in which they are listed, worst first.
SEVERITY = ["error", "http-error", "network-error", "robots-blocked"]


def carry_forward(current: DataFrame, previous: DataFrame, key: str, flag: str = "carried") -> DataFrame:
    """Current rows, and the previous rows of every key that has none now."""
    missing = previous.join(current.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").where(F.col(key).isNotNull())
    return current.withColumn(flag, F.lit(False)).unionByName(missing.withColumn(flag, F.lit(True)), allowMissingColumns=True)


def replace_keys(old: DataFrame, new: DataFrame, targets: DataFrame, key: str, seq: str) -> DataFrame:
    """Rows of target keys replaced, the order kept: (old columns, slot).

    All new rows of a target take the slot of its first old row; targets without old
    rows come after all others, by key. Order by slot, then ``seq``.
    """
    keys = targets.select(key).where(F.col(key).isNotNull()).distinct()
    kept = old.join(keys, key, "left_anti").withColumn("slot", F.col(seq).cast("long")).withColumn("late_key", F.lit(None).cast("string"))
    first = old.join(keys, key, "left_semi").groupBy(key).agg(F.min(seq).alias("slot"))
    fresh = new.join(keys, key, "left_semi").join(first, key, "left").select(*old.columns, F.col("slot").cast("long").alias("slot"), F.when(F.col("slot").isNull(), F.col(key).cast("string")).alias("late_key"))
    return kept.unionByName(fresh)


def outcome(fetched: Column, has_page: Column, n_found: Column, n_previous: Column, has_fallback: Column) -> Column:
    """What became of a source, the first case that holds: found ads, an unreadable page with a fallback, kept ads, nothing."""
    served = (fetched == "ok") | ((fetched == "http-error") & has_page)
    return (
        F.when(fetched == "manual", "manual")
        .when(served & (n_found > 0), "ok")
        .when(has_fallback, "rolling-stub")
        .when(n_previous > 0, "stale-carried")
        .when(served, "ok-empty")
        .otherwise(fetched)
    )


def coverage(registry: DataFrame, ads: DataFrame, key: str = "institution_id") -> DataFrame:
    """One row for each registered source: number of ads, last time read, and status."""
    counts = ads.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct("id").alias("ads_found"), F.max("snapshot_fetched_at").alias("last_read"))
    rows = registry.select(F.col("id").alias(key), "coverage_status", F.col("career_page_url_guess").alias("page")).join(counts, key, "left")
    n = F.coalesce("ads_found", F.lit(0))
    status = F.when(n > 0, "ok").when(F.col("page").isNull() | (F.col("page") == ""), "no-url").otherwise("empty")
    return rows.select(key, "coverage_status", n.alias("ads_found"), "last_read", status.alias("status"))


def coverage_summary(rows: DataFrame, good: Sequence[str] = ("ok",)) -> DataFrame:
    """(attempted, succeeded, with_ads, ads_total) in one row."""
    return rows.agg(
        F.count("*").alias("attempted"), F.count_if(F.col("status").isin(*good)).alias("succeeded"), F.count_if(F.col("ads_found") > 0).alias("with_ads"), F.coalesce(F.sum("ads_found"), F.lit(0)).alias("ads_total")
    )


def severity(status: Column, order: Sequence[str]) -> Column:
    """The place of a status in ``order``, unknown ones last."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), status)
    return F.when(place > 0, place - 1).otherwise(len(order))


def fresh_or_stale(log: DataFrame, url: str, read_at: str, ok: Column, now: Column, ttl_hours: int) -> DataFrame:
    """The latest good reading of each address, flagged stale once it is older than its time to live."""
    good = log.where(ok)
    latest = good.groupBy(url).agg(F.max(read_at).alias(read_at))
    return latest.withColumn("stale", F.col(read_at) < now - F.expr(f"INTERVAL {ttl_hours} HOURS"))


def not_done(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is left to do."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")
