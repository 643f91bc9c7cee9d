"""Analyses: shares, pivots, cubes, indices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The statutory share of each category, in per cent.
MANDATE = {"ur": 40.5, "obc": 27.0, "sc": 15.0, "st": 7.5, "ews": 10.0}


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Half-up percentage; null if there is no whole."""
    return F.when(whole > 0, F.round(part * F.lit(100.0) / whole, digits))


def volume(rows: DataFrame, row: Column, column: str, values: Sequence[str], name: str = "year") -> DataFrame:
    """Counts pivoted on fixed values, 0 where none; rows with other values still appear."""
    kept = rows.select(row.alias(name), F.col(column)).where(F.col(name).isNotNull())
    return kept.groupBy(name).agg(*[F.count_if(F.col(column) == v).alias(f"n_{v.lower()}") for v in values], F.count("*").alias("n_all"))


def flag_shares(rows: DataFrame, group: Column, flags: dict[str, Column], name: str = "year") -> DataFrame:
    """For each group the number of rows and the percentage with each flag."""
    kept = rows.select(group.alias(name), *[F.coalesce(f, F.lit(False)).alias(k) for k, f in flags.items()]).where(F.col(name).isNotNull())
    return kept.groupBy(name).agg(F.count("*").alias("n"), *[percent(F.count_if(k), F.count("*")).alias(f"pct_{k}") for k in flags])


def category_rows(rows: DataFrame, breakdown: str, keep: Sequence[str]) -> DataFrame:
    """(…, category, posts): the six counts of a breakdown as rows, those not given left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"{breakdown}.{c}").alias("posts")) for c in ("ur", "sc", "st", "obc", "ews", "pwbd")])
    return rows.select(*keep, F.explode(pairs).alias("_c")).select(*keep, "_c.category", "_c.posts").where("posts is not null")


def cube_totals(rows: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Sums by (a, b) with row, column and grand totals, where a total's key is 'all'."""
    out = rows.groupingSets([[F.col(a), F.col(b)], [F.col(a)], [F.col(b)], []], F.col(a), F.col(b)).agg(F.sum(value).cast("long").alias("total"), F.grouping(a).alias("_ga"), F.grouping(b).alias("_gb"))
    return out.select(F.when(F.col("_ga") == 1, "all").otherwise(F.col(a)).alias(a), F.when(F.col("_gb") == 1, "all").otherwise(F.col(b)).alias(b), "total")


def mandate_gap(rows: DataFrame, mandate: dict[str, float] = MANDATE) -> DataFrame:
    """(category, posts, share, target, index, band): the share of posts in each category against its target.

    index is share by target in per cent; band is 'over' above 110, 'severe' below
    50, 'under' below 90, else 'met'.
    """
    named = F.coalesce(*[F.when(F.col("category") == c, F.lit(t)) for c, t in mandate.items()])
    sums = rows.where(F.col("category").isin(*mandate)).groupBy("category").agg(F.sum("posts").cast("long").alias("posts"))
    total = sums.agg(F.sum("posts")).first()[0] or 1
    share = F.col("posts") * 100.0 / F.lit(total)
    index = share / named * 100.0
    band = F.when(index > 110, "over").when(index < 50, "severe").when(index < 90, "under").otherwise("met")
    return sums.select("category", "posts", F.round(share, 3).alias("share"), named.alias("target"), F.round(index, 3).alias("index"), band.alias("band"))


def stacked(rows: DataFrame, group: str, part: str) -> DataFrame:
    """(group, part, n, group_total, share): counts with the group's total, totals by aggregation."""
    n = rows.where(F.col(group).isNotNull()).groupBy(group, part).agg(F.count("*").alias("n"))
    total = n.groupBy(group).agg(F.sum("n").alias("group_total"))
    return n.join(total, group).withColumn("share", F.round(F.col("n") / F.col("group_total"), 6))


def argmax_rows(rows: DataFrame, group: str, value: str, label: str) -> DataFrame:
    """(group, label, value) of each group's greatest value, the least label of equals."""
    best = rows.groupBy(group).agg(F.min(F.struct((-F.col(value)).alias("v"), F.col(label).alias("l"))).alias("b"))
    return best.select(group, F.col("b.l").alias(label), (-F.col("b.v")).alias(value))


def ratio_to(rows: DataFrame, name: str, value: str, reference: str) -> DataFrame:
    """Rows ordered by value with their ratio to the reference row."""
    base = rows.where(F.col(name) == reference).agg(F.max(value)).first()[0]
    return rows.select(name, value, F.round(F.col(value) / F.lit(base), 6).alias("ratio"))
