"""Checks as rows: (rule, record, message); a gate passes when its errors are none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.functions.urls import safe_link

UNSAFE = r"(?i)<\s*script\b|javascript\s*:|\bon(?:error|load|click)\s*="


def row_rules(rows: DataFrame, record: Column, rules: dict[str, Column]) -> DataFrame:
    """(rule, record, n): the rows that break each rule, all rules in one scan. A rule is the condition that is wrong."""
    broken = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules.items()]), lambda x: x.isNotNull())
    return rows.select(F.coalesce(record.cast("string"), F.lit("<missing>")).alias("record"), F.explode(broken).alias("rule")).groupBy("rule", "record").agg(F.count("*").alias("n"))


def ad_rules(urls: list[str], texts: list[str]) -> dict[str, Column]:
    """What is wrong with an ad by itself."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    unsafe_url = reduce(lambda a, b: a | b, [F.col(u).isNotNull() & (F.trim(u) != "") & (safe_link(F.col(u)) == "") for u in urls])
    unsafe_text = reduce(lambda a, b: a | b, [F.coalesce(F.col(t).rlike(UNSAFE), F.lit(False)) for t in texts])
    return {
        "missing id": blank("id"),
        "missing institution": blank("institution_id"),
        "missing title": blank("title"),
        "unsafe url": unsafe_url,
        "unsafe text": unsafe_text,
        "confidence out of range": ~F.col("parse_confidence").between(0, 1),
        "closes before it opens": F.col("closing_date") < F.col("publication_date"),
    }


def orphans(rows: DataFrame, key: str, table: DataFrame, table_key: str, record: str, rule: str) -> DataFrame:
    """(rule, record, n) of the rows whose key the table lacks; null keys are another rule's."""
    lost = rows.where(F.col(key).isNotNull()).join(table.select(F.col(table_key).alias(key)).distinct(), key, "left_anti")
    return lost.groupBy(F.col(record).cast("string").alias("record")).agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "record", "n")


def duplicate_keys(rows: DataFrame, key: str, rule: str = "duplicate id") -> DataFrame:
    """(rule, record, n): keys given more than once; n counts those after the first."""
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("record")).agg((F.count("*") - 1).alias("n")).where("n > 0").select(F.lit(rule).alias("rule"), "record", "n")


def volume_drop(now: int, before: int | None, most: float = 0.2) -> bool:
    """True if a feed shrank by more than the share allowed."""
    return bool(before) and now < before * (1 - most)


def split_valid(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) rows; the invalid ones with the list of broken rules."""
    marked = rows.withColumn("broken", F.filter(F.array(*[F.when(F.coalesce(b, F.lit(False)), n) for n, b in rules.items()]), lambda x: x.isNotNull()))
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)


def whole_groups(rows: DataFrame, group: str, bad: Column) -> DataFrame:
    """The rows of groups without any bad row: one bad row rejects its whole file."""
    spoiled = rows.where(F.coalesce(bad, F.lit(True))).select(group).distinct()
    return rows.join(spoiled, group, "left_anti")
