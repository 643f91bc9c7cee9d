"""Deterministic identity of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeworks.storage import spool


def stable_id(*parts: Column) -> Column:
    """First 16 hex digits of SHA-256 over the parts, each followed by a NUL; null counts as ''."""
    pieces = [x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("")), F.lit("\0"))]
    return F.substring(F.sha2(F.concat(*pieces), 256), 1, 16)


def unique_ids(rows: DataFrame, base: Column, order: list[Column], salt: list[Column], name: str = "uid", max_rounds: int = 20) -> DataFrame:
    """Adds a collision-free id: the base id for the first row of it by ``order``, a hash of base, salt and order for the others.

    The first row of each base is found by aggregation, so that a base that a third
    of all rows share is no task's group. Ids that are taken twice after that are
    hashed again with a counter until none is; only the rows in conflict take part.
    Rows equal in base and order are told apart by their row hash, equal rows by a
    counter. Ids that still collide after ``max_rounds`` raise an error.
    """
    place = F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], F.xxhash64(*[F.col(c).cast("string") for c in rows.columns]).alias("h"))
    tagged = rows.withColumns({"_base": F.coalesce(base, F.lit("")), "_place": place})
    first = tagged.groupBy("_base").agg(F.min("_place").alias("_first"))
    fresh = stable_id(F.col("_base"), *salt, *order)
    held = tagged.join(first, "_base").withColumn(name, F.when(F.col("_place") == F.col("_first"), F.col("_base")).otherwise(fresh)).withColumn("_row", F.monotonically_increasing_id())
    held = spool(held.drop("_first"), "ids")
    for attempt in range(1, max_rounds + 1):
        taken = held.groupBy(name).agg(F.count("*").alias("_n")).where("_n > 1").select(name)
        if taken.isEmpty():
            break
        rank = F.row_number().over(Window.partitionBy(name).orderBy(F.col("_base") != F.col(name), "_place", "_row"))
        clash = held.join(taken, name, "left_semi").withColumn("_k", rank)
        again = clash.withColumn(name, F.when(F.col("_k") > 1, stable_id(F.col("_base"), *salt, F.col("_k"), F.lit(attempt))).otherwise(F.col(name))).drop("_k")
        held = spool(held.join(taken, name, "left_anti").unionByName(again), "ids")
    else:
        raise RuntimeError(f"ids still collide after {max_rounds} rounds")
    return held.select(*rows.columns, name)
