"""JSON services and fetch logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeworks.functions.dates import to_date
from noticeworks.functions.text import slug
from noticeworks.ids import stable_id

PORTAL = "data array<struct<institution_id:string,institution:string,cadre:string,position_type:string,id:string,postNo:string,post:string,department:string,totalVacancies:string,startDate:string,closeDate:string>>"


def portal_ads(pages: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Ads of a portal's JSON answer (url, body, fetched_at): institutions by a name table, else by slug; ids by hash."""
    rows = pages.select("url", "fetched_at", F.explode(F.from_json("body", PORTAL)["data"]).alias("r")).select("url", "fetched_at", "r.*")
    known = F.create_map(*[F.lit(x) for kv in (names or {"": ""}).items() for x in kv])
    inst = F.coalesce(known[F.col("institution")], slug(F.col("institution")))
    return rows.select(
        stable_id(F.lit("portal"), F.col("id"), F.col("postNo"), inst).alias("id"), inst.alias("institution_id"), F.col("post").alias("title"), "department", F.col("postNo").alias("ad_number"),
        F.col("totalVacancies").try_cast("int").alias("number_of_posts"), to_date(F.col("startDate")).alias("publication_date"), to_date(F.col("closeDate")).alias("closing_date"), F.col("url").alias("original_url"), "fetched_at", F.lit(0.9).alias("parse_confidence"),
    )


def body_served(status: Column, body: Column) -> Column:
    """A page that can be parsed: read well, or an error page long enough to be a page."""
    return (status == "ok") | ((status == "http-error") & (F.length(body) > 2000))


def cached(log: DataFrame, now: Column, hours: int = 6) -> DataFrame:
    """The answer to use for each address: the latest good one within its time, else the latest good one at all (stale), else the latest failure."""
    age = (F.unix_timestamp(now) - F.unix_timestamp("fetched_at")) / 3600.0
    rank = F.when((F.col("status") == "ok") & (age <= hours), 0).when(F.col("status") == "ok", 1).otherwise(2)
    w = Window.partitionBy("url").orderBy("_rank", F.col("fetched_at").desc())
    return log.withColumn("_rank", rank).withColumn("_n", F.row_number().over(w)).where("_n = 1").withColumn("stale", F.col("_rank") == 1).drop("_rank", "_n")


def too_fast(log: DataFrame, seconds: float = 10.0, order: str | None = None) -> DataFrame:
    """Requests that came to a domain sooner than allowed after the one before; ``order`` parts those of one time."""
    before = F.lag("fetched_at").over(Window.partitionBy("domain").orderBy("fetched_at", *([order] if order else [])))
    gap = F.unix_micros(F.col("fetched_at").cast("timestamp")) / 1e6 - F.unix_micros(before.cast("timestamp")) / 1e6
    return log.withColumn("gap", gap).where(F.col("gap") < seconds)
