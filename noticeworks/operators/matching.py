"""Records of two tables brought together: references, scores, prioritised keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeworks.functions.text import keywords, normalized
from noticeworks.functions.urls import url_key
from noticeworks.operators.ranking import best_per_group, first_wins
from noticeworks.storage import spool


def references(manifest: DataFrame) -> DataFrame:
    """(filename, ad_id, title): one row for each ad that a file is referenced by."""
    return manifest.select("filename", F.explode("ad_refs").alias("r")).select("filename", F.col("r.ad_id").alias("ad_id"), F.col("r.title").alias("title")).where("ad_id is not null").dropDuplicates(["filename", "ad_id"])


def url_references(ads: DataFrame, fields: list[str]) -> DataFrame:
    """(url_key, n_ads, n_fields, first_ad) of the addresses in any of the fields, unpivoted and grouped."""
    long = ads.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("url")) for f in fields])).alias("u")).where("u.url is not null and trim(u.url) <> ''")
    return long.groupBy(url_key(F.col("u.url")).alias("url_key")).agg(F.count_distinct("id").alias("n_ads"), F.count_distinct("u.field").alias("n_fields"), F.min("id").alias("first_ad"))


def _contains(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


#: The points of each agreement between an ad and a position. ``within``: one name holds the other; ``word``: for each shared word, up to ``most``; ``titled``: the ad's title holds the name.
WEIGHTS = {"department": {"same": 12, "within": 12, "word": 2, "most": 6, "titled": 8}, "discipline": {"same": 14, "within": 10, "word": 3, "most": 8, "titled": 10}}
SHARED_WORDS, RICH_TEXT, LONG_TEXT, LISTED_AREAS = 12, 120, 2, 2


def pair_score(ad: dict[str, Column], pos: dict[str, Column]) -> Column:
    """How well a position fits an ad: agreement of department and discipline, their mention in the title, shared words, and how rich the position is.

    ``ad``: title, department, discipline (folded) and words; ``pos``: department,
    discipline (folded), words, raw and areas.
    """
    terms = lambda c: F.filter(F.split(c, " "), lambda w: F.length(w) > 1)
    points = F.least(F.lit(SHARED_WORDS), F.size(F.array_intersect(ad["words"], pos["words"])))
    for name, w in WEIGHTS.items():
        a, b = ad[name], pos[name]
        shared = F.size(F.array_intersect(terms(a), terms(b)))
        agreed = F.when(a == b, w["same"]).when(a.contains(b) | b.contains(a), w["within"]).otherwise(F.least(F.lit(w["most"]), shared * w["word"]))
        points += F.when((a != "") & (b != ""), agreed).otherwise(0)
        points += F.when((b != "") & ad["title"].contains(b), w["titled"]).otherwise(0)
    return points + F.when(F.length(pos["raw"]) > RICH_TEXT, LONG_TEXT).otherwise(0) + F.when(F.size(pos["areas"]) > 0, LISTED_AREAS).otherwise(0)


def scored_pairs(ads: DataFrame, positions: DataFrame, manifest: DataFrame) -> DataFrame:
    """(filename, ad_id, position_id, n_refs, score) of the ads and positions of one file.

    The join is on the file; a file holds a handful of each. Only ads that a file
    refers to are read into words, and wide texts shrink to word arrays before they
    are shuffled.
    """
    refs = references(manifest)
    counts = refs.groupBy("filename").agg(F.count("*").alias("n_refs"))
    asked = ads.join(refs.select(F.col("ad_id").alias("id")).distinct(), "id", "left_semi")
    a = asked.select(
        F.col("id").alias("ad_id"), normalized(F.col("title")).alias("a_title"), normalized(F.col("department")).alias("a_dept"), normalized(F.col("discipline")).alias("a_disc"),
        keywords(F.concat_ws(" ", "title", "department", "discipline", "pdf_excerpt", "raw_text_excerpt")).alias("a_words"), "snapshot_fetched_at",
    )
    a = first_wins(a, ["ad_id"], ["snapshot_fetched_at"])
    p = positions.select(
        F.col("pdf_filename").alias("filename"), "position_id", normalized(F.col("department")).alias("p_dept"), normalized(F.col("discipline")).alias("p_disc"),
        keywords(F.concat_ws(" ", "department", "discipline", "raw_section_text", F.concat_ws(" ", "areas"))).alias("p_words"),
        F.coalesce("raw_section_text", F.lit("")).alias("raw"), F.coalesce("areas", F.array().cast("array<string>")).alias("areas"),
    ).dropDuplicates(["position_id"])
    joined = refs.join(counts, "filename").join(a, "ad_id").join(p, "filename")
    score = pair_score(
        {"title": F.col("a_title"), "department": F.col("a_dept"), "discipline": F.col("a_disc"), "words": F.col("a_words")},
        {"department": F.col("p_dept"), "discipline": F.col("p_disc"), "words": F.col("p_words"), "raw": F.col("raw"), "areas": F.col("areas")},
    )
    return joined.select("filename", "ad_id", "position_id", "n_refs", score.alias("score"))


def chosen_pairs(pairs: DataFrame, *, least: int = 10, margin: int = 2, sure: int = 18) -> DataFrame:
    """The pairs to attach: all positions of a file with one ad; else the best of each ad if it scores ``least`` and leads by ``margin`` or is ``sure``."""
    w = Window.partitionBy("filename", "ad_id").orderBy(F.col("score").desc(), "position_id")
    ranked = pairs.withColumns({"_rank": F.row_number().over(w), "_next": F.lead("score").over(w)})
    good = (F.col("score") >= least) & (F.col("_next").isNull() | (F.col("score") - F.col("_next") >= margin) | (F.col("score") >= sure))
    return ranked.where((F.col("n_refs") == 1) | ((F.col("_rank") == 1) & good)).select("filename", "ad_id", "position_id", "score")


def richness(areas: Column, raw: Column, confidence: Column) -> Column:
    """How much a position says."""
    return F.coalesce(F.size(areas), F.lit(0)) * 3 + F.floor(F.coalesce(F.length(raw), F.lit(0)) / 80) + F.floor(F.coalesce(confidence, F.lit(0.0)) * 4)


def richest(positions: DataFrame) -> DataFrame:
    """One position of each (file, department, discipline): the richest, the earliest of equals."""
    rows = positions.dropDuplicates(["position_id"]).withColumn("richness", richness(F.when(F.col("areas").isNotNull(), F.col("areas")), F.col("raw_section_text"), F.col("extraction_confidence")))
    return best_per_group(rows, ["pdf_filename", "department", "discipline"], [F.col("richness").desc(), F.col("position_id")])


def prioritised_lookup(rows: DataFrame, keys: list[Column], table: DataFrame, key: str, value: str) -> DataFrame:
    """Each row with the value of its first key that the table knows; (id, value). Nulls never match."""
    long = rows.select("id", F.posexplode(F.array(*keys)).alias("_p", "_k")).where("_k is not null and _k <> ''")
    found = long.join(table.select(F.col(key).alias("_k"), F.col(value).alias("_v")), "_k")
    return found.groupBy("id").agg(F.min(F.struct("_p", "_v"))["_v"].alias(value))


def outside_bands(rows: DataFrame, value: str, bands: DataFrame, low: str, high: str, *, parts: int | None = None) -> DataFrame:
    """The rows whose value lies in none of the bands.

    A value is covered if some band that starts at or before it reaches it, so the
    furthest end seen so far is all that counts. Bands and distinct values are sorted
    by ranges: each range finds its own running maximum, and what the ranges before it
    reached is one number for each range, which comes over the driver.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = bands.schema[high].dataType
    ends = bands.where(f"`{low}` is not null and `{high}` >= `{low}`").groupBy(F.col(low).alias("_lo")).agg(F.max(high).alias("_hi"))
    values = rows.select(F.col(value).alias("_lo")).where(F.col(value).isNotNull()).distinct()
    both = ends.withColumn("_value", F.lit(False)).unionByName(values.withColumns({"_hi": F.lit(None).cast(kind), "_value": F.lit(True)}))
    ranged = spool(both.repartitionByRange(parts, "_lo").withColumn("_part", F.spark_partition_id()), "ranges")
    reach, before = None, []
    for r in ranged.groupBy("_part").agg(F.max("_hi").alias("hi")).orderBy("_part").collect():  # one row for each range
        before.append((r["_part"], reach))
        reach = r.hi if reach is None or r.hi is not None and r.hi > reach else reach
    carried = spark.createDataFrame(before, ranged.select("_part", F.col("_hi").alias("_before")).schema)
    w = Window.partitionBy("_part").orderBy("_lo", "_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = ranged.withColumn("_own", F.max("_hi").over(w)).join(carried, "_part")
    covered = seen.where("_value and greatest(_own, _before) >= _lo").select(F.col("_lo").alias(value))
    return rows.join(covered, value, "left_anti")


def roster_of_unit(positions: DataFrame, rosters: DataFrame) -> DataFrame:
    """(position_id, row_no): for each position the first roster row of its file whose department contains its own or is contained in it.

    The join is on the file; a file holds a handful of each.
    """
    p = positions.select("position_id", "pdf_filename", normalized(F.col("department")).alias("_d"))
    r = rosters.select("pdf_filename", "row_no", normalized(F.col("department")).alias("_r"))
    hits = p.join(r, "pdf_filename").where(_contains(F.col("_d"), F.col("_r")))
    return hits.groupBy("position_id").agg(F.min("row_no").alias("row_no"))


def with_details(index: DataFrame, details: DataFrame) -> DataFrame:
    """Index rows (url, …) with the text of their detail page (url, text) and the number of open positions it states, which is taken out of the text."""
    key = lambda df: df.withColumn("_k", url_key(F.col("url")))
    stated = F.regexp_extract("text", r"(?i)\bopen positions?\s*:\s*(\d{1,3})\b", 1)
    d = key(details).select("_k", F.trim(F.regexp_replace("text", r"(?i)\bopen positions?\s*:\s*\d{1,3}\b", "")).alias("detail"), F.when(stated != "", stated.cast("int")).alias("open_positions")).dropDuplicates(["_k"])
    return key(index).join(d, "_k", "left").drop("_k")


def wildcard_match(value: Column, chosen: list[str], any_item: str) -> Column:
    """True if nothing is chosen, the value is chosen, or the value stands for all."""
    return F.lit(True) if not chosen else value.isin(*chosen, any_item)
