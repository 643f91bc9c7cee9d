"""Problem 5: the subject areas of ads, by label propagation.

Ads are linked through what they share: the discipline as meant, and the areas of
teaching or research named in the text. A link is verified by its labels: a shared
feature carries a subject only if nearly all labelled ads with the feature have it.
Labels spread over these links by iterative joins; trusted seeds stay as given, and
an ad keeps every subject that reaches it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.llm.canonical import map_to_canonical, readings, typed_values
from noticeworks.storage import spool

#: Characters of phrases that are matched in one pass; more phrases take more passes.
PASS_CHARS = 40_000_000
_WORDS = re.compile(r"[a-z0-9]+").findall


def area_phrases(areas: DataFrame) -> DataFrame:
    """(phrase) of (area): the lower-case words of every area named anywhere."""
    words = F.array_join(F.filter(F.split(F.lower("area"), "[^a-z0-9]+"), lambda w: w != ""), " ")
    return areas.select(words.alias("phrase")).where("phrase <> ''").distinct()


def named_areas(texts: DataFrame, phrases: DataFrame, *, pass_chars: int = PASS_CHARS) -> DataFrame:
    """(ad_id, feature) of (ad_id, body): at each word of a text the longest phrase that starts there.

    The phrases are sent in slices of about ``pass_chars`` characters, cut by their
    first word, so that any number of phrases gives the same rows; what a slice finds
    does not depend on the others.
    """
    phrases = spool(phrases, "phrases")
    size = phrases.agg(F.coalesce(F.sum(F.length("phrase")), F.lit(0))).first()[0]
    slices = -(-size // pass_chars)
    found = None
    for k in range(slices):
        known: dict[str, list[str]] = defaultdict(list)
        for (phrase,) in phrases.where(F.pmod(F.xxhash64(F.split("phrase", " ")[0]), F.lit(slices)) == k).collect():  # about pass_chars characters
            known[phrase.split(" ", 1)[0]].append(phrase)
        sent = texts.sparkSession.sparkContext.broadcast({first: sorted(((p.count(" ") + 1, p) for p in rest), reverse=True) for first, rest in known.items()})

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            by_first = sent.value
            for batch in batches:
                owners, out = [], []
                for ad, body in zip(batch.column("ad_id").to_pylist(), batch.column("body").to_pylist(), strict=True):
                    words, mine = _WORDS(body.lower()), set()
                    for i, word in enumerate(words):
                        for n, phrase in by_first.get(word, ()):
                            if n == 1 or " ".join(words[i : i + n]) == phrase:
                                mine.add("area " + phrase)
                                break
                    owners += [ad] * len(mine)
                    out += sorted(mine)
                yield pa.RecordBatch.from_arrays([pa.array(owners, pa.string()), pa.array(out, pa.string())], ["ad_id", "feature"])

        one = texts.mapInArrow(find, "ad_id string, feature string")
        found = one if found is None else found.unionByName(one)
    return found if found is not None else texts.select("ad_id", F.lit("").alias("feature")).limit(0)


def meant_disciplines(ads: DataFrame, names: DataFrame) -> DataFrame:
    """(ad_id, feature): the discipline's entry in the list, or its words where the list lacks it."""
    mapped = map_to_canonical(typed_values(ads, ["discipline"]), names.where("field_name = 'discipline'"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(ad, f"discipline {ref}" if ref else "typed " + read[0][0]) for ad, ref, value in zip(*(batch.column(c).to_pylist() for c in ("ad_id", "ref_id", "value")), strict=True) if (read := readings(value)) or ref]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["ad_id", "feature"])

    return mapped.select("ad_id", "ref_id", "value").mapInArrow(name, "ad_id string, feature string")


def ad_features(ads: DataFrame, phrases: DataFrame, names: DataFrame, *, text: str = "raw_text_excerpt") -> DataFrame:
    """(ad_id, feature): the discipline as meant, and the areas named in the text."""
    latest = ads.where("id is not null").groupBy(F.col("id").alias("ad_id")).agg(F.max(F.struct("snapshot_fetched_at", text)).alias("r"))
    return meant_disciplines(ads, names).unionByName(named_areas(latest.select("ad_id", F.col(f"r.{text}").alias("body")).where("body is not null"), phrases))


def verified_subjects(edges: DataFrame, labels: DataFrame, *, purity: float, support: int) -> DataFrame:
    """(feature, subject_code): at least ``support`` labelled ads have the feature, and ``purity`` of them the subject."""
    labelled = edges.join(labels.select("ad_id").distinct(), "ad_id", "left_semi")
    sizes = labelled.groupBy("feature").agg(F.count("*").alias("ads"))
    votes = labelled.join(labels, "ad_id").groupBy("feature", "subject_code").agg(F.count("*").alias("votes"))
    return votes.join(sizes, "feature").where((F.col("ads") >= support) & (F.col("votes") >= purity * F.col("ads"))).select("feature", "subject_code")


def propagate(edges: DataFrame, seeds: DataFrame, *, max_rounds: int = 100, purity: float = 0.9, later_purity: float = 0.75, support: int = 3, later_support: int = 5) -> DataFrame:
    """(ad_id, subject_code) of every ad that labels reach, seeds included.

    Round 1 verifies features by the seeds alone. Later rounds verify the features
    that are still open by all ads labelled so far, with a lower purity, because
    spread labels can lack a subject. Each round's table is written to the shared
    folder. Rounds go on until no feature is added; a run that is not done after
    ``max_rounds`` raises an error rather than return half of the labels.
    """
    seeds = spool(seeds.where("ad_id is not null and subject_code is not null").select("ad_id", "subject_code").distinct(), "seeds")
    meanings = spool(verified_subjects(edges, seeds, purity=purity, support=support), "meanings")

    def reach(known: DataFrame) -> DataFrame:
        spread = edges.join(known, "feature").select("ad_id", "subject_code").distinct()
        return spread.join(seeds.select("ad_id").distinct(), "ad_id", "left_anti").unionByName(seeds)

    for _ in range(max_rounds):
        more = verified_subjects(edges.join(meanings.select("feature").distinct(), "feature", "left_anti"), reach(meanings), purity=later_purity, support=later_support)
        more = spool(more, "meanings")
        if more.isEmpty():
            return reach(meanings)
        meanings = meanings.unionByName(more)
    raise RuntimeError(f"labels still spread after {max_rounds} rounds")


def ad_subjects(ads: DataFrame, positions: DataFrame, seeds: DataFrame, names: DataFrame) -> DataFrame:
    """(ad_id, subject_code): all subjects of each ad; ads without any have no row.

    Defined cases: null ids give no rows; ads without text or discipline get only
    their seed labels; a seeded ad keeps exactly its seeds; seeds of unknown ads
    are kept as given; repeated rows count once; empty tables give no rows.
    """
    areas = ads.where("structured_position is not null").select(F.explode("structured_position.areas").alias("area")).unionByName(positions.select(F.explode("areas").alias("area")))
    edges = spool(ad_features(ads, area_phrases(areas), names), "edges")
    return propagate(edges, seeds)
