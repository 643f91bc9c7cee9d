"""Problem 6: groups of records that share most of their words.

SuperMinHash signatures over the distinct words, banded; candidates are verified
with the exact word sets; verified links are closed into groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.storage import spool


def words_of(text: Column) -> Column:
    """Distinct words: maximal runs of a-z and 0-9 after lower-casing."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != ""))


class SuperMinHash:
    """m-slot signatures whose ranks within an element form a permutation of 0..m-1.

    Element w gives slot p_j the value j + r_j, where p is its own random
    permutation and r_j uniform in [0, 1); a slot keeps the least value over the
    set. Step j can only fill slots that no earlier step reached, so a set stops as
    soon as all its slots are filled; batches run step by step over all their sets.
    """

    def __init__(self, slots: int, seed: int = 1):
        self.slots, self.seed = slots, seed
        self.known: dict[str, int] = {}
        self.places = np.empty((0, slots), np.int16)
        self.parts = np.empty((0, slots), np.float32)

    def _learn(self, words: list[str]) -> None:
        if not words:
            return
        places = np.empty((len(words), self.slots), np.int16)
        parts = np.empty((len(words), self.slots), np.float32)
        for k, w in enumerate(words):
            state = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8, salt=self.seed.to_bytes(8, "little")).digest(), "little")
            rng = np.random.Generator(np.random.SFC64(state))
            places[k] = rng.permutation(self.slots)
            parts[k] = rng.random(self.slots, dtype=np.float32)
        self.known |= {w: len(self.known) + k for k, w in enumerate(words)}
        self.places, self.parts = np.concatenate([self.places, places]), np.concatenate([self.parts, parts])

    def signatures(self, sets: list[list[str]]) -> np.ndarray:
        if len(self.known) > 300_000:  # a worker's memory stays bounded
            self.__init__(self.slots, self.seed)
        self._learn(list(dict.fromkeys(w for s in sets for w in s if w not in self.known)))
        ids = np.fromiter((self.known[w] for s in sets for w in s), np.int64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        value = np.full(len(sets) * self.slots, np.inf, np.float32)
        open_slots = np.full(len(sets), self.slots)
        for j in range(self.slots):
            live = open_slots[owner] > 0
            if not live.all():
                ids, owner = ids[live], owner[live]
            if not len(ids):
                break
            at = owner * self.slots + self.places[ids, j]
            fresh = value[at] >= j
            np.minimum.at(value, at[fresh], j + self.parts[ids[fresh], j])
            filled = np.unique(at[fresh & (value[at] < j + 1)])
            first = filled[value[filled] >= j]
            open_slots -= np.bincount(first // self.slots, minlength=len(sets))
        return value.reshape(len(sets), self.slots)


def signed_sets(sets: DataFrame, *, rows: int, bands: int, sketch: int, seed: int) -> DataFrame:
    """(rep, words, buckets, sketch) of each (rep, block, words).

    buckets holds one number for each band, a hash of block, band and the band's
    slots; sketch the low byte of a hash of each of the first ``sketch`` slots.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = SuperMinHash(rows * bands, seed)
        for batch in batches:
            words = batch.column("words").to_pylist()
            for start in range(0, len(words), 2000):
                part = words[start : start + 2000]
                one = batch.slice(start, len(part))
                slots = tool.signatures(part).view(np.uint32).astype(np.uint64)
                sig = slots.reshape(len(part), bands, rows)
                blocks = np.array([int.from_bytes(hashlib.blake2b(b.encode(), digest_size=8).digest(), "little") for b in one.column("block").to_pylist()], np.uint64)
                key = blocks[:, None] ^ (np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                for r in range(rows):
                    key = (key ^ sig[:, :, r]) * np.uint64(0xFF51AFD7ED558CCD)
                    key ^= key >> np.uint64(32)
                low = ((slots[:, :sketch] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8)
                ends = pa.array(np.arange(0, (len(part) + 1) * bands, bands, dtype=np.int32))
                buckets = pa.ListArray.from_arrays(ends, pa.array(key.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([one.column("rep"), one.column("words"), buckets, pa.array([x.tobytes() for x in low], pa.binary())], ["rep", "words", "buckets", "sketch"])

    return sets.select("rep", "block", "words").mapInArrow(emit, "rep long, words array<string>, buckets array<long>, sketch binary")


def alike_sketches(pairs: DataFrame, least: int) -> DataFrame:
    """The (a, b) whose sketches agree in at least ``least`` bytes."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch_b"))
            good = pa.array(np.flatnonzero((left == right).sum(1) >= least))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(good), batch.column("b").take(good)], ["a", "b"])

    return pairs.select("a", "b", "sketch_a", "sketch_b").mapInArrow(check, "a long, b long")


def similar_sets(sets: DataFrame, *, threshold: float = 0.75, rows: int = 6, bands: int = 40, sketch: int = 64, seed: int = 1, chunk: int = 256) -> DataFrame:
    """Pairs (rep_a < rep_b, similarity) of distinct word sets of one block whose Jaccard similarity reaches ``threshold``.

    ``sets`` is (rep long, block, words); equal sets must be one row. With rows=6
    and bands=40 a pair at 0.75 is missed with probability 0.0004; sketches of 64
    bytes, which must agree in the expected number less four deviations,
    miss less than one in 100,000 and spare the words of nearly all false candidates.

    A bucket is never one task's list: its members are cut into chunks, and chunk
    meets chunk in a shuffle join on (bucket, chunk pair), so a bucket of any size
    is spread over many tasks. Candidates of several bands are made one before
    sketches and words are fetched; both come from the table written once.
    """
    signed = spool(signed_sets(sets, rows=rows, bands=bands, sketch=sketch, seed=seed), "signed")
    keyed = signed.select("rep", F.explode("buckets").alias("bucket"))
    # A bucket of two is its own pair; only members of larger ones are looked up again.
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rep").alias("a"), F.max("rep").alias("b"))
    members = spool(keyed.join(sizes.where("n > 2").select("bucket", "n"), "bucket").withColumn("parts", F.ceil(F.col("n") / chunk).cast("int")).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")), "members")
    left = members.select("bucket", F.col("rep").alias("a"), F.col("part").alias("pa"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("pb"))
    right = members.select("bucket", F.col("rep").alias("b"), F.col("part").alias("pb"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("pa"))
    candidates = left.join(right, ["bucket", "pa", "pb"]).where("a < b").select("a", "b").unionByName(sizes.where("n = 2").select("a", "b")).distinct()
    marks = signed.select("rep", "sketch")
    marked = candidates.join(marks.select(F.col("rep").alias("a"), F.col("sketch").alias("sketch_a")), "a").join(marks.select(F.col("rep").alias("b"), F.col("sketch").alias("sketch_b")), "b")
    least = int(sketch * threshold - 4 * (sketch * threshold * (1 - threshold)) ** 0.5)
    close = alike_sketches(marked, least)
    bags = signed.select("rep", "words")
    met = close.join(bags.select(F.col("rep").alias("a"), F.col("words").alias("bag_a")), "a").join(bags.select(F.col("rep").alias("b"), F.col("words").alias("bag_b")), "b")
    shared = F.size(F.array_intersect("bag_a", "bag_b"))
    union = F.size("bag_a") + F.size("bag_b") - shared
    return met.select("a", "b", (shared / union).alias("similarity")).where(shared >= threshold * union - 1e-9).select(F.col("a").alias("rep_a"), F.col("b").alias("rep_b"), "similarity")


def connected_groups(nodes: DataFrame, links: DataFrame, *, max_rounds: int = 200) -> DataFrame:
    """(rep, group_rep): the least rep that links reach, by alternating large-star and small-star rounds until nothing changes.

    Each round is two group-bys with partial aggregation; the links of each round
    are written to the shared folder. Nothing is collected but a count. The number
    of rounds grows with the logarithm of the number of links; a run that is not done
    after ``max_rounds`` raises an error rather than return half groups.
    """
    edges = spool(links.select(F.least("rep_a", "rep_b").alias("u"), F.greatest("rep_a", "rep_b").alias("v")).where("u <> v").distinct(), "links")
    for _ in range(max_rounds):
        both = edges.union(edges.select("v", "u")).toDF("n", "m")
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("low"))
        large = both.join(least, "n").where("m > n").select(F.col("low").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("low"))
        small = large.join(low, "v").select("low", "u", "v")
        after = small.select(F.explode(F.array(F.struct(F.col("low").alias("u"), F.col("v").alias("v")), F.struct(F.col("low").alias("u"), F.col("u").alias("v")))).alias("e"))
        after = spool(after.select("e.u", "e.v").where("u < v").distinct(), "links")
        same = after.count() == edges.count() and after.exceptAll(edges).isEmpty()
        edges = after
        if same:
            break
    else:
        raise RuntimeError(f"groups are still growing after {max_rounds} rounds")
    return nodes.select("rep").join(edges.groupBy(F.col("v").alias("rep")).agg(F.min("u").alias("up")), "rep", "left").select("rep", F.coalesce("up", "rep").alias("group_rep"))


def ad_word_sets(ads: DataFrame, *, min_words: int = 60) -> tuple[DataFrame, DataFrame]:
    """(members, sets): ads with enough words by their word set, and each distinct set of an institution once.

    members: (block, rep, ad_id). sets: (rep, block, words). rep is a hash of the
    institution and the sorted words; that no two sets share one is checked.
    """
    own = ads.where("id is not null and institution_id is not null").select(
        F.col("id").alias("ad_id"), "snapshot_fetched_at", F.col("institution_id").alias("block"), words_of(F.col("raw_text_excerpt")).alias("own"), words_of(F.col("title")).alias("head")
    ).where(F.size("own") >= min_words)
    words = own.select("ad_id", "snapshot_fetched_at", "block", F.array_sort(F.array_union("own", "head")).alias("words"))
    joined = F.array_join("words", " ")
    bags = spool(words.withColumns({"rep": F.xxhash64("block", joined), "check": F.xxhash64(F.lit("check"), joined, "block")}), "bags")
    if not bags.groupBy("rep").agg((F.min("check") != F.max("check")).alias("two")).where("two").isEmpty():
        raise RuntimeError("two different word sets have the same hash of 64 bits")
    sets = bags.groupBy("rep").agg(F.first("block").alias("block"), F.first("words").alias("words"))
    members = bags.groupBy("ad_id").agg(F.max(F.struct("snapshot_fetched_at", "rep", "block")).alias("r")).select("r.block", "r.rep", "ad_id")
    return spool(members, "members"), sets


def expanded(pairs: DataFrame, members: DataFrame, *, chunk: int = 256) -> DataFrame:
    """(ad_id_a < ad_id_b, similarity) of all members of the linked sets, and of the members of one set.

    The members of a set are cut into chunks; a link is repeated for each pair of
    chunks and meets them on (set, chunk), so a set that a third of all ads share is
    spread over many tasks. The rows that come out are those asked for.
    """
    sizes = members.groupBy("rep").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / chunk).cast("int"))
    cells = members.join(sizes, "rep").select("rep", F.pmod(F.xxhash64("ad_id"), F.col("parts")).cast("int").alias("part"), "ad_id")
    links = pairs.select("rep_a", "rep_b", "similarity").unionByName(sizes.where("n > 1").select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b"), F.lit(1.0).alias("similarity")))
    counts = sizes.select("rep", "parts")
    wide = links.join(counts.toDF("rep_a", "parts_a"), "rep_a").join(counts.toDF("rep_b", "parts_b"), "rep_b")
    wide = wide.withColumn("part_a", F.explode(F.sequence(F.lit(0), F.col("parts_a") - 1)))
    first = F.when(F.col("rep_a") == F.col("rep_b"), F.col("part_a")).otherwise(0)
    wide = wide.select("rep_a", "rep_b", "similarity", "part_a", F.explode(F.sequence(first, F.col("parts_b") - 1)).alias("part_b"))
    met = wide.join(cells.toDF("rep_a", "part_a", "x"), ["rep_a", "part_a"]).join(cells.toDF("rep_b", "part_b", "y"), ["rep_b", "part_b"])
    twice = (F.col("rep_a") == F.col("rep_b")) & (F.col("part_a") == F.col("part_b")) & (F.col("x") >= F.col("y"))
    return met.where(~twice).select(F.least("x", "y").alias("ad_id_a"), F.greatest("x", "y").alias("ad_id_b"), "similarity")


def similar_ads(ads: DataFrame, *, threshold: float = 0.75, min_words: int = 60) -> DataFrame:
    """(ad_id_a < ad_id_b, similarity): every pair of ads of one institution whose word sets reach the threshold.

    Ads with equal word sets are one representative while pairs are searched, and
    are expanded at the end because every pair is asked for.

    Defined cases: null ids, null institutions and ads under ``min_words`` have no
    pairs; a second delivery of an ad is the same record; an ad is never paired
    with itself; an empty table gives no rows.
    """
    members, sets = ad_word_sets(ads, min_words=min_words)
    return expanded(similar_sets(sets, threshold=threshold), members)


def ad_groups(ads: DataFrame, *, threshold: float = 0.75, min_words: int = 60) -> DataFrame:
    """(ad_id, group_id, n_links) of every ad in a group of two or more.

    group_id is the least ad_id of the group; n_links counts the other word sets
    that the ad's own set links to.
    """
    members, sets = ad_word_sets(ads, min_words=min_words)
    pairs = spool(similar_sets(sets, threshold=threshold), "pairs")
    groups = connected_groups(sets, pairs)
    links = pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    placed = members.join(groups, "rep").join(links, "rep", "left")
    named = placed.groupBy("group_rep").agg(F.min("ad_id").alias("group_id"), F.count("*").alias("n")).where("n > 1")
    return placed.join(named, "group_rep").select("ad_id", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
