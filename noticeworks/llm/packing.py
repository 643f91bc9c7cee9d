"""Problem 9: items put into containers of fixed capacity with little space unused.

Minimum bin slack on the histogram of sizes: a container starts with the largest
size left, and a bitset subset-sum over the sizes left finds the fullest feasible
rest; the combination is used as often as the counts allow and removed. The
histogram has at most as many rows as the capacity, whatever the number of items,
so it is the only thing that reaches the driver; items are numbered within their
size in parallel and find their container by that number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeworks.storage import spool

#: More kinds of containers are refused, because each is part of the plan.
MAX_PACKS = 1000

def fullest_rest(room: int, counts: dict[int, int]) -> dict[int, int]:
    """The multiset of available sizes with the largest sum up to ``room``: bitset subset-sum, larger sizes first, stopped once ``room`` itself is reached."""
    if room <= 0:
        return {}
    if counts.get(room, 0) > 0:
        return {room: 1}
    limit = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for size in sorted((s for s, n in counts.items() if n > 0 and 0 < s <= room), reverse=True):
        left = min(counts[size], room // size)
        take = 1
        while left > 0:
            take = min(take, left)
            grown = (reach | (reach << (size * take))) & limit
            if grown != reach:
                steps.append((size, take, reach))
                reach = grown
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for size, take, before in reversed(steps):
        if not before >> at & 1:
            used[size] = used.get(size, 0) + take
            at -= size * take
    return used


def bin_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """[(times, {size: uses})] that place every item of the histogram once."""
    counts = {s: n for s, n in histogram.items() if n > 0 and s > 0}
    if any(s > capacity for s in counts):
        raise ValueError("an item exceeds the capacity")
    patterns = []
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        used = fullest_rest(capacity - seed, counts)
        counts[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        times = min(counts[s] // n for s, n in used.items())
        for s, n in used.items():
            counts[s] -= n * times
            if not counts[s]:
                del counts[s]
        patterns.append((times, used))
    return patterns


def pieces(sizes: DataFrame, packs: DataFrame, *, key: str, size: str) -> DataFrame:
    """(pack_name, capacity, key, piece, units): an item over the capacity becomes full pieces and a rest."""
    # Each pack is a literal of the plan, so their number is checked.
    kinds = packs.where("capacity > 0 and pack_name is not null").select("pack_name", "capacity").distinct().orderBy("pack_name").limit(MAX_PACKS + 1).collect()
    if len(kinds) > MAX_PACKS:
        raise ValueError(f"more than {MAX_PACKS} packs")
    offers = F.array(*[F.struct(F.lit(r.pack_name).alias("pack_name"), F.lit(r.capacity).alias("capacity")) for r in kinds])
    each = sizes.where(F.col(key).isNotNull()).select(F.col(key), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_n"), F.explode(offers).alias("_p"))
    last = F.greatest(F.ceil(F.col("_n") / F.col("_p.capacity")), F.lit(1)) - 1
    cut = each.select(key, "_n", "_p", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece"))
    return cut.select("_p.pack_name", "_p.capacity", key, F.col("piece").cast("int").alias("piece"), F.least(F.col("_n") - F.col("piece") * F.col("_p.capacity"), F.col("_p.capacity").cast("long")).cast("int").alias("units"))


def pack(sizes: DataFrame, packs: DataFrame, *, key: str = "doc_id", size: str = "n_tokens", per_salt: int = 100_000) -> DataFrame:
    """(pack_name, container_id, key, piece, units) for every item and pack.

    container_id counts from 0 within a pack. Items of 0 units need no container and
    have a null one, and take no part in what follows. Plan: the histogram by (pack,
    size) gives each size a number of salts, so that about ``per_salt`` items share
    one; counts by (pack, size, salt) number the items: a number is the offset of its
    salt plus the rank within (pack, size, salt), so a size that a third of all items
    share is ranked in many tasks.

    Defined cases: null sizes count as 0; null keys give no rows; repeated keys are
    items of their own; equal sizes are placed in the order of their hash and key;
    capacities under 1 are ignored; no packs or no items give no rows.
    """
    spark = sizes.sparkSession
    if packs.where("capacity > 0 and pack_name is not null").isEmpty():
        return spark.createDataFrame([], f"pack_name string, container_id long, `{key}` {sizes.schema[key].dataType.simpleString()}, piece int, units int")
    every = pieces(spool(sizes.select(key, size), "sizes"), packs, key=key, size=size)
    cut = every.where("units > 0")
    # At most (sum of capacities) rows.
    bars: dict[tuple[str, int], dict[int, int]] = {}
    salts: dict[str, dict[int, int]] = {}
    for r in cut.groupBy("pack_name", "capacity", "units").agg(F.count("*").alias("n")).collect():
        bars.setdefault((r.pack_name, r.capacity), {})[r.units] = r.n
        if r.n > per_salt:
            salts.setdefault(r.pack_name, {})[r.units] = -(-r.n // per_salt)
    hot = [(name, units, n) for name, own in salts.items() for units, n in own.items()]
    shared = F.lit(1)
    if hot:
        table = spark.createDataFrame(hot, "pack_name string, units int, salts int")
        cut = cut.join(table, ["pack_name", "units"], "left")
        shared = F.coalesce("salts", F.lit(1))
    cut = cut.withColumn("salt", F.pmod(F.xxhash64(key, "piece"), shared).cast("int")).select("pack_name", "capacity", key, "piece", "units", "salt")
    cells = spool(cut.groupBy("pack_name", "units", "salt").agg(F.count("*").alias("n")), "cells")
    offsets = cells.withColumn("offset", F.sum("n").over(Window.partitionBy("pack_name", "units").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("pack_name", "units", "salt", F.coalesce("offset", F.lit(0)).alias("offset"))
    segments: dict[str, tuple] = {}
    for (name, capacity), bar in sorted(bars.items()):
        start, first, rows = dict.fromkeys(bar, 0), 0, []
        for times, used in bin_patterns(bar, capacity):
            for s, n in used.items():
                rows.append((s, start[s], n, first))
                start[s] += n * times
            first += times
        rows.sort()
        segments[name] = tuple(np.array(c, np.int64) for c in zip(*rows, strict=True))
    sent = spark.sparkContext.broadcast(segments)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = np.full(len(frame), -1, np.int64)
            units, number = frame["units"].to_numpy(np.int64), frame["number"].to_numpy(np.int64)
            for name, (s, start, uses, first) in sent.value.items():
                mine = np.flatnonzero((frame["pack_name"] == name).to_numpy())
                if len(mine):
                    at = np.searchsorted(s * (1 << 44) + start, units[mine] * (1 << 44) + number[mine], "right") - 1
                    out[mine] = first[at] + (number[mine] - start[at]) // uses[at]
            yield frame.assign(container_id=out)[["pack_name", "container_id", key, "piece", "units"]]

    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("pack_name", "units", "salt").orderBy(key, "piece")))
    # One row for each (pack, size, salt): bounded by capacities and salts, but joined by shuffle so that no bound is needed.
    numbered = ranked.join(offsets.hint("shuffle_hash"), ["pack_name", "units", "salt"]).select("pack_name", key, "piece", "units", (F.col("offset") + F.col("rank") - 1).alias("number"))
    placed = numbered.mapInPandas(place, f"pack_name string, container_id long, `{key}` {sizes.schema[key].dataType.simpleString()}, piece int, units int")
    return placed.unionByName(every.where("units = 0").select("pack_name", F.lit(None).cast("long").alias("container_id"), key, "piece", "units"))


def fill_report(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_name, capacity, n_containers, n_pieces, n_units, least_containers, free_share) of each pack."""
    bins = packed.where("container_id is not null").groupBy("pack_name", "container_id").agg(F.sum("units").alias("units"), F.count("*").alias("pieces"))
    total = bins.groupBy("pack_name").agg(F.count("*").alias("n_containers"), F.sum("pieces").alias("n_pieces"), F.sum("units").alias("n_units"))
    named = total.join(packs.select("pack_name", "capacity").distinct(), "pack_name")
    return named.select("pack_name", "capacity", "n_containers", "n_pieces", "n_units", F.ceil(F.col("n_units") / F.col("capacity")).alias("least_containers"), (1 - F.col("n_units") / (F.col("n_containers") * F.col("capacity"))).alias("free_share"))
