"""Problem 3: freely typed values mapped to the closest entry of a reference list.

A symmetric-delete dictionary over the reference list is built once, checked for
size and broadcast; each distinct value of a partition is looked up there, the
candidates are ranked by weighted Damerau-Levenshtein distance, then by how often
the entry itself is typed, then by its key. Values without an entry are reported.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that surround a name without being part of it.
LEAD_WORDS = {"department", "dept", "deptt", "school", "centre", "center", "faculty", "field", "discipline", "area", "subject", "specialisation", "of", "for", "in", "the"}
TAIL_WORDS = {"department", "dept", "deptt", "section", "stream", "regular", "main", "campus", "backlog", "post", "posts", "specialisation", "specialization"}
#: Spellings by sound, each as cheap as half an edit.
SOUNDS = [("shun", "tion"), ("k", "c"), ("z", "s"), ("f", "ph"), ("i", "y")]
#: A dictionary over this many characters of reference names is not broadcast.
MAX_REFERENCE_CHARS = 4_000_000
PREFIX = 9


def plain(value: str) -> str:
    """Lower case, compatibility forms resolved, separators as spaces, '&', '+' and '/' as 'and'."""
    value = unicodedata.normalize("NFKC", value).lower()
    value = re.sub(r"[&+/]", " and ", value)
    return re.sub(r"[^a-z0-9]+", " ", value).strip()


def _trim_words(words: list[str]) -> list[str]:
    while len(words) > 1 and words[0] in LEAD_WORDS:
        words = words[1:]
    while len(words) > 1 and (words[-1] in TAIL_WORDS or words[-1].isdigit()):
        words = words[:-1]
    return words


def readings(value: str) -> list[tuple[str, float]]:
    """The ways to read a typed value, each with a cost: as it stands, without a remark, or turned round at a comma, dash or bracket."""
    raw = unicodedata.normalize("NFKC", value)
    raw = re.sub(r"\[[^\]]*\]|\*", " ", raw)
    raw = re.sub(r"^\s*(?:field of|area\s*-|discipline\s*:|subject\s*:)\s*", "", raw, flags=re.I)
    raw = re.sub(r",\s*main campus\b|\s-\s*regular\b", " ", raw, flags=re.I)
    raw = raw.strip().rstrip(":.;, ")
    out: dict[str, float] = {}

    def add(text: str, cost: float) -> None:
        words = _trim_words(plain(text).split())
        if words:
            key = " ".join(words)
            out[key] = min(cost, out.get(key, 9.0))

    bracket = re.search(r"^(.*?)\(([^()]*)\)(.*)$", raw)
    if bracket:
        before, inner, after = bracket.groups()
        inner_words = plain(inner).split()
        remark = not inner_words or any(w.isdigit() for w in inner_words) or set(inner_words) <= TAIL_WORDS | {"re", "advertised", "readvertised"}
        if not remark:
            add(f"{before} {after}", 0.6)
            add(f"{inner} {' '.join(_trim_words(plain(before).split()))}", 0.1)
            return sorted(out.items(), key=lambda x: (x[1], x[0]))
        raw = f"{before} {after}".strip().rstrip(":.;, ")
    add(raw, 0.0)
    for mark in (",", " - "):
        if raw.count(mark) == 1:
            before, after = raw.split(mark)
            tail = _trim_words(plain(after).split())
            add(f"{' '.join(tail)} {' '.join(_trim_words(plain(before).split()))}", 0.1)
    return sorted(out.items(), key=lambda x: (x[1], x[0]))


def weighted_distance(typed: str, name: str, limit: float) -> float:
    """Damerau-Levenshtein (adjacent swaps), a doubled or dropped double letter at 0.7, any other edit at 1; infinite above ``limit``."""
    a, b = typed, name
    if abs(len(a) - len(b)) > limit / 0.7:
        return math.inf
    two, one = None, [float(j) for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        now = [float(i)] + [0.0] * len(b)
        for j in range(1, len(b) + 1):
            if a[i - 1] == b[j - 1]:
                best = one[j - 1]
            else:
                best = one[j - 1] + 1.0
            drop = one[j] + (0.7 if i > 1 and a[i - 1] == a[i - 2] else 1.0)
            miss = now[j - 1] + (0.7 if j > 1 and b[j - 1] == b[j - 2] else 1.0)
            best = min(best, drop, miss)
            if two is not None and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and a[i - 1] != b[j - 1]:
                best = min(best, two[j - 2] + 1.0)
            now[j] = best
        if min(now) > limit:
            return math.inf
        two, one = one, now
    return one[-1] if one[-1] <= limit else math.inf


def abbreviates(short: str, word: str) -> bool:
    """A shortened word: the same first letter, and its letters in order within the word."""
    if len(short) < 2 or len(short) >= len(word) or short[0] != word[0]:
        return False
    if len(short) == 2 and word[1] != short[1] and word[-1] != short[1] and len(word) > 8:
        return False
    rest = iter(word)
    return all(c in rest for c in short)


@dataclass(frozen=True)
class Reference:
    ref_id: int
    name: str
    words: tuple[str, ...]
    tight: str
    typed: int


class CanonicalIndex:
    """Symmetric-delete dictionary of one field's reference list."""

    def __init__(self, references: Iterable[tuple[int, str, int]], max_edits: int = 3):
        self.max_edits = max_edits
        self.exact: dict[str, int] = {}
        self.refs: list[Reference] = []
        self.deletes: dict[str, list[int]] = defaultdict(list)
        self.initials: dict[str, list[int]] = defaultdict(list)
        self.acronyms: dict[str, list[int]] = defaultdict(list)
        for ref_id, name, typed in sorted(references):
            words = tuple(plain(name).split())
            if not words:
                continue
            self.exact.setdefault(name, ref_id)
            k = len(self.refs)
            self.refs.append(Reference(ref_id, name, words, "".join(words), typed))
            for key in self._keys("".join(words)):
                self.deletes[key].append(k)
            strong = [w for w in words if w != "and"]
            self.initials["".join(w[0] for w in strong)].append(k)
            if len(strong) > 1:
                self.acronyms["".join(w[0] for w in strong)].append(k)
        self.lookup = lru_cache(maxsize=200_000)(self._lookup)

    def _keys(self, tight: str) -> set[str]:
        head, found = tight[:PREFIX], set()
        for n in range(min(self.max_edits, len(head) - 1) + 1):
            for gone in combinations(range(len(head)), n):
                found.add("".join(c for i, c in enumerate(head) if i not in gone))
        return found

    def _limit(self, length: int) -> float:
        return float(min(self.max_edits, max(1, length // 5))) if length > 3 else 0.0

    def _near(self, tight: str) -> set[int]:
        return {k for key in self._keys(tight) for k in self.deletes.get(key, ())}

    def _spelled(self, tight: str, ref: Reference) -> float:
        best = weighted_distance(tight, ref.tight, self._limit(min(len(tight), len(ref.tight))))
        for heard, written in SOUNDS:
            if best > 0.5 and heard in tight:
                start = tight.find(heard)
                while start >= 0:
                    fixed = tight[:start] + written + tight[start + len(heard) :]
                    best = min(best, 0.5 + weighted_distance(fixed, ref.tight, self._limit(len(ref.tight)) - 0.5))
                    start = tight.find(heard, start + 1)
        return best

    def _cut(self, tight: str, ref: Reference) -> float:
        """The value as the start of the name, the rest cut off."""
        if len(tight) < max(5, math.ceil(0.3 * len(ref.tight))) or len(tight) >= len(ref.tight):
            return math.inf
        if ref.tight.startswith(tight):
            return 0.5
        limit = 1.0 if len(tight) >= 8 else 0.0
        best = math.inf
        for size in (len(tight) - 1, len(tight), len(tight) + 1):
            if limit and 0 < size < len(ref.tight):
                best = min(best, weighted_distance(tight, ref.tight[:size], limit))
        return 0.9 + best

    def _shortened(self, words: tuple[str, ...], ref: Reference) -> float:
        """Word by word: equal, shortened, or one small slip."""
        own = [w for w in words if w != "and"]
        full = [w for w in ref.words if w != "and"]
        if len(own) != len(full):
            return math.inf
        cost, same = 0.0, 0
        for a, b in zip(own, full, strict=True):
            if a == b:
                same += 1
            elif b.startswith(a) and len(a) >= 3:
                cost += 0.4
            elif abbreviates(a, b):
                cost += 0.5
            elif a.endswith("s") and abbreviates(a[:-1], b):
                cost += 0.5
            else:
                slip = weighted_distance(a, b, 1.0 if len(b) > 4 else 0.0)
                if slip is math.inf:
                    return math.inf
                cost += slip
        # A lone short word says too little unless it starts the name.
        if len(full) == 1 and not (full[0].startswith(own[0]) and len(own[0]) >= 3 or own[0].endswith("s") and full[0].startswith(own[0][:-1])):
            return math.inf
        if len(full) > 1 and same == 0 and sum(map(len, own)) < 0.5 * sum(map(len, full)) - 3:
            return math.inf
        return cost

    def _lookup(self, value: str) -> tuple[int, float]:
        """(ref_id, cost); ref_id 0 if no entry is meant."""
        if value in self.exact:
            return self.exact[value], 0.0
        best: dict[int, float] = {}
        for text, turned in readings(value):
            words, tight = tuple(text.split()), text.replace(" ", "")
            near = self._near(tight)
            same_initials = self.initials.get("".join(w[0] for w in words if w != "and"), ())
            for k in {*near, *same_initials}:
                ref = self.refs[k]
                cost = min(self._spelled(tight, ref), self._shortened(words, ref), self._cut(tight, ref))
                if turned and len(words) < 2:
                    cost = math.inf
                best[k] = min(best.get(k, math.inf), turned + cost)
            letters = tight if len(tight) <= 5 and (len(words) == 1 or all(len(w) == 1 for w in words)) else ""
            if letters and len(named := self.acronyms.get(letters, [])) == 1 and len(letters) >= 2:
                best[named[0]] = min(best.get(named[0], math.inf), turned + 0.6)
        ranked = sorted((c, -self.refs[k].typed, self.refs[k].ref_id) for k, c in best.items() if c < math.inf)
        if not ranked:
            return 0, math.inf
        # Two entries that a cut value could equally start are no match.
        if len(ranked) > 1 and ranked[0][0] == ranked[1][0] and 0.5 <= ranked[0][0]:
            starts = [r for r in ranked if r[0] == ranked[0][0]]
            if len({r[2] for r in starts}) > 1 and ranked[0][0] in (0.5, 0.6):
                return 0, ranked[0][0]
        return ranked[0][2], ranked[0][0]


def typed_values(ads: DataFrame, fields: Iterable[str], key: str = "id", order: str = "snapshot_fetched_at") -> DataFrame:
    """(ad_id, field_name, value) of each ad's latest delivery, blank values left out."""
    fields = list(fields)
    latest = ads.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("ad_id")).agg(F.max(F.struct(F.col(order), *[F.col(f) for f in fields])).alias("_row"))
    long = latest.select("ad_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"_row.{f}").alias("value")) for f in fields])).alias("_v"))
    inked = F.regexp_replace("value", r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]", "")
    return long.select("ad_id", "_v.field_name", "_v.value").where(F.col("value").isNotNull() & (F.length(inked) > 0))


def map_to_canonical(values: DataFrame, references: DataFrame, *, max_edits: int = 3) -> DataFrame:
    """Adds ``ref_id`` (0: none) and ``cost`` to (…, field_name, value).

    The dictionary's size is checked before it is broadcast; a reference list over
    MAX_REFERENCE_CHARS goes through ``map_by_join``, which gives the same rows.

    Defined cases: null and blank values give ref_id 0; a value equal to an entry
    gives that entry; equal costs go to the entry typed more often, then to the
    smaller ref_id; an empty list maps everything to 0. No shuffle takes place, so
    a value that holds a third of all rows costs one lookup in each partition.
    """
    size = references.agg(F.sum(F.length("canonical_name"))).first()[0] or 0
    if size > MAX_REFERENCE_CHARS:
        return map_by_join(values, references, max_edits=max_edits)
    typed = {
        (r.field_name, r.value): r.n
        for r in values.join(F.broadcast(references.select("field_name", F.col("canonical_name").alias("value")).distinct()), ["field_name", "value"]).groupBy("field_name", "value").agg(F.count("*").alias("n")).collect()
    }
    lists: dict[str, list] = defaultdict(list)
    for r in references.select("ref_id", "field_name", "canonical_name").where("canonical_name is not null and ref_id is not null").collect():
        lists[r.field_name].append((r.ref_id, r.canonical_name, typed.get((r.field_name, r.canonical_name), 0)))
    sent = values.sparkSession.sparkContext.broadcast((dict(lists), max_edits))
    fields = [f for f in values.schema.fields if f.name not in ("ref_id", "cost")]

    def look_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, edits = sent.value
        index = {f: CanonicalIndex(entries, edits) for f, entries in known.items()}
        for frame in frames:
            found = [index[f].lookup(v) if f in index and isinstance(v, str) else (0, math.inf) for f, v in zip(frame["field_name"], frame["value"], strict=True)]
            yield frame.assign(ref_id=[r for r, _ in found], cost=[c for _, c in found])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", ref_id int, cost double"
    return values.select(*[f.name for f in fields]).mapInPandas(look_up, schema)


def map_by_join(values: DataFrame, references: DataFrame, *, max_edits: int = 3) -> DataFrame:
    """The same mapping for a list too large to broadcast: distinct values and entries meet on shared delete keys in a shuffle join, and each value is looked up in the dictionary of the entries it met."""
    distinct = values.select("field_name", "value").where("value is not null").distinct()

    def value_keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = CanonicalIndex([], max_edits)
        for frame in frames:
            rows = []
            for f, v in zip(frame["field_name"], frame["value"], strict=True):
                keys = {("x", v)}
                for text, _ in readings(v):
                    tight = text.replace(" ", "")
                    keys |= {("d", k) for k in tool._keys(tight)} | {("i", "".join(w[0] for w in text.split() if w != "and"))} | {("i", tight)}
                rows += [(f, v, t + k) for t, k in keys]
            yield pd.DataFrame(rows, columns=["field_name", "value", "key"])

    def entry_keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = CanonicalIndex([], max_edits)
        for frame in frames:
            rows = []
            for f, i, n in zip(frame["field_name"], frame["ref_id"], frame["canonical_name"], strict=True):
                words = plain(n).split()
                if words:
                    keys = {("x", n)} | {("d", k) for k in tool._keys("".join(words))} | {("i", "".join(w[0] for w in words if w != "and"))}
                    rows += [(f, i, n, t + k) for t, k in keys]
            yield pd.DataFrame(rows, columns=["field_name", "ref_id", "canonical_name", "key"])

    entries = references.select("field_name", "ref_id", "canonical_name").where("canonical_name is not null and ref_id is not null")
    left = distinct.mapInPandas(value_keys, "field_name string, value string, key string")
    right = entries.mapInPandas(entry_keys, "field_name string, ref_id int, canonical_name string, key string")
    pairs = left.join(right, ["field_name", "key"]).select("field_name", "value", "ref_id", "canonical_name").distinct()
    exact = values.groupBy("field_name", "value").agg(F.count("*").alias("typed")).withColumnRenamed("value", "canonical_name")
    pairs = pairs.join(exact, ["field_name", "canonical_name"], "left").fillna({"typed": 0})
    each = pairs.groupBy("field_name", "value").agg(F.collect_list(F.struct("ref_id", "canonical_name", "typed")).alias("entries"))

    def rank(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            # All entries that the whole dictionary would offer for a value are in its list, so the same rules give the same entry.
            found = [CanonicalIndex([(e["ref_id"], e["canonical_name"], e["typed"]) for e in entries], max_edits).lookup(v) for v, entries in zip(frame["value"], frame["entries"], strict=True)]
            yield pd.DataFrame({"field_name": frame["field_name"], "value": frame["value"], "found_id": [r for r, _ in found], "found_cost": [c for _, c in found]})

    best = each.mapInPandas(rank, "field_name string, value string, found_id int, found_cost double")
    return values.join(best, ["field_name", "value"], "left").select(*[values[c] for c in values.columns if c not in ("ref_id", "cost")], F.coalesce("found_id", F.lit(0)).alias("ref_id"), F.coalesce("found_cost", F.lit(float("inf"))).alias("cost"))
