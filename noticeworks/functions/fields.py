"""Values read out of free text: deadlines, rosters, counts, campuses."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from noticeworks.functions.dates import DATE, to_date

CATEGORIES = ["ur", "sc", "st", "obc", "ews", "pwbd"]
#: What announces a deadline, the likeliest first.
DEADLINE_LABELS = [r"last date", r"closing date", r"on or before", r"closes at", r"until", r"deadline"]
#: Fixed value: a category with its count.
COUNTED = r"\b(UR|GEN|General|SC|ST|OBC(?:-NCL)?|EWS|PwBD|PwD)\b\s*[:=(-]?\s*(\d{1,3})\b"
_ROSTER = re.compile(COUNTED, re.I)
_ROSTER_NAMES = {"ur": "ur", "gen": "ur", "general": "ur", "sc": "sc", "st": "st", "obc": "obc", "obc-ncl": "obc", "ews": "ews", "pwbd": "pwbd", "pwd": "pwbd"}
ROSTER_TYPE = StructType([StructField(c, IntegerType()) for c in CATEGORIES])


def lenient_int(text: Column) -> Column:
    """All digits of a cell as one number; dashes and cells without digits are null."""
    digits = F.regexp_replace(text, r"\D", "")
    return F.when((digits != "") & ~F.trim(text).isin("-", "—", "–"), digits.try_cast("int"))


def deadline(text: Column, least: int = 2020) -> Column:
    """The date that follows the first label in order of likelihood; years before ``least`` do not count."""
    found = [F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?is){label}.{{0,60}}?\b({DATE})", 1) for label in DEADLINE_LABELS]
    return F.coalesce(*[to_date(x, least=least) for x in found])


def roster_of(text: str | None, near: int = 200, most: int = 50) -> dict[str, int] | None:
    """The category counts that stand closest together: the window of ``near`` characters with the most categories, the first of equals.

    A count over ``most`` spoils its window; the last count of a category in the window holds.
    """
    hits = [(m.start(), _ROSTER_NAMES[m.group(1).lower()], int(m.group(2))) for m in _ROSTER.finditer(text or "")]
    starts = [h[0] for h in hits]
    best: dict[str, int] | None = None
    for k, (at, _, _) in enumerate(hits):
        inside = hits[k : bisect_right(starts, at + near)]
        if len(inside) < 3 or any(n > most for _, _, n in inside):
            continue
        counts = {name: n for _, name, n in inside}
        if best is None or len(counts) > len(best):
            best = counts
    return best


@F.pandas_udf(ROSTER_TYPE)
def roster(texts: pd.Series) -> pd.DataFrame:
    """``roster_of`` as a column; categories without a count are null."""
    rows = [roster_of(t) or {} for t in texts]
    return pd.DataFrame({c: pd.array([r.get(c) for r in rows], dtype="Int32") for c in CATEGORIES})


def roster_total(counts: Column) -> Column:
    """The sum of the counts given; null if none is."""
    parts = [counts[c] for c in CATEGORIES]
    return F.when(F.coalesce(*parts).isNotNull(), sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0)))


def campus(text: Column) -> Column:
    """A campus named as 'Campus X', 'X campus' or 'based in X', in this order; '' is null."""
    found = [F.regexp_extract(F.coalesce(text, F.lit("")), p, 1) for p in (r"\bCampus[:\s]+([A-Z][a-zA-Z]+)\b", r"\b([A-Z][a-zA-Z]+)\s+[Cc]ampus\b", r"(?i)\b(?:based|located|positioned)\s+(?:in|at)\s+([A-Z][a-zA-Z]+)\b")]
    return F.coalesce(*[F.when(f != "", f) for f in found])


def publications(text: Column, most: int = 3) -> Column:
    """The first distinct statements on publications, joined."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"((?:[Aa]t least )?\d+ (?:research )?(?:publications|papers)[^.]{0,80})"))
    return F.array_join(F.slice(F.array_distinct(found), 1, most), " | ")


#: Fixed value: a statement of reserved percentages.
RESERVED_PERCENT = r"(?i)\b\d{1,2}(?:\.\d+)?\s?(?:%|per cent).*\b(?:reserv|sc|st|obc|ews|pwbd|disabilit)|\b(?:reserv|sc|st|obc|ews|pwbd|disabilit).*\b\d{1,2}(?:\.\d+)?\s?(?:%|per cent)"


def reservation_note(text: Column) -> Column:
    """The first sentence that states reserved percentages, squeezed; null without one."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "), r"\.\s")
    told = F.filter(parts, lambda p: p.rlike(RESERVED_PERCENT))
    return F.when(text.rlike(r"(?i)%|per\s+cent"), F.trim(F.try_element_at(told, F.lit(1))))


def is_composite(text: Column, posts: Column, peers: Column) -> Column:
    """True for a call for several posts: two or more posts, two or more listings of one address, or a text that says so."""
    said = F.coalesce(text.rlike(r"(?i)\b(?:various|multiple|several)\s+(?:posts|positions|disciplines|departments)\b"), F.lit(False))
    return F.coalesce(posts >= 2, F.lit(False)) | F.coalesce(peers >= 2, F.lit(False)) | said
