"""Dates: several grammars to one date, distances to a given day, display tiers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The shape of each grammar, and the grammars tried for it in order.
FORMATS = [
    (r"^\d{4}-\d{2}-\d{2}$", ["yyyy-MM-dd"]),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", ["d.M.yyyy"]),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", ["d-M-yyyy"]),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", ["d/M/yyyy"]),
    (r"^\d{1,2} \p{L}+ \d{4}$", ["d MMM yyyy", "d MMMM yyyy"]),
    (r"^\d{1,2}-\p{L}+-\d{4}$", ["d-MMM-yyyy"]),
    (r"^\p{L}+ \d{1,2} \d{4}$", ["MMM d yyyy", "MMMM d yyyy"]),
]
_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
DATE = rf"(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{4}}|\d{{1,2}}[ -]{_MONTH}[ -]\d{{4}}|{_MONTH} \d{{1,2}} \d{{4}})"


def to_date(text: Column, least: int = 2015, most: int = 2035) -> Column:
    """The text as a date by the first grammar that fits, ordinal endings and commas aside; years outside the range are null."""

    def read(raw: Column) -> Column:
        x = F.trim(F.regexp_replace(F.regexp_replace(raw, r"(?i)(\d)(?:st|nd|rd|th)\b", "$1"), ",", " "))
        x = F.initcap(F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"(?i)\bsept\b", "Sep"))
        found = F.lit(None).cast("date")
        for shape, formats in reversed(FORMATS):
            found = F.when(x.rlike(shape), F.coalesce(*[F.try_to_timestamp(x, F.lit(f)).cast("date") for f in formats])).otherwise(found)
        return found

    # Through arrays, so that the text is found once and read once however often it is named.
    parsed = F.transform(F.filter(F.array(text), lambda t: F.length(t) > 5), read)
    return F.get(F.filter(parsed, lambda d: F.year(d).between(least, most)), F.lit(0))


def dates_in(text: Column) -> Column:
    """All dates of a text in order, as dates."""
    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({DATE})")), lambda d: to_date(d)), lambda d: d.isNotNull())


def labelled_date(text: Column, labels: str) -> Column:
    """The first date that follows one of the labels within 60 characters."""
    return to_date(F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?is)(?:{labels})[^\n]{{0,60}}?\b({DATE})", 1))


def days_until(day: Column, as_of: date) -> Column:
    return F.datediff(day, F.lit(as_of))


def days_since(day: Column, as_of: date) -> Column:
    """Never negative."""
    return F.greatest(F.datediff(F.lit(as_of), day), F.lit(0))


def urgency(day: Column, as_of: date) -> Column:
    d = days_until(day, as_of)
    return F.when(d.isNull(), "unknown").when(d < 0, "closed").when(d <= 7, "critical").when(d <= 30, "soon").otherwise("ok")


def countdown(day: Column, as_of: date) -> Column:
    d = days_until(day, as_of)
    return F.when(d.isNull(), "").when(d < 0, "closed").when(d == 0, "closes today").when(d == 1, "1 day left").otherwise(F.concat(F.lit("in "), d.cast("string"), F.lit(" days")))


def deadline_rank(day: Column, as_of: date) -> Column:
    """Days left; past deadlines after all others, open-ended ones last."""
    d = days_until(day, as_of)
    return F.when(d.isNull(), 9999).when(d < 0, 9998).otherwise(d)


def deadline_tier(day: Column, as_of: date) -> Column:
    d = days_until(day, as_of)
    return F.when(d.isNull(), "rolling").when(d < 0, "closed").when(d > 60, "date").otherwise("countdown")
