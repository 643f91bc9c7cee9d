"""Derived columns of an ad: labels, states, units, cues and summaries, each from texts and rules that the caller can replace."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What tells an answer that gives totals, one that gives categories and one that names institutions.
TOTALS = r"\b\d{2,5}\s+(?:vacant|vacancies|vacancy|posts?\s+lying\s+vacant)|\b\d{2,5}\s+(?:of\s+the\s+\d{2,6}\s+sanctioned\s+posts|posts\s+of\s+[a-z ]{3,60}\s+lie\s+vacant)|sanctioned\s+(?:strength|posts)\s+(?:is|are)\s+\d{2,6}"
CATEGORY_NUMBER = r"\b(?:sc|st|obc|ews|pwbd|pwd)[\s:-]+\d+"
CATEGORY_PAIR = r"(?s)\bsc\b.{0,200}\bst\b"
INSTITUTION = r"\b(?:university|institute|college)\s+of\s+[a-z]+|\b[a-z]+\s+(?:state|central|private)\s+university\b"
#: A drive for reserved posts, and a call for one post.
DRIVE = r"\b(?:special\s+recruitment\s+drive|mission\s+mode\s+recruitment|srd\b|recruitment\s+drive\s+for\s+(?:sc|st|obc|ews|pwbd|pwd|reserved))"
SINGLE = r"\b(?:one|1|a\s+single|single)[\s-]+(?:post|position|vacancy)\b"
#: Words before and after the name of a unit.
UNIT_BEFORE = r"^(?:the\s+)?(?:department|dept\.?|deptt\.?|school|centre|center|faculty|discipline|field|area|subject)\s*(?:of|for|in|:|-)\s*"
UNIT_AFTER = r"\s*(?:\*+|\(re-?advertised\)|\[[^\]]*\]|-\s*regular|,\s*main\s+campus|section|stream)\s*$"


def first_true(cases: Sequence[tuple[Column, str]], default: Column | str | None) -> Column:
    """The label of the first condition that holds; a null condition does not."""
    start = default if isinstance(default, Column) else F.lit(default)
    return reduce(lambda rest, case: F.when(F.coalesce(case[0], F.lit(False)), case[1]).otherwise(rest), reversed(cases), start)


def disclosure(text: Column) -> dict[str, Column]:
    """What an answer discloses: totals, at least three category counts that stand together, at least two institutions with totals."""
    x = F.lower(F.coalesce(text, F.lit("")))
    totals = x.rlike(TOTALS)
    return {"totals": totals, "categories": (F.regexp_count(x, F.lit(CATEGORY_NUMBER)) >= 3) & x.rlike(CATEGORY_PAIR), "institutions": (F.regexp_count(x, F.lit(INSTITUTION)) >= 2) & totals}


def reservation_state(private: Column, counted: Column, drive: Column, composite: Column, single: Column) -> Column:
    """How far a notice tells its reservation: the first state that holds; 'single' only for a call that is not composite."""
    return first_true([(private & ~counted, "private"), (counted, "counted"), (drive, "drive"), (composite, "composite"), (single, "single")], "unknown")


def has_counts(breakdown: Column) -> Column:
    """True if a breakdown gives a count over zero."""
    parts = [F.coalesce(breakdown[c], F.lit(0)) > 0 for c in ("ur", "sc", "st", "obc", "ews", "pwbd")]
    return reduce(lambda a, b: a | b, parts)


def unit_name(text: Column, overrides: dict[str, str] | None = None) -> Column:
    """A unit's bare name: squeezed, without the words around it, by an override if one is given; '' is null."""
    x = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"\s+", " ")
    x = F.trim(F.regexp_replace(F.regexp_replace(x, f"(?i){UNIT_BEFORE}", ""), f"(?i){UNIT_AFTER}", ""))
    named = first_true([(F.lower(x) == F.lit(k.lower()), v) for k, v in (overrides or {}).items()], x)
    return F.when(named != "", named)


def unit_from_title(title: Column) -> Column:
    """The unit that a title names, '(unit)' before 'in unit'; null without one."""
    found = [F.trim(F.regexp_extract(F.coalesce(title, F.lit("")), p, 1)) for p in (r"\(([^()]{3,60})\)\s*$", r"\b[Ii]n\s+([A-Z][^()]{2,60})$")]
    return F.coalesce(*[F.when(f != "", f) for f in found])


def headline(title: Column) -> tuple[Column, Column]:
    """(rank, rest): a title split at ' in ' or before a bracket; a title without either is all rank."""
    x = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"^(?:Recruitment|Appointment) of\s+", ""))
    rank = F.trim(F.regexp_extract(x, r"^(.*?)(?:\s+in\s+|\s*\(|$)", 1))
    rest = F.trim(F.regexp_replace(F.regexp_extract(x, r"(?:\s+in\s+|\s*\()(.*)$", 1), r"\)\s*$", ""))
    return rank, rest


def meta_parts(title: Column, parts: Sequence[Column]) -> Column:
    """The parts that the title does not say already, joined by ' · '."""
    head = F.lower(F.coalesce(title, F.lit("")))
    kept = [F.when((F.trim(p) != "") & ~head.contains(F.lower(F.trim(p))), F.trim(p)) for p in parts]
    return F.concat_ws(" · ", *kept)


def numbered_items(text: Column, most: int = 20, verbs: str = r"^(?:apply|send|submit|attach|enclose|write|see)\b") -> Column:
    """The items of a numbered list, one line each, without those that tell the reader to do something; at most ``most`` are part of a card."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?m)^[ \t]*\d{1,2}[.)][ \t]+([^\r\n]{3,80})$"), F.lit(1))
    return F.slice(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: ~F.lower(x).rlike(verbs)), 1, most)


#: What announces areas, method and eligibility in a notice.
CUES = {
    "areas": r"(?i)(?:preferred areas of specialisation are|specialisations needed:|research interests should include|current themes are)\s+([^.]{3,200})",
    "approach": r"(?i)\b(?:ideally combined with|with electives in|with emphasis on)\s+([^.,;]{3,80})",
    "eligibility": r"(?i)([^.\n]*\b(?:ph\.?\s?d|doctora|master|degree|net qualified)[^.\n]*)",
}


def cue(text: Column, name: str) -> Column:
    """The first statement that a cue announces; null without one."""
    found = F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), CUES[name], 1))
    return F.when(found != "", found)


def statements(text: Column, pattern: str, most: int = 2) -> Column:
    """The first sentences with a pattern, joined by '; '."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[.\r\n]+\s*"), lambda p: F.trim(p)), lambda p: p.rlike(f"(?i){pattern}"))
    return F.array_join(F.slice(parts, 1, most), "; ")


def public_address(url: Column) -> Column:
    """True for an http(s) address whose host is a name or a public number: no local names, no private, loopback, link-local or reserved numbers. Names are resolved by ``urls.is_public_url`` before a request."""
    u = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    host = F.regexp_extract(u, r"^https?://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    private = host.rlike(r"^(?:localhost|.*\.local|.*\.internal)$|^(?:0|10|127)\.|^169\.254\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|^192\.168\.|^(?:22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|^\[")
    return (host != "") & ~private
