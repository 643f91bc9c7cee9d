"""Faceted queries over enriched ads: filter, sort, page, and counts with each facet left out.

``enrich`` computes every classifier column once and looks institutions up once;
a filter is then a conjunction of column predicates, and all facet counts come from
one scan: each ad yields one (dimension, value) row for each dimension whose other
predicates it passes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.functions.dates import deadline_rank

RANK_GROUPS = ["faculty", "associate", "full", "research", "visiting"]
SORTS = ["closing", "newest", "field", "inst"]


@dataclass(frozen=True)
class FilterSpec:
    """A faceted query. An empty facet does not constrain; values within one are alternatives."""

    query: str = ""
    fields: frozenset[str] = frozenset()
    relevance: frozenset[str] = frozenset()
    types: frozenset[str] = frozenset()
    states: frozenset[str] = frozenset()
    ranks: frozenset[str] = frozenset()
    closing_within: int | None = None
    reserved_only: bool = False
    sort: str = "closing"
    extra: dict = field(default_factory=dict)

    def active(self) -> int:
        """The number of values selected."""
        return sum(map(len, (self.fields, self.relevance, self.types, self.states, self.ranks))) + bool(self.query.strip()) + (self.closing_within is not None) + self.reserved_only


#: What opens a post to a rank: words in the title or the listed ranks, words of the title alone, kinds of posts, and names of ranks as a whole.
RANK_WORDS = {"faculty": r"\bassistant\s+professor\b", "associate": r"\bassociate\s+professor\b", "full": r"\bprofessor\b", "research": r"postdoc|post[- ]doc|research\s+fellow", "visiting": r"\bvisiting\s+(?:faculty|professor|fellow|scholar|lecturer)\b"}
RANK_TITLES = {"faculty": r"\b(?:asst|assistant)\s*/\s*(?:assoc|associate)\b", "associate": r"assoc(?:iate)?\s*/", "full": r"/\s*prof(?:essor)?\b"}
RANK_KINDS = {"research": ["Research", "Scientific", "Postdoc"], "visiting": ["Visiting"]}
RANK_NAMES = {"full": ["professor", "full professor"]}
LOWER_PROFESSOR = r"\b(?:assistant|associate|visiting|adjunct)\s+professor\b"
NARROWER = r"\bassociate\s+professor\b|\bprofessor\b|\bvisiting\b|\bpostdoc"


def rank_flags(title: Column, ranks: Column, post_type: Column, structured_type: Column | None = None) -> dict[str, Column]:
    """Five overlapping flags: the ranks a post is open to.

    A post is open to a rank that its title or listed ranks name, that a title of
    several ranks abbreviates, or that its kind stands for; a kind from the structured
    position counts before the ad's own. 'Faculty' alone is the entry rank unless the
    words narrow it, and 'professor' is the full rank unless a lower one is meant.
    """
    names = F.coalesce(ranks, F.array().cast("array<string>"))
    words, head = F.lower(F.concat_ws(" ", title, F.concat_ws(" ", ranks))), F.lower(F.coalesce(title, F.lit("")))
    kind = F.coalesce(*([structured_type] if structured_type is not None else []), post_type, F.lit(""))
    flags: dict[str, Column] = {}
    for rank in RANK_GROUPS:
        named = words.rlike(RANK_WORDS[rank])
        if rank == "full":
            named = named & ~words.rlike(LOWER_PROFESSOR)
        if rank == "faculty":
            named = named | ((kind == "Faculty") & ~words.rlike(NARROWER))
        if rank in RANK_TITLES:
            named = named | head.rlike(RANK_TITLES[rank])
        if rank in RANK_KINDS:
            named = named | kind.isin(*RANK_KINDS[rank])
        if rank in RANK_NAMES:
            named = named | F.exists(names, lambda r: F.lower(F.trim(r)).isin(*RANK_NAMES[rank]))  # noqa: B023 - called at once
        flags[rank] = named
    return flags


def reserved(breakdown: Column, text: Column) -> Column:
    """Reserved posts: with counts, one outside UR; without, a drive for reserved posts in the text."""
    others = F.lit(False)
    for c in ("sc", "st", "obc", "ews", "pwbd"):
        others = others | (F.coalesce(breakdown[c], F.lit(0)) > 0)
    any_count = others | (F.coalesce(breakdown["ur"], F.lit(0)) > 0)
    return F.when(F.coalesce(any_count, F.lit(False)), others).otherwise(F.coalesce(text.rlike(r"(?i)\b(?:special\s+recruitment\s+drive|mission\s+mode\s+recruitment|recruitment\s+drive\s+for\s+(?:SC|ST|OBC|EWS|PwBD|PwD|reserved))"), F.lit(False)))


def predicates(spec: FilterSpec, as_of: date) -> dict[str, Column]:
    """The predicate of each active dimension of enriched ads (fields, relevance, inst_type, state, rank flags, query_hit)."""
    found: dict[str, Column] = {}
    if spec.fields:
        found["field"] = F.arrays_overlap("fields", F.array(*[F.lit(v) for v in sorted(spec.fields)]))
    if spec.relevance:
        found["relevance"] = F.col("relevance").isin(*sorted(spec.relevance))
    if spec.types:
        found["type"] = F.col("inst_type").isin(*sorted(spec.types))
    if spec.states:
        found["state"] = F.col("state").isin(*sorted(spec.states))
    if spec.ranks:
        hit = F.lit(False)
        for r in sorted(spec.ranks & set(RANK_GROUPS)):
            hit = hit | F.col(f"is_{r}")
        found["rank"] = hit
    if spec.query.strip():
        found["query"] = F.col("query_hit")
    if spec.closing_within is not None:
        found["closing"] = F.datediff("closing_date", F.lit(as_of)).between(0, spec.closing_within)
    if spec.reserved_only:
        found["reserved"] = F.col("is_reserved")
    return {k: F.coalesce(v, F.lit(False)) for k, v in found.items()}


def filtered(ads: DataFrame, spec: FilterSpec, as_of: date) -> DataFrame:
    """The ads that pass every active dimension; cheap predicates stand before the search."""
    parts = predicates(spec, as_of)
    out = ads
    for name in ("type", "state", "closing", "relevance", "rank", "reserved", "field", "query"):
        if name in parts:
            out = out.where(parts[name])
    return out


def sort_order(sort: str, as_of: date, field_order: Sequence[str]) -> list[Column]:
    """The order of one of the four sorts, ending in the id; an unknown sort is 'closing'."""
    ranks = F.array(*[F.lit(f) for f in field_order])
    place = F.array_position(ranks, F.col("field"))
    by_field = [F.when(place == 0, len(field_order) + 1).otherwise(place), F.col("field")]
    by_deadline = [deadline_rank(F.col("closing_date"), as_of)]
    by_inst = [F.coalesce("inst_name", F.lit(""))]
    orders = {
        "closing": [*by_deadline, *by_field, *by_inst],
        "newest": [F.coalesce(F.col("publication_date").cast("string"), F.lit("")).desc(), *by_deadline, *by_field],
        "field": [*by_field, *by_deadline, *by_inst],
        "inst": [*by_inst, *by_field, *by_deadline],
    }
    return [*orders.get(sort, orders["closing"]), F.col("id")]


_VALUES = {"field": "fields", "relevance": "array(relevance)", "type": "array(inst_type)", "state": "array(state)"}


def _facet_row(dim: str):
    return lambda value: F.struct(F.lit(dim).alias("dimension"), value.cast("string").alias("value"))


def facet_counts(ads: DataFrame, spec: FilterSpec, as_of: date, *, with_closing: bool = False) -> DataFrame:
    """(dimension, value, n): for each facet the ads that pass all other active dimensions.

    One scan. As a facet's own predicate is left out, choosing a value never hides
    its alternatives. The closing filter counts only if ``with_closing`` asks for it.
    """
    parts = predicates(spec, as_of)
    if not with_closing:
        parts.pop("closing", None)
    rows = []
    for dim in ("field", "relevance", "type", "state", "rank"):
        keep = F.lit(True)
        for name, p in parts.items():
            if name != dim:
                keep = keep & p
        values = F.filter(F.array(*[F.when(F.col(f"is_{r}"), r) for r in RANK_GROUPS]), lambda x: x.isNotNull()) if dim == "rank" else F.expr(_VALUES[dim])
        rows.append(F.when(keep, F.transform(values, _facet_row(dim))))
    each = ads.select(F.explode(F.flatten(F.filter(F.array(*rows), lambda a: a.isNotNull()))).alias("f")).where("f.value is not null")
    return each.groupBy("f.dimension", "f.value").agg(F.count("*").alias("n"))


def grid_counts(ads: DataFrame, cell: float) -> DataFrame:
    """Ads and institutions by map cell of ``cell`` degrees; places without coordinates are left out."""
    at = ads.where("lat is not null and lon is not null").select("institution_id", F.floor(F.col("lat") / cell).alias("row"), F.floor(F.col("lon") / cell).alias("col"))
    return at.groupBy("row", "col").agg(F.count("*").alias("n_ads"), F.count_distinct("institution_id").alias("n_institutions"))
