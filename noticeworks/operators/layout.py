"""Layout of pages: words to lines, lines to sections, units, columns, tables of roles."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from noticeworks.operators.ranking import islands

#: How list items and headings begin.
LIST_MARK = r"^\s*(?:[-•*▪●]\s+|\(?[a-z0-9]{1,3}[.)]\s+)"
HEADING = r"^\s*(?:[A-Z][A-Z &,/-]{6,}|(?:annexure|schedule|section|part)\s+[-–]?\s*[A-Z0-9]{1,4}\b.*)\s*:?\s*$"


def without_pagination(text: Column) -> Column:
    """Form feeds, 'Page N of M', lone page numbers and '- N -' replaced by one blank; line breaks kept."""
    x = F.replace(text, F.lit("\f"), F.lit(" "))
    for p in (r"(?im)\bpage\s+\d+\s+of\s+\d+\b", r"(?im)^[ \t]*(?:page|pg\.?)[ \t]*\d+[ \t]*$", r"(?m)^[ \t]*[-–—][ \t]*\d+[ \t]*[-–—][ \t]*$", r"(?m)^[ \t]*\d{1,3}[ \t]*$"):
        x = F.regexp_replace(x, p, " ")
    return x


def text_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line) of each text, line breaks of any kind."""
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\r\n|\r|\n")).alias("line_no", "line"))


def line_class(line: Column, size: Column | None = None, usual: Column | None = None) -> Column:
    """'spacer', 'header', 'list' or 'paragraph', the first that holds; a size over the usual one makes a header where sizes are known."""
    kind = F.when(F.trim(line) == "", "spacer").when(line.rlike(f"(?-i){HEADING}"), "header").when(line.rlike(f"(?i){LIST_MARK}"), "list")
    if size is not None and usual is not None:
        kind = kind.when(size >= usual * 1.1, "header")
    return kind.otherwise("paragraph")


def sections(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, section, kind, n_lines, first_line, text): runs of paragraph or list lines as one section; every header is its own, spacers part."""
    classed = lines.withColumn("kind", line_class(F.col("line")))
    previous = F.lag("kind").over(Window.partitionBy(key).orderBy("line_no"))
    runs = islands(classed, [key], [F.col("line_no")], (F.col("kind") != previous) | (F.col("kind") == "header"), "section").where("kind <> 'spacer'")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: F.trim(x["line"])), " ")
    return runs.groupBy(key, "section", "kind").agg(F.count("*").alias("n_lines"), F.min("line_no").alias("first_line"), joined.alias("text"))


def section_lines(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line_no, line, kind, section): lines with the number of the header they stand under, spacers left out."""
    classed = lines.withColumn("kind", line_class(F.col("line"))).where("kind <> 'spacer'")
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return classed.withColumn("section", F.sum(F.when(F.col("kind") == "header", 1).otherwise(0)).over(w))


def words_to_lines(words: DataFrame, tolerance: float = 3.5, gap: float = 1.5) -> DataFrame:
    """(pdf, page, line_no, top, x0, size, text) of word boxes (pdf, page, text, x0, x1, top, size).

    Words go by top and x0; a line ends where a word lies over ``tolerance`` from the
    line's first word. Words closer than ``gap`` are one. One page is one group, and
    its size is bounded by paper.
    """

    def per_page(frame: pd.DataFrame) -> pd.DataFrame:
        rows, line, first = [], [], None
        for w in frame.sort_values(["top", "x0"], kind="stable").itertuples():
            if first is not None and abs(w.top - first) > tolerance:
                rows.append(line)
                line, first = [], None
            if first is None:
                first = w.top
            line.append(w)
        if line:
            rows.append(line)
        out = []
        for k, ws in enumerate(rows):
            ws = sorted(ws, key=lambda w: w.x0)
            text = ws[0].text
            for a, b in zip(ws, ws[1:], strict=False):
                text += (" " if b.x0 - a.x1 > gap else "") + b.text
            out.append((ws[0].pdf, ws[0].page, k, float(ws[0].top), float(ws[0].x0), float(median(w.size for w in ws)), text))
        return pd.DataFrame(out, columns=["pdf", "page", "line_no", "top", "x0", "size", "text"])

    return words.groupBy("pdf", "page").applyInPandas(per_page, "pdf string, page int, line_no int, top double, x0 double, size double, text string")


def classed_lines(lines: DataFrame) -> DataFrame:
    """Lines with their class, where the page's median size is the usual one."""
    usual = lines.groupBy("pdf", "page").agg(F.percentile("size", 0.5).alias("usual"))
    return lines.join(usual, ["pdf", "page"]).withColumn("kind", line_class(F.col("text"), F.col("size"), F.coalesce("usual", F.lit(10.0))))


def outside_tables(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """The lines of each page that lie in none of its table bands (pdf, page, y_top, y_bottom)."""
    b = tables.select(F.col("pdf").alias("_pdf"), F.col("page").alias("_page"), "y_top", "y_bottom")
    return lines.join(b, (F.col("pdf") == F.col("_pdf")) & (F.col("page") == F.col("_page")) & F.col("top").between(F.col("y_top"), F.col("y_bottom")), "left_anti")


@dataclass
class Unit:
    number: int
    name: str
    body: str


_UNIT = re.compile(r"^\s*(\d{1,3})\s{2,}([A-Z][^\n]*?)\s*$")


def units_of(text: str | None) -> list[Unit]:
    """Numbered units of a layout text.

    A unit starts at '<n>  <Name>'. Lines with two such starts belong to a table of
    contents and do not count; of equal numbers the last counts; numbers must start
    at 1 to 3 and rise by at most 3, else the line is part of the body.
    """
    lines = (text or "").splitlines()
    starts: dict[int, int] = {}
    for k, line in enumerate(lines):
        m = _UNIT.match(line)
        if m and len(re.findall(r"(?:^|\s{2,})\d{1,3}\s{2,}[A-Z]", line)) == 1:
            starts[int(m.group(1))] = k
    chosen, last, row = [], None, -1
    for number, k in sorted(starts.items()):
        if (number <= 3 if last is None else number - last <= 3) and k > row:
            chosen.append((number, k))
            last, row = number, k
    out = []
    for j, (number, k) in enumerate(chosen):
        end = chosen[j + 1][1] if j + 1 < len(chosen) else len(lines)
        out.append(Unit(number, _UNIT.match(lines[k]).group(2).strip(), "\n".join(lines[k + 1 : end]).strip()))
    return out


@udtf(returnType="unit_num int, unit_name string, body string")
class SplitUnits:
    """``units_of`` as a table function."""

    def eval(self, text: str | None):
        for u in units_of(text):
            yield u.number, u.name, u.body


def named_slices(text: str | None, names: Sequence[str], least: int = 40) -> list[tuple[str, str]]:
    """(name, body): the text from each known name's first place to the next name; bodies under ``least`` characters are dropped."""
    found = sorted((m.start(), m.end(), n) for n in names if (m := re.search(rf"(?m)^\s*{re.escape(n)}\s*:?", text or "")))
    out = []
    for (_, b, n), nxt in zip(found, [*[f[0] for f in found[1:]], len(text or "")], strict=True):
        body = (text or "")[b:nxt].strip()
        if len(body) >= least:
            out.append((n, body))
    return out


def columns_of(text: str | None, headers: Sequence[str], tolerance: int = 15) -> dict[str, str]:
    """Columns of a layout text: anchors are where the headers stand in their line; each later stretch of text (three blanks apart) goes to the nearest anchor within ``tolerance``."""
    lines = (text or "").splitlines()
    for k, line in enumerate(lines):
        at = {h: line.find(h) for h in headers}
        if all(p >= 0 for p in at.values()):
            break
    else:
        return {}
    parts: dict[str, list[str]] = {h: [] for h in headers}
    for line in lines[k + 1 :]:
        for m in re.finditer(r"\S+(?: {1,2}\S+)*", line):
            name, place = min(at.items(), key=lambda x: abs(x[1] - m.start()))
            if abs(place - m.start()) <= tolerance:
                parts[name].append(m.group(0))
    return {h: " ".join(p) for h, p in parts.items()}


def role_index(columns: Column, names: Sequence[str]) -> Column:
    """The place (from 0) of the first column whose folded head is one of the names; null if none is."""
    folded = F.transform(columns, lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")))
    found = [F.array_position(folded, F.lit(n)) for n in names]
    return F.coalesce(*[F.when(p > 0, p - 1) for p in found])


def is_roster_table(columns: Column, least: int = 3) -> Column:
    """True for a table with at least ``least`` category heads."""
    folded = F.transform(columns, lambda c: F.lower(F.trim(c)))
    return F.size(F.array_intersect(folded, F.array(*[F.lit(x) for x in ("ur", "gen", "sc", "st", "obc", "ews", "pwbd", "pwd")]))) >= least


def merged_tables(tables: DataFrame) -> DataFrame:
    """Table fragments of one file put together: (pdf, table_no, columns, rows).

    A fragment continues the one before it if it has the same head, or no head of
    its own (its columns are then a row).
    """
    w = Window.partitionBy("pdf").orderBy("page", "y")
    rows = tables.withColumn("_before", F.lag("columns").over(w)).withColumn("_headless", F.col("columns").isNull() | (F.size("columns") == 0))
    runs = islands(rows, ["pdf"], [F.col("page"), F.col("y")], ~(F.col("_headless") | (F.col("columns") == F.col("_before"))), "table_no")
    body = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page", "y", "rows"))), lambda x: x["rows"]))
    return runs.groupBy("pdf", "table_no").agg(F.first("columns", ignorenulls=True).alias("columns"), body.alias("rows"))


def areas_by_heading(cell: str | None) -> list[tuple[str | None, str]]:
    """(sub-discipline, areas) of a cell: parts headed 'Name:' at the start, after a full stop or on a new line; a cell without heads is one part."""
    text = cell or ""
    heads = list(re.finditer(r"(?:^|(?<=\. )|(?<=\n))([A-Z][A-Za-z &/-]{2,60}):\s", text))
    if not heads:
        return [(None, " ".join(text.split()))] if text.strip() else []
    out = []
    for m, nxt in zip(heads, [*[h.start() for h in heads[1:]], len(text)], strict=True):
        out.append((m.group(1).strip(), " ".join(text[m.end() : nxt].split()).rstrip(".")))
    return out


def triage(name: Column, text: Column, by_name: Sequence[tuple[str, str]], by_text: Sequence[tuple[str, str]], head: int = 1500) -> Column:
    """The kind of a notice: by the rules for file names, then by those for the start of the text; hardly any text is 'extraction-failed', the rest 'manual-queue'.

    Only the classifying rules look at the first ``head`` characters, as a notice
    states its kind at its head.
    """
    kind = F.lit(None).cast("string")
    low, start = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.substring(F.coalesce(text, F.lit("")), 1, head))
    for label, pattern in reversed(by_text):
        kind = F.when(start.rlike(pattern), label).otherwise(kind)
    kind = F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) < 50, "extraction-failed").otherwise(F.coalesce(kind, F.lit("manual-queue")))
    for label, pattern in reversed(by_name):
        kind = F.when(low.rlike(pattern), label).otherwise(kind)
    return kind
