"""Texts cut into chunks with offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeworks.storage import spread

_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def chunk_spans(text: str, least: int = 200, most: int = 1200) -> list[tuple[int, int]]:
    """(start, end) of the chunks, in order and without overlap.

    Paragraphs are joined until they hold ``least`` characters; a paragraph over
    ``most`` stands alone and is cut at sentence ends, so that only a sentence longer
    than ``most`` exceeds it. What is pending goes out before a long paragraph; the
    last chunk may be short. Offsets are exact: a chunk is the text between them.
    """
    edges, at = [], 0
    for m in _BLANK.finditer(text):
        edges.append((at, m.start()))
        at = m.end()
    edges.append((at, len(text)))
    paragraphs = []
    for a, b in edges:
        piece = text[a:b]
        if piece.strip():
            paragraphs.append((a + len(piece) - len(piece.lstrip()), b - len(piece) + len(piece.rstrip())))
    spans: list[tuple[int, int]] = []
    pending: tuple[int, int] | None = None
    held = 0
    for a, b in paragraphs:
        if b - a > most:
            if pending:
                spans.append(pending)
                pending, held = None, 0
            stops = [m.end() for m in _SENTENCE.finditer(text, a, b)]
            start = end = a
            for stop, nxt in zip([*stops, b], [*stops, b], strict=True):
                if stop - start > most and end > start:
                    spans.append((start, end))
                    start = end
                end = nxt
            spans.append((start, b))
            continue
        pending = (pending[0] if pending else a, b)
        held += b - a
        if held >= least:
            spans.append(pending)
            pending, held = None, 0
    if pending:
        spans.append(pending)
    out = []
    for a, b in spans:
        piece = text[a:b]
        out.append((a + len(piece) - len(piece.lstrip()), b - len(piece) + len(piece.rstrip())))
    return [(a, b) for a, b in out if b > a]


def chunked(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = 200, most: int = 1200) -> DataFrame:
    """(chunk_id, key, idx, char_start, char_end, chunk). Null and blank texts have no chunks; texts of any length are cut whole."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, t in zip(frame[key], frame[text], strict=True):
                for i, (a, b) in enumerate(chunk_spans(t, least, most)):
                    rows.append((f"{k}#{i}", k, i, a, b, t[a:b]))
            yield pd.DataFrame(rows, columns=["chunk_id", key, "idx", "char_start", "char_end", "chunk"])

    return spread(docs.where(F.col(text).isNotNull()).select(key, text)).mapInPandas(run, f"chunk_id string, `{key}` {docs.schema[key].dataType.simpleString()}, idx int, char_start int, char_end int, chunk string")


def chunk_stats(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    return chunks.agg(F.count("*").alias("n_chunks"), F.count_distinct(key).alias("n_docs"), F.max(F.col("char_end") - F.col("char_start")).alias("longest"))


def chunk_score(chunk: Column, markers: Sequence[str], junk: str | None = None, least: int = 100, foreign: float = 0.15) -> Column:
    """How many markers a chunk holds; 0 if it is short, junk, or largely in Devanagari."""
    low = F.lower(chunk)
    hits = F.lit(0)
    for m in markers:
        hits = hits + F.regexp_count(low, F.lit(m))
    bad = (F.length(chunk) < least) | (F.length(F.regexp_replace(chunk, "[^\\x{0900}-\\x{097F}]", "")) > foreign * F.length(chunk))
    if junk:
        bad = bad | low.rlike(junk)
    return F.when(bad, 0).otherwise(hits)


def picked_chunks(chunks: DataFrame, words: DataFrame, markers: Sequence[str], *, doc: str = "doc_id", head: int = 80, fallback: int = 3) -> DataFrame:
    """(key, doc, idx, how): the chunks that stand for each record (key, doc, words).

    A chunk whose first ``head`` characters name one of the words is taken, the
    earliest of them; else the best-scored chunk that names one anywhere; else the
    ``fallback`` best of the document in their order. Chunks without a score are out.
    """
    scored = chunks.withColumn("score", chunk_score(F.col("chunk"), markers)).where("score > 0").withColumn("low", F.lower("chunk"))
    joined = words.join(scored, doc)
    named = lambda text: F.exists("words", lambda w: text.contains(F.lower(w)))
    tier = F.when(named(F.substring("low", 1, head)), 0).when(named(F.col("low")), 1).otherwise(2)
    ranked = joined.withColumn("tier", tier).withColumn("best", F.min("tier").over(Window.partitionBy("key", doc))).where("tier = best")
    order = [F.when(F.col("tier") == 0, F.col("idx")), F.col("score").desc(), F.col("idx")]
    kept = ranked.withColumn("n", F.row_number().over(Window.partitionBy("key", doc).orderBy(*order))).where(F.col("n") <= F.when(F.col("tier") == 2, fallback).otherwise(1))
    how = F.element_at(F.array(F.lit("head"), F.lit("anywhere"), F.lit("fallback")), F.col("tier") + 1)
    return kept.select("key", doc, "idx", how.alias("how"))


def named_sections(text: str | None, triggers: Sequence[str], stops: Sequence[str] = (), least: int = 40, most: int = 1000) -> dict[str, str]:
    """{name: body} of 'Name: <trigger> ...' sections: a body runs to the next name or stop, at most ``most`` characters, cut at a word; short ones are dropped; of equal names the last counts."""
    either = "|".join(map(re.escape, triggers))
    heads = list(re.finditer(rf"([A-Z][A-Za-z &/-]{{2,60}}):\s+(?=(?:{either}))", text or ""))
    out: dict[str, str] = {}
    for k, m in enumerate(heads):
        body = text[m.end() : heads[k + 1].start() if k + 1 < len(heads) else len(text)]
        for stop in stops:
            body = body.split(stop)[0]
        body = " ".join(body.split())
        if len(body) > most:
            body = body[:most].rsplit(" ", 1)[0]
        if len(body) >= least:
            out[m.group(1).strip()] = body
    return out
