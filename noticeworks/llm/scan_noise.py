"""Problem 1: noise of scanned pages found and repaired.

Words are counted over all texts; the common ones, whose number is bounded by
their least share of the corpus, are the lexicon. A text is stripped of running
headers and page numbers, its lines are joined to one stream, and around every
word that the lexicon lacks the stream is decoded: a lattice of spans of written
pieces, joined over hyphens or gaps, split, or with misrecognised characters
undone, each at a cost, and the cheapest path wins. Running headers are known by
their usual forms and learned from the lines that break a source's sentences. Paragraph breaks
are chosen by dynamic programming over the line ends.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.storage import spool, spread

#: What a scanner reads for what is printed.
CONFUSIONS = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("+", "t"), ("@", "a"), ("|", "l"), ("!", "l"), ("$", "s"), ("€", "e"),
    ("ri", "n"), ("ii", "n"), ("ii", "u"), ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("c", "e"), ("e", "c"), ("q", "g"), ("g", "q"), ("l", "i"), ("i", "l"), ("b", "h"), ("h", "b"), ("u", "ii"), ("n", "ri"), ("li", "h"), ("tl", "d"), ("f", "t"),
    ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"),
]
LIGATURES = "ﬀﬁﬂﬃﬄ"
HYPHENS = "-‐‑¬\xad"
#: The lexicon holds at most so many words, the commonest by distinct texts and by rows, which bounds the broadcast; a word of fewer occurrences is none.
MOST_WORDS = 1_000_000
MIN_COUNT = 4
#: A line is a running header of its source if it breaks sentences in so many texts of it, after and before as many different words.
HEADER_TEXTS = 3
#: A word this many times rarer than the word it becomes by undone confusions is no lexicon word.
RARER = 25
#: What no printed word has: ligatures, and confused digits or symbols inside letters.
_NEVER = re.compile(rf"[{LIGATURES}]|[^\W\d_][015689+@|!$€]+[^\W\d_]")
#: The same before or after letters: numbers like 5g and 1st have them, a misread word has a commoner form of letters alone.
_BESIDE = re.compile(r"^[015689+@|!$€]+[^\W\d_]|[^\W\d_][015689+@|!$€]+$")
_EDGE = ".,;:!?()[]{}\"'“”‘’<>*"

_CODE = r"[A-Z]{2,6}/\d{1,4}/\d{2,4}"
_CAPS = r"[A-Z][A-Z&.'’-]+(?:\s+(?:[A-Z][A-Z&.'’-]+|&)){1,7}"
#: The usual forms of running headers and of page numbers.
HEADER = re.compile(
    rf"(?:Advertisement|Advt\.?|Notification|Notice)\s+No\.?\s+{_CODE}\s+\(contd\.?\)"
    rf"|[A-Z][\w.&]*(?:\s+[\w.&]+){{0,7}}?\s+-\s+(?:\w+\s+)?Recruitment\s+Notice"
    rf"|Information\s+Brochure,\s+[A-Z][\w&]*(?:\s+(?:of|and|[A-Z][\w&]*)){{1,7}}"
    rf"|[A-Z][\w&]*(?:\s+(?:of|and|[A-Z][\w&]*)){{0,7}}\s+\|\s+Recruitment\s+{_CODE}"
    rf"|{_CAPS}(?:\s+{_CODE})?"
)
PAGE_LINE = re.compile(r"\x0c?\s*(?:page|pg\.?|p\.)\s*\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?|\x0c?\s*[-–—]\s*\d{1,4}\s*[-–—]|\[\d{1,4}\]|\d{1,4}\s*\|\s*P\s?a\s?g\s?e|\x0c?\d{1,4}\s*/\s*\d{1,4}|\x0c?\s*\d{1,4}", re.I)
PAGE_INLINE = re.compile(r"\x0c\s*\d{1,4}\b|(?<!\S)(?:Pg\.\s*\d{1,4}|[Pp]age\s+\d{1,4}\s*(?:of|/)\s*\d{1,4}|\d{1,4}\s+\|\s+P a g e|[-–—]\s\d{1,4}\s[-–—]|\[\d{1,4}\]|\d{1,3}/\d{1,3})(?!\S)")
PAGE_WEAK = re.compile(r"(?<!\S)([Pp]age \d{1,4}|\d{1,3})(?!\S)")
_BREAK = re.compile(rf"(?<=[^\W\d_])[{HYPHENS}](?:\s*[\r\n]+\s*|\s+)(?=[^\W\d_])")
_LINES = re.compile(r"\r\n|\r|\n")
_SUSPECT = re.compile(rf"[{LIGATURES}\x0c|{HYPHENS[1:]}]|[{HYPHENS}]\s|[A-Z]{{3,}}\s+[A-Z]{{3,}}|\(contd|Recruitment Notice|Information Brochure|\bRecruitment {_CODE}|(?<!\S)(?:[Pp]age|Pg\.|\[?\d{{1,4}}\]?|\d+/\d+)(?!\S)")


def core(token: str) -> str:
    return token.strip(_EDGE).lower()


def undone(word: str, depth: int = 1) -> Iterator[tuple[str, int]]:
    """The word with one, or up to ``depth``, confusions undone."""
    for seen, meant in CONFUSIONS:
        at = word.find(seen)
        while at >= 0:
            better = word[:at] + meant + word[at + len(seen) :]
            yield better, 1
            if depth > 1:
                for more, n in undone(better, depth - 1):
                    yield more, n + 1
            at = word.find(seen, at + 1)


@dataclass
class Lexicon:
    """The common words with the natural logarithm of their share, and the words that numbers stand beside."""

    share: dict[str, float]
    numbers: set[str]
    memo: dict[str, tuple[str, float] | None] = field(default_factory=dict)
    raw: set[str] = field(default_factory=set)
    longest: int = 0

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.share), default=0)

    @classmethod
    def of(cls, counts: dict[str, int], total: int, rows: dict[str, int] | None = None) -> Lexicon:
        """The lexicon of ``counts`` over distinct texts; ``rows`` counts every copy of a text.

        A word is held against its undone forms, as deep as ``repair`` looks for them,
        by distinct texts: copies of a misread page say nothing for its misreadings. One
        in too few distinct texts to be judged is dropped for any commoner undone form.
        """
        rows = counts if rows is None else rows
        words = {w: n for w, n in counts.items() if w[0] > "\x02"}
        keep = {}
        for w, n in words.items():
            if _NEVER.search(w):
                continue
            forms = [(v, words[v]) for v, _ in undone(w, 2 if cls.deep(w) else 1) if v in words]
            rarer = RARER if n >= MIN_COUNT else 1 + 1 / n
            if any(m >= rarer * n or m > n and v.isalpha() and _BESIDE.search(w) for v, m in forms):
                continue
            keep[w] = math.log(n / max(1, total))
        numbers = set()
        for key, n in counts.items():
            if key[0] <= "\x02":
                beside = words.get(key[2:].split("|", 1)[1], 0)
                if rows[key] >= 3 and n >= (0.02 if n >= 3 else 0.25) * beside:
                    numbers.add(key)
        return cls(keep, numbers)

    @staticmethod
    def deep(word: str) -> bool:
        """True for words in which two confusions are looked for."""
        return len(word) > 5 or not word.isascii() or not word.isalpha()

    def knows(self, token: str) -> bool:
        """True for lexicon words, numbers, addresses and compounds of lexicon words."""
        if token in self.raw:
            return True
        word = core(token)
        good = not word or word in self.share or not any(c.isalpha() for c in word) or "://" in word or "@" in word and "." in word.split("@", 1)[1] or word.startswith("www.")
        if not good and ("-" in word or "/" in word):
            parts = [p for p in re.split("[-/]", word) if p]
            good = all(p in self.share or not any(c.isalpha() for c in p) for p in parts)
            good = good or any(p.isdigit() for p in parts) and all(len(p) < 5 for p in parts)
        if not good and word.endswith(("'s", "’s")):
            good = word[:-2] in self.share
        if good and len(self.raw) < 400_000:
            self.raw.add(token)
        return good

    def repair(self, word: str) -> tuple[str, float] | None:
        """The likeliest lexicon word that the written one is by one or two confusions, with its cost."""
        if word in self.memo:
            return self.memo[word]
        best = None
        if 2 < len(word) <= self.longest + 2:  # an undone form is at most two letters shorter
            found = [(n * 4.0 - self.share[v], v) for v, n in undone(word) if v in self.share]
            if not found and self.deep(word):
                found = [(n * 4.0 - self.share[v], v) for v, n in undone(word, 2) if v in self.share]
            if found:
                cost, v = min(found)
                best = (v, cost)
        if len(self.memo) < 400_000:
            self.memo[word] = best
        return best

    def unknown(self, word: str) -> float:
        """The cost of a word that the lexicon lacks."""
        return 14.0 + 0.8 * len(word)


@dataclass
class Repaired:
    paragraphs: list[str]
    kinds: set[str]


def _case_like(written: str, word: str) -> str:
    if written[:1].isupper():
        return word.upper() if len(written) > 1 and written.isupper() else word[:1].upper() + word[1:]
    return word


def decode(pieces: list[tuple[str, str]], lexicon: Lexicon) -> tuple[list[str], set[str]]:
    """The cheapest reading of written pieces, each with the mark after it: '-' a hyphen at a gap, ' ' a gap.

    A span of pieces is one word if joined pieces form one, however many, as long as
    the lexicon has words of their length; a lone piece can be a lexicon word, a word with confusions undone, two lexicon words
    written together, or unknown.
    """
    n = len(pieces)
    best = [math.inf] * (n + 1)
    back: list[tuple[int, str, set[str]] | None] = [None] * (n + 1)
    best[0] = 0.0

    def offer(i: int, j: int, cost: float, text: str, kinds: set[str]) -> None:
        if best[i] + cost < best[j]:
            best[j], back[j] = best[i] + cost, (i, text, kinds)

    for i in range(n):
        if best[i] == math.inf:
            continue
        size = 0
        for j in range(i + 1, n + 1):
            size += len(pieces[j - 1][0])
            if j > i + 1 and (size > lexicon.longest + 6 or j > i + 3 and not all(p[0].isalpha() for p in pieces[i : j - 1])):
                break  # longer than any word with its marks
            span = pieces[i:j]
            hyphens = sum(mark == "-" for _, mark in span[:-1])
            gaps = j - i - 1 - hyphens
            written = "".join(p for p, _ in span)
            head = written[: len(written) - len(written.lstrip(_EDGE))]
            tail = written[len(written.rstrip(_EDGE)) :] if written.rstrip(_EDGE) else ""
            word = core(written)
            if j > i + 1 and (any(p[-1] in _EDGE for p, _ in span[:-1]) or any(p[0] in _EDGE for p, _ in span[1:])):
                continue
            joins = 1.5 * hyphens + 9.0 * gaps
            kinds = {"hyphen"} if hyphens else set()
            body = written[len(head) : len(written) - len(tail)]
            if j == i + 1 and lexicon.knows(written):
                offer(i, j, -lexicon.share.get(word, -9.0), written, kinds)
            elif word in lexicon.share:
                offer(i, j, joins - lexicon.share[word], head + body + tail, kinds)
            elif not (gaps and any(lexicon.knows(p) for p, _ in span)) and (fixed := lexicon.repair(word)):
                offer(i, j, joins + fixed[1], head + _case_like(body, fixed[0]) + tail, kinds | {"misread"})
            elif j > i + 1 and hyphens and word.isalpha():
                whole = "-".join(core(p) for p, _ in span)
                if whole in lexicon.share:
                    offer(i, j, joins - lexicon.share[whole], head + whole + tail, set())
                else:
                    offer(i, j, joins + lexicon.unknown(word), written, kinds)
            elif j == i + 1:
                offer(i, j, lexicon.unknown(word), written, kinds)
                if word.isalpha() and len(word) > 6:
                    for k in range(3, len(word) - 2):
                        a, b = word[:k], word[k:]
                        if a in lexicon.share and b in lexicon.share:
                            offer(i, j, 9.0 - lexicon.share[a] - lexicon.share[b], head + body[:k] + " " + body[k:] + tail, kinds)
            if j == i + 1 and pieces[i][1] == "-" and not lexicon.knows(written):
                offer(i, j, lexicon.unknown(word) + 2.0, written + "-", set())
            elif j == i + 1 and pieces[i][1] == "-":
                offer(i, j, 6.0 - lexicon.share.get(word, -9.0), written + "-", set())
    words, kinds, j = [], set(), n
    while j:
        i, text, found = back[j]
        words.append(text)
        kinds |= found
        j = i
    return words[::-1], kinds


def is_header(line: str, before: str, after: str) -> bool:
    """A line that is a running header as a whole; capitals only where the neighbours are not in capitals."""
    line = line.strip()
    if len(line) < 8 or not HEADER.fullmatch(line):
        return False
    if line.upper() == line:
        words = re.findall(r"[A-Z]+", re.sub(_CODE, "", line))
        if max(map(len, words)) < 5 or any(x.strip() and x.strip().upper() == x.strip() and re.search("[A-Z]{3}", x) and not HEADER.fullmatch(x.strip()) for x in (before, after)):
            return False
    return True


def strip_inline(text: str, lexicon: Lexicon) -> tuple[str, set[str]]:
    """Headers and page numbers cut out of a line, with the kinds found."""
    kinds: set[str] = set()

    def header(m: re.Match) -> str:
        found = m.group(0)
        if found.upper() == found:
            bare = re.sub(_CODE, "", found)
            words = re.findall(r"[A-Z]{2,}", bare)
            left, right = text[max(0, m.start() - 40) : m.start()].rstrip(), text[m.end() : m.end() + 40].lstrip()
            if len(words) < 2 or sum(map(len, words)) < 10 or max(map(len, words)) < 5 or re.search(r"[A-Z]{2}\W*$", left[-8:]) or re.match(r"\W*[A-Z]{2}", right[:8]) or right[:1] in ".,;:)" or not left:
                return found
        elif m.start() == 0 and m.end() == len(text):
            return found
        kinds.add("header")
        return " "

    out = _INLINE_HEADER.sub(header, text)

    def page(m: re.Match) -> str:
        kinds.add("pageno")
        return " "

    out = PAGE_INLINE.sub(page, out)
    if "header" in kinds or "age " in out or any(c.isdigit() for c in out):

        def weak(m: re.Match) -> str:
            left, right = out[max(0, m.start() - 80) : m.start()].split(), out[m.end() : m.end() + 80].split()
            if not left or not right:
                return m.group(0)
            kind = "p" if m.group(1)[0] in "pP" else "n"
            a, b = core(left[-1]), core(right[0])
            if left[-1][-1] in ":/" or f"\x01{kind}|{a}" in lexicon.numbers or f"\x02{kind}|{b}" in lexicon.numbers:
                return m.group(0)
            if not (a in lexicon.share and b in lexicon.share) or right[0][:1].isupper() and left[-1][-1] not in ".!?":
                return m.group(0)
            kinds.add("pageno")
            return " "

        out = PAGE_WEAK.sub(weak, out)
    return (out if kinds else text), kinds


_INLINE_HEADER = re.compile(
    rf"(?<!\S)(?:(?:Advertisement|Advt\.?)\s+No\.?\s+{_CODE}\s+\(contd\.?\)"
    rf"|(?:[A-Z][\w.&]*\s+){{1,7}}?-\s+(?:Faculty\s+)?Recruitment\s+Notice"
    rf"|Information\s+Brochure,(?:\s+(?:[A-Z][\w&]*|of(?=\s+[A-Z])|and(?=\s+[A-Z]))){{2,7}}"
    rf"|(?:(?:[A-Z][\w&]*|of|and)\s+){{1,7}}\|\s+Recruitment\s+{_CODE}"
    rf"|{_CAPS}(?:\s+{_CODE})?)(?!\S)"
)


def paragraph_breaks(lines: list[str]) -> list[bool]:
    """For each line whether a paragraph ends after it: the cheapest labelling of the gaps, by dynamic programming.

    A break is cheap after a blank line, an end mark before a capital, or a short
    line; it is dear inside a sentence. Two breaks one line apart cost extra.
    """
    widths = sorted(len(x) for x in lines if x.strip())
    usual = widths[int(0.75 * (len(widths) - 1))] if widths else 0
    n = len(lines)
    costs = []
    for i in range(n - 1):
        here, nxt = lines[i].rstrip(), lines[i + 1].lstrip()
        if not here.strip() or not nxt:
            costs.append(0.0)
            continue
        cost = 4.0
        cost += -1.0 if here[-1] in ".!?:।" else 5.0
        cost += -1.0 if nxt[:1].isupper() or nxt[:1] in "•-*" else 4.0
        cost += -2.5 if len(here) < 0.6 * usual else 1.5
        if i and not lines[i - 1].strip():
            cost += 1.0
        costs.append(cost)
    keep = 2.0
    state = {False: 0.0, True: 0.5}
    trace = []
    for i, cost in enumerate(costs):
        blank = not lines[i].strip() or not lines[i + 1].strip()
        step, new = {}, {}
        for broken in (False, True):
            options = [(state[last] + (cost + (1.0 if last and not blank else 0.0) if broken else (9.0 if blank else keep)), last) for last in (False, True)]
            new[broken], step[broken] = min(options)
        trace.append(step)
        state = new
    labels, at = [], min(state, key=state.get)
    for step in reversed(trace):
        labels.append(at)
        at = step[at]
    return [*labels[::-1], True]


def repair(text: str, lexicon: Lexicon, headers: tuple[str, ...] = ()) -> Repaired:
    """Continuous paragraphs of a scanned text, and the kinds of noise that were in it; ``headers`` are the forms of its source's running headers."""
    kinds: set[str] = set()
    whole, within = header_patterns(headers) if headers else (None, None)
    lines = _LINES.split(text)
    kept: list[str] = []
    if len(lines) > 1:
        for i, line in enumerate(lines):
            bare = line.strip(" \t")
            before = lines[i - 1] if i else ""
            after = lines[i + 1] if i + 1 < len(lines) else ""
            if bare and PAGE_LINE.fullmatch(bare):
                kinds.add("pageno")
            elif is_header(bare, before, after) or whole and whole.fullmatch(bare):
                kinds.add("header")
            else:
                kept.append(line)
    else:
        kept = lines
    clean = []
    for line in kept:
        if within and within.search(line):
            line = within.sub(" ", line)
            kinds.add("header")
        out, found = strip_inline(line, lexicon)
        kinds |= found
        clean.append(out)
    ends = paragraph_breaks(clean) if len(clean) > 1 else [True]
    paragraphs, current = [], []
    for line, end in zip(clean, ends, strict=True):
        if line.strip():
            current.append(line.strip())
        if end and current:
            paragraphs.append(current)
            current = []
    if current:
        paragraphs.append(current)
    out = []
    for block in paragraphs:
        pieces: list[list[str]] = []
        for line in block:
            tokens = line.split()
            for token in tokens:
                pieces.append([token, " "])
        for k, piece in enumerate(pieces[:-1]):
            token = piece[0]
            if len(token) > 1 and token[-1] in HYPHENS and token[-2].isalpha() and pieces[k + 1][0][0].isalpha():
                following = core(pieces[k + 1][0])
                if token[-1] == "-" and following in ("and", "or", "to"):
                    continue
                piece[0], piece[1] = token[:-1], "-"
        marks = [p[1] == "-" or not lexicon.knows(p[0]) for p in pieces]
        words, k = [], 0
        while k < len(pieces):
            if not marks[k] and (k + 1 == len(pieces) or not marks[k + 1] or pieces[k][1] == "-"):
                words.append(pieces[k][0])
                k += 1
                continue
            # A run of unknown pieces with the known one before it and the one after, to which halves may belong.
            stop = k if marks[k] else k + 1
            while stop < len(pieces) and (marks[stop] or stop > k and pieces[stop - 1][1] == "-"):
                stop += 1
            if stop < len(pieces) and (stop + 1 == len(pieces) or not marks[stop + 1]):
                stop += 1
            found_words, found = decode([tuple(p) for p in pieces[k:stop]], lexicon)
            words += found_words
            kinds |= found
            k = stop
        out.append(" ".join(words))
    return Repaired(out, kinds)


def noisy_at_sight(text: str, lexicon: Lexicon, headers: tuple[str, ...] = ()) -> bool:
    """False only for a text that ``repair`` would leave without a kind of noise."""
    if "\n" in text or "\r" in text or _SUSPECT.search(text):
        return True
    if headers and (within := header_patterns(headers)[1]) and within.search(text):
        return True
    return any(not lexicon.knows(t) for t in set(text.split()) - lexicon.raw)


def word_counts(texts: DataFrame, *, flush: int = 200_000) -> DataFrame:
    """(word, n, n_rows): words over all distinct texts and over all rows, and under \\x01 and \\x02 the words before and after numbers; counted within partitions first."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw: Counter = Counter()
        beside: Counter = Counter()
        raw_more: Counter = Counter()
        beside_more: Counter = Counter()

        def merged(raw: Counter, beside: Counter) -> Counter:
            words: Counter = Counter(beside)
            for token, n in raw.items():
                word = core(token)
                if word and any(c.isalpha() for c in word):
                    words[word] += n
            return words

        def rows() -> pd.DataFrame:
            words, more = merged(raw, beside), merged(raw_more, beside_more)
            return pd.DataFrame({"word": list(words), "n": list(words.values()), "n_rows": [n + more.get(w, 0) for w, n in words.items()]})

        for frame in frames:
            for text, copies in zip(frame["text"], frame["copies"], strict=True):
                tokens = text.split()
                raw.update(tokens)
                if copies > 1:
                    for token, n in Counter(tokens).items():
                        raw_more[token] += n * (copies - 1)
                for k, token in enumerate(tokens):
                    if len(token) < 4 and token.isdigit() and 0 < k < len(tokens) - 1:
                        page = tokens[k - 1] in ("page", "Page") and k > 1
                        kind, a = ("p", tokens[k - 2]) if page else ("n", tokens[k - 1])
                        for key in (f"\x01{kind}|{core(a)}", f"\x02{kind}|{core(tokens[k + 1])}"):
                            beside[key] += 1
                            if copies > 1:
                                beside_more[key] += copies - 1
            if len(raw) > flush:
                yield rows()
                raw, beside, raw_more, beside_more = Counter(), Counter(), Counter(), Counter()
        if raw:
            yield rows()

    distinct = spread(texts.select("text").where("text is not null")).groupBy("text").agg(F.count("*").alias("copies"))
    return distinct.mapInPandas(count, "word string, n long, n_rows long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_rows").alias("n_rows"))


def build_lexicon(texts: DataFrame) -> Lexicon:
    """The lexicon of all texts: words common over distinct texts or over rows; at most 2 / MIN_SHARE words and as many neighbours of numbers reach the driver."""
    counts = spool(word_counts(texts), "words")
    total = counts.where("word > '\x02~'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kept = counts.where((F.col("n") >= MIN_COUNT) | (F.col("n_rows") >= MIN_COUNT))
    if kept.count() > MOST_WORDS:  # the top of two orders, each kept within tasks first
        kept = kept.orderBy(F.col("n").desc(), "word").limit(MOST_WORDS // 2).unionByName(kept.orderBy(F.col("n_rows").desc(), "word").limit(MOST_WORDS // 2)).distinct()
    common = kept.toPandas()
    return Lexicon.of(dict(zip(common["word"], common["n"].astype(int), strict=True)), int(total), dict(zip(common["word"], common["n_rows"].astype(int), strict=True)))


def header_form(line: Column) -> Column:
    """A line with codes as @ and numbers as #, squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"[A-Z]{2,6}/\d{1,4}/\d{2,4}", "@"), r"\d+", "#"), r"\s+", " "))


def running_headers(texts: DataFrame, *, least: int = HEADER_TEXTS) -> DataFrame:
    """(source, headers): for each source the forms of the lines that break its sentences.

    A line breaks a sentence if the line before has no end mark and the line after
    starts in lower case; page numbers between them do not count. A wrapped line of
    the text does so too, but stands where its sentence has it: a header follows, and
    is followed by, ``least`` different words at least, over distinct texts.
    """
    lines = F.filter(F.split("text", r"\r\n|\r|\n"), lambda x: (F.trim(x) != "") & ~x.rlike(f"(?i)^\\s*(?:{PAGE_LINE.pattern})\\s*$"))
    each = texts.where("source is not null and text rlike '[\\r\\n]'").select("source", "text").distinct().select("source", lines.alias("l")).where("size(l) > 2")
    three = each.select("source", F.explode(F.expr("transform(sequence(1, size(l) - 2), i -> struct(l[i - 1] AS before, l[i] AS line, l[i + 1] AS after))")).alias("x")).select("source", "x.*")
    breaks = three.where(F.col("line").rlike(r"^\s*[A-Z0-9(\[|]") & F.col("after").rlike(r"^\s*\p{Ll}") & ~F.col("before").rlike(r"[.!?:।]\s*$") & (F.length(F.trim("line")) >= 8))
    forms = breaks.select("source", header_form(F.col("line")).alias("form"), F.lower(F.regexp_extract("before", r"(\S+)\s*$", 1)).alias("a"), F.lower(F.regexp_extract("after", r"^\s*(\S+)", 1)).alias("b"))
    kept = forms.groupBy("source", "form").agg(F.count_distinct("a").alias("na"), F.count_distinct("b").alias("nb")).where((F.col("na") >= least) & (F.col("nb") >= least))
    return kept.groupBy("source").agg(F.array_sort(F.collect_list("form")).alias("headers"))


@lru_cache(maxsize=5000)
def header_patterns(forms: tuple[str, ...]) -> tuple[re.Pattern | None, re.Pattern | None]:
    """Patterns of a source's headers, for a whole line and within a line; within a line only forms of capitals, with a mark, or of four words or more tell a header from a mention."""

    def pattern(chosen: list[str]) -> re.Pattern | None:
        parts = [re.escape(f).replace(r"\ ", r"\s+").replace(" ", r"\s+").replace("@", _CODE).replace(r"\#", r"\d+").replace("#", r"\d+") for f in sorted(chosen, key=lambda f: (-len(f), f))]
        return re.compile("(?:" + "|".join(parts) + ")") if parts else None

    inside = [f for f in forms if f.upper() == f or re.search(r"[|,:(@#]", f) or len(f.split()) >= 4]
    found = pattern(inside)
    return pattern(list(forms)), re.compile(rf"(?<!\S){found.pattern}(?!\S)") if found else None


def scanned_texts(ads: DataFrame, positions: DataFrame) -> DataFrame:
    """(table_name, rec_key, field_name, source, text) of the fields of problem 1; a repeated row is one record."""
    a = ads.where("id is not null").select(F.lit("job_ads").alias("table_name"), F.col("id").alias("rec_key"), F.col("institution_id").alias("source"), F.lit("pdf_excerpt").alias("field_name"), F.col("pdf_excerpt").alias("text"))
    p = positions.where("position_id is not null").select(
        F.lit("extracted_positions").alias("table_name"),
        F.col("position_id").cast("string").alias("rec_key"),
        F.col("institution_id").alias("source"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("t")) for f in ("raw_section_text", "areas_text")])).alias("x"),
    )
    return a.unionByName(p.select("table_name", "rec_key", "source", F.col("x.f").alias("field_name"), F.col("x.t").alias("text"))).where(F.col("text").isNotNull() & F.col("text").rlike(r"\S"))


def repair_texts(texts: DataFrame, *, all_rows: bool = True) -> DataFrame:
    """(table_name, rec_key, field_name, repaired, kinds) of each text.

    ``repaired`` is the text in paragraphs, split by blank lines. With
    ``all_rows=False`` only texts with noise come out, without the repaired text.

    Defined cases: null and blank texts give no rows; clean texts come out as they
    are but for line wrapping; a text of any length is repaired whole; repeated rows
    give repeated rows; an empty table gives no rows.
    """
    if "source" not in texts.columns:
        texts = texts.withColumn("source", F.lit(None).cast("string"))
    texts = texts.select("table_name", "rec_key", "field_name", "source", "text")
    lexicon = build_lexicon(texts)
    sent = texts.sparkSession.sparkContext.broadcast(lexicon)
    headed = spread(texts).join(spool(running_headers(texts), "headers"), "source", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = sent.value
        for frame in frames:
            rows = []
            for table, key, name, text, own in zip(frame["table_name"], frame["rec_key"], frame["field_name"], frame["text"], frame["headers"], strict=True):
                headers = tuple(own) if own is not None else ()
                if not all_rows and not noisy_at_sight(text, words, headers):
                    continue
                done = repair(text, words, headers)
                if all_rows or done.kinds:
                    rows.append((table, key, name, "\n\n".join(done.paragraphs) if all_rows else None, sorted(done.kinds)))
            yield pd.DataFrame(rows, columns=["table_name", "rec_key", "field_name", "repaired", "kinds"])

    return headed.select("table_name", "rec_key", "field_name", "text", "headers").mapInPandas(run, "table_name string, rec_key string, field_name string, repaired string, kinds array<string>")


def noise_kinds(texts: DataFrame) -> DataFrame:
    """(table_name, rec_key, field_name, noise_kind): one row for each kind in a field."""
    found = repair_texts(texts, all_rows=False)
    return found.select("table_name", "rec_key", "field_name", F.explode("kinds").alias("noise_kind")).distinct()
