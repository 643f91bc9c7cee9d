"""Problem 10: pages of keywords, links or tags instead of sentences.

Each text gives eight features: density of links, tags and offers, word entropy,
repetition, share of function words, of sentence ends and of bare numbers. Per
language the robust centre and scatter come from the half of the distinct texts
nearest to the centre. A page of nothing but spam lies at a known place; the line
from the centre to it is a spam direction. A text is spam if its Mahalanobis
distance is that of an outlier, the direction it lies in is one of spam rather than
of rosters or one-liners, and it lies more than half way along it: as the features
are shares of a text, the way travelled is the share of the text that is spam.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.storage import spool, spread

#: Words that hold sentences together, by language.
FUNCTION_WORDS = {
    "en": "a an the of and or to in on at by for from with as is are was were be been it its this that these those not no will shall may can must has have had do does did which who whom if than then their our your we you they he she his her i but so such into under over between within before after during about also only any all each other there when where how what why",
    "hi": "है हैं के का की में से को पर और या हेतु तथा था थे होंगे होगा जो नहीं एक ही कर किए लिए यह",
    "fr": "le la les des du et est une dans pour qui sur au aux avec par plus ne pas ce cette",
    "de": "der die das und ist nicht ein eine den dem mit von zu auf für im des sich auch werden",
    "es": "el los las y que del una es en por con para se al lo como su más",
    "pt": "o os e que do da dos das uma em por com para não se ao como mais",
}
_BY_LANGUAGE = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_GRAMMAR = frozenset().union(*_BY_LANGUAGE.values())
_SCRIPTS = [("hi", "ऀ", "ॿ"), ("arab", "؀", "ۿ"), ("cyrl", "Ѐ", "ӿ"), ("hani", "一", "鿿"), ("taml", "஀", "௿"), ("beng", "ঀ", "৿"), ("telu", "ఀ", "౿")]
LINK = re.compile(r"\[[^\[\]\n]*\]\([^()\s]*\)|<a\s[^<>]*>[^<]*</a>|(?:https?://|www\.)[^\s|)\]>\"]+|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}(?:/[^\s|)\]>\"]*)?", re.I)
_LINKED = re.compile(r"[\w)]\.[A-Za-z]|://|\]\(|<a ")
_PRICE = re.compile(r"(?:\brs\.?|[₹$€£])\s*\d[\d,.]*|\d[\d,.]*\s*/-|-?\d+\s*%|\bsku\s*\w+")
#: What shops call out.
_CALLS = ["buy now", "add to cart", "in stock", "best seller", "best price", "free shipping", "order now"]
_PRICED = re.compile(r"\brs[. ]|[₹$€£%]|/-|\bsku|buy now|add to cart|in stock|best (?:seller|price)|free shipping|order now")
_ENDS = ".!?।"
_EDGE = ".,;:()[]|/•·»—–-*~>\"'“”"

FEATURES = ["links", "tags", "offers", "entropy", "repetition", "grammar", "sentences", "numbers"]
#: Where a page of one kind of spam alone lies, in the order of FEATURES.
SPAM = {
    "keywords": [0.0, 0.0, 0.0, 0.70, 0.60, 0.05, 0.0, 0.0],
    "links": [0.95, 0.0, 0.0, 0.90, 0.20, 0.00, 0.0, 0.0],
    "named links": [0.62, 0.0, 0.0, 0.85, 0.35, 0.03, 0.0, 0.0],
    "tags": [0.0, 0.95, 0.0, 0.75, 0.50, 0.00, 0.0, 0.0],
    "products": [0.0, 0.0, 0.25, 0.80, 0.60, 0.02, 0.0, 0.03],
}
#: Where pages lie that are no prose either and no spam.
OTHERS = {"rosters": [0.0, 0.0, 0.0, 0.65, 0.65, 0.05, 0.0, 0.45], "lines": [0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.1]}
#: The scatter of a feature never counts for less: one that is zero in half of all texts can still be weighed.
FLOOR = np.array([0.03, 0.03, 0.02, 0.05, 0.10, 0.04, 0.02, 0.03])


def language_of(text: str, words: Counter) -> str:
    """The language by script, or 'mixed'; Latin script by function words, English where too few tell."""
    if not text.isascii():
        seen = set(text)
        for name, first, last in _SCRIPTS:
            if any(first <= c <= last for c in seen):
                own = sum(text.count(c) for c in seen if first <= c <= last)
                letters = own + sum(text.count(c) for c in seen if c.isalpha() and not first <= c <= last)
                if own > 0.05 * letters:
                    return name if own > 0.4 * letters else "mixed"
    english = sum(words[w] for w in words.keys() & _BY_LANGUAGE["en"])
    if english >= 0.1 * words.total():
        return "en"
    hits = {k: sum(words[w] for w in words.keys() & own) for k, own in _BY_LANGUAGE.items() if k not in ("hi", "en")}
    best = max(hits, key=hits.get)
    return best if hits[best] >= max(4, 2 * english) else "en"


def measure(text: str) -> tuple:
    """(language, items, the eight features): links, tags and words are counted as items, words two by two, because a keyword has two or more."""
    n_links = link_ink = 0
    rest = text
    if _LINKED.search(text):
        kept, at = [], 0
        for m in LINK.finditer(text):
            n_links += 1
            link_ink += len("".join(m.group(0).split()))
            kept.append(text[at : m.start()])
            at = m.end()
        if n_links:
            rest = " ".join([*kept, text[at:]])
    low = rest.lower()
    tokens = low.split()
    raw = Counter(tokens)
    ink = sum(len(w) * k for w, k in raw.items()) + link_ink or 1
    n_tags = sum(k for w, k in raw.items() if w[0] == "#" and len(w) > 1) if "#" in rest else 0
    offers = sum(len(m.group(0)) for m in _PRICE.finditer(low)) + sum(len(w) * low.count(w) for w in _CALLS) if _PRICED.search(low) else 0
    words: Counter = Counter()
    stops = 0
    for token, k in raw.items():
        if token[-1] in _ENDS:
            stops += k
        if word := token.strip(_EDGE):
            words[word] += k
    n = words.total() or 1
    share = (1 - link_ink / ink) / n
    numbers = sum(k for w, k in words.items() if w[0] in "0123456789" and not (len(w) == 4 and w[:2] in ("19", "20")))
    entropy = 1 - sum(k * math.log(k) for k in words.values() if k > 1) / (n * math.log(n)) if n > 1 else 1.0
    grammar = sum(words[w] for w in words.keys() & _GRAMMAR)
    values = (link_ink / ink, n_tags * share, min(1.0, offers / ink), entropy, 1 - len(words) / n, grammar * share, min(1.0, stops * share), numbers * share)
    return language_of(text, words), n_links + n_tags + n // 2, values


def page_features(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, _text, language, n_items, the features) of each text with a letter or digit; _text is a hash of the text, 96 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t) for t in batch.column(text).to_pylist()]
            columns = [batch.column(key), batch.column("_text"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())]
            columns += [pa.array([r[2][k] for r in rows], pa.float64()) for k in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays(columns, [key, "_text", "language", "n_items", *FEATURES])

    kept = docs.select(key, text, F.struct(F.xxhash64(text).alias("a"), F.hash(text).alias("b")).alias("_text")).where(F.col(text).isNotNull() & F.col(text).rlike(r"[\p{L}\p{N}]"))
    return spread(kept).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, _text struct<a:long,b:int>, language string, n_items int, " + ", ".join(f"{f} double" for f in FEATURES))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES]) if batch.num_rows else np.empty((0, len(FEATURES)))


def _squares(x: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    return np.einsum("ij,jk,ik->i", x, inverse, x)


def _distances(rows: DataFrame, centres: dict) -> DataFrame:
    """(language, d, the features): the squared distance of each row from its language's centre; ``centres`` has one entry for each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, names = _matrix(batch), np.array(batch.column("language").to_pylist(), object)
            d = np.zeros(len(x))
            for name, (centre, inverse) in centres.items():
                mine = names == name
                d[mine] = _squares(x[mine] - centre, inverse)
            yield pa.RecordBatch.from_arrays([batch.column("language"), pa.array(d), *[batch.column(f) for f in FEATURES]], ["language", "d", *FEATURES])

    return rows.select("language", *FEATURES).mapInArrow(run, "language string, d double, " + ", ".join(f"{f} double" for f in FEATURES))


def _moments(rows: DataFrame) -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
    """{language: (n, mean, scatter)}; each task sends its sums by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for batch in batches:
            x, names = _matrix(batch), np.array(batch.column("language").to_pylist(), object)
            for name in set(names):
                own = x[names == name]
                n, first, second = sums.get(name, (0, 0.0, 0.0))
                sums[name] = [n + len(own), first + own.sum(0), second + own.T @ own]
        names = sorted(sums)
        totals = [np.concatenate([sums[k][1], sums[k][2].ravel()]).tolist() for k in names]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[k][0] for k in names], pa.int64()), pa.array(totals, pa.list_(pa.float64()))], ["language", "n", "total"])

    parts = rows.mapInArrow(run, "language string, n long, total array<double>").select("language", "n", F.posexplode("total").alias("pos", "x"))
    found: dict[str, tuple[int, np.ndarray]] = {}
    k = len(FEATURES)
    for r in parts.groupBy("language", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():  # languages x 72
        found.setdefault(r.language, (r.n, np.zeros(k + k * k)))[1][r.pos] = r.x / r.n
    return {s: (n, t[:k], t[k:].reshape(k, k) - np.outer(t[:k], t[:k])) for s, (n, t) in found.items()}


def _by_language(values: dict, default: Column) -> Column:
    column = default
    for name, value in values.items():
        column = F.when(F.col("language") == name, value).otherwise(column)
    return column


def robust_fit(fit: DataFrame, *, rounds: int = 3, least: int = 200) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """{language: (centre, inverse scatter)} over all rows of ``fit``, which holds each distinct text once, so that copies of a page do not become the centre.

    Start: medians and median absolute deviations per language. Then ``rounds``
    concentration steps: mean and scatter of the half with the least distance. A
    language with under ``least`` distinct texts is judged by the commonest one.
    """
    medians = {r.language: r for r in fit.groupBy("language").agg(F.count("*").alias("n"), *[F.percentile_approx(f, 0.5, 10_000).alias(f) for f in FEATURES]).collect()}
    if not medians:
        return {}
    common = max(medians, key=lambda k: (medians[k].n, k))
    own = sorted({k for k in medians if medians[k].n >= least} | {common})
    fit = fit.where(F.col("language").isin(*own))
    gaps = [F.abs(F.col(f) - _by_language({s: F.lit(float(medians[s][f])) for s in own}, F.lit(0.0))).alias(f) for f in FEATURES]
    mads = {r.language: r for r in fit.select("language", *gaps).groupBy("language").agg(*[F.percentile_approx(f, 0.5, 10_000).alias(f) for f in FEATURES]).collect()}
    centres = {s: (np.array([medians[s][f] for f in FEATURES], float), np.diag([1 / max(low, 1.4826 * mads[s][f]) ** 2 for f, low in zip(FEATURES, FLOOR, strict=True)])) for s in own}
    for _ in range(rounds):
        scored = _distances(fit, centres)
        half = {r.language: r.d for r in scored.groupBy("language").agg(F.percentile_approx("d", 0.5, 10_000).alias("d")).collect()}
        for s, (n, mean, cov) in _moments(scored.where(F.col("d") <= _by_language({s: F.lit(float(d)) for s, d in half.items()}, F.lit(0.0)))).items():
            if n >= 20:
                # The nearest half understates the scatter; 2.0 is the usual order of the correction.
                cov = 2.0 * cov
                centres[s] = mean, np.linalg.inv(cov + np.diag(np.maximum(1e-6, FLOOR**2 - np.diag(cov))))
    return {s: centres[s] if s in own else centres[common] for s in medians}


def spam_scores(features: DataFrame, fit: DataFrame, *, key: str, rounds: int = 3) -> DataFrame:
    """(key, n_items, distance, direction, way): the squared robust distance, the direction that the text lies nearest to by the angle in the robust metric, and the way along it (1: as far as a page of nothing else)."""
    centres = robust_fit(fit, rounds=rounds)
    names = [*SPAM, *OTHERS]
    places = np.array([(SPAM | OTHERS)[n] for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, languages = _matrix(batch), np.array(batch.column("language").to_pylist(), object)
            distance, way, best = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x), np.int64)
            for language, (centre, inverse) in centres.items():
                mine = np.flatnonzero(languages == language)
                if len(mine):
                    z, steep = x[mine] - centre, places - centre
                    power = _squares(steep, inverse)
                    along = z @ inverse @ steep.T
                    nearest = (along / np.sqrt(power)).argmax(1)
                    distance[mine], best[mine], way[mine] = _squares(z, inverse), nearest, (along / power)[np.arange(len(mine)), nearest]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("n_items"), pa.array(distance), pa.array([names[b] for b in best], pa.string()), pa.array(way)], [key, "n_items", "distance", "direction", "way"])

    return features.select(key, "n_items", "language", *FEATURES).mapInArrow(run, f"`{key}` {features.schema[key].dataType.simpleString()}, n_items int, distance double, direction string, way double")


def spam_pages(docs: DataFrame, *, key: str = "doc_id", text: str = "text", quantile: float = 20.09, share: float = 0.5, items: int = 8) -> DataFrame:
    """The documents that are outliers in a direction of spam, more than ``share`` of the way to a page of nothing else.

    ``quantile`` is the 99 % point of chi-squared with eight degrees of freedom;
    ``items`` is the least number of keywords, links and tags that a case has.

    Defined cases: null texts and texts without a letter or digit are no spam; null
    keys give no rows; repeated keys give one row; an empty table gives no rows.
    """
    features = spool(page_features(docs.where(F.col(key).isNotNull()), key=key, text=text), "features")
    # The features are a function of the text, so this keeps one row for each text.
    fit = spool(features.select("_text", "language", *FEATURES).distinct(), "texts")
    scored = spam_scores(features, fit, key=key)
    return scored.where((F.col("distance") > quantile) & F.col("direction").isin(*SPAM) & (F.col("way") > share) & (F.col("n_items") >= items)).select(key).distinct()
