"""Problem 2: template residue, filler, error pages and demands for scripts.

Texts fall into messages (sentences or lines, or whole list elements). Numbers,
addresses, dates and slots are masked and equal messages are grouped across sources.
Only messages that recur in several sources are classified, by phrase rules; slots
are classified by the style of their brackets, which must recur likewise. Recurring
messages that no rule knows are judged by their words, which are weighed by the
messages that rules know. Filler words are learned from the messages that they fill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.storage import spool, spread

#: How an unfilled slot is written. A slot holds a name of letters, digits and _ or an instruction; single letters are mathematics.
_NAME = r"(?:(?:insert|enter|type|add|put|your)\s+[a-z][a-z0-9#_ ]{1,60}?(?:\s+here)?|[a-z]{2,}(?:_[a-z0-9#]+)*)"
_STRICT = r"(?:(?:insert|enter|type|add|put|your)\s+[a-z][a-z0-9#_ ]{1,60}?(?:\s+here)?|[a-z]{2,}(?:_[a-z0-9#]+)+)"
_KNOWN = r"(?:title|name|institution|department|subject|topic|area|date|body|eligibility|campus|applicant|contact|specialisation|specialization|text|value|field|email|phone|address|number|url|link)"
SLOTS = [
    rf"\{{\{{\s*{_NAME}\s*\}}\}}",
    rf"\$\{{\s*{_NAME}\s*\}}",
    rf"#\{{\s*{_NAME}\s*\}}",
    rf"\{{%\s*{_NAME}\s*%\}}",
    rf"<<\s*{_NAME}\s*>>",
    rf"@@\s*{_NAME}\s*@@",
    rf"\[\[\s*{_NAME}\s*\]\]",
    rf"__\s*{_NAME}\s*__",
    rf"%(?:{_STRICT}|{_KNOWN})%",
    rf"<\s*(?:{_STRICT}|{_KNOWN}(?:_[a-z0-9#]+)?)\s*>",
    rf"&lt;\s*{_NAME}\s*&gt;",
    rf"\[\s*(?:{_STRICT}|{_KNOWN}(?:_[a-z0-9#]+)?)\s*\]",
    rf"\{{\s*(?:{_STRICT}|{_KNOWN}(?:_[a-z0-9#]+)?)\s*\}}",
]
#: What pages and programs say when they fail.
FAILURES = [
    r"(?<![\w#])# not found\b", r"(?<![\w-])(?:page|file|url|resource) not found(?![\w-])", r"not found on this server", r"\binternal server error\b", r"\bbad gateway\b", r"\bgateway time-?out\b",
    r"\bserver did not respond\b", r"\bservice (?:is )?(?:temporarily )?unavailable\b(?!\s+for)", r"^\W*(?:access (?:is )?denied|forbidden|unauthori[sz]ed)\W*$", r"\byou do not have permission to\b", r"\bhttp error\b", r"\berror #: ", r"\bserver error in\b",
    r"\bruntime error\b", r"\bobject reference (?:is )?not set\b", r"\bunexpected condition\b", r"\b(?:mysql|database|db|sql)\b.{0,30}\b(?:failed|could not be established|refused|error)\b",
    r"\byour session has (?:expired|timed out)\b", r"\bsession (?:expired|timed out)\b", r"\btoo many requests\b", r"\byour (?:ip )?address has been blocked\b", r"\bthe page you are looking for\b", r"\b(?:could not|cannot|can't) find (?:that|the|this) page\b",
    r"\bsite is under (?:maintenance|construction)\b", r"\bupstream host\b", r"\[object object\]", r"#ref!", r"#n/a\b", r"#value!", r"#name\?", r"\btraceback \(most recent", r"\bfatal error:", r"\bstack trace\b", r"\bnull ?pointer ?exception\b", r"^\W*(?:undefined|null|nan|none|n/a)(?:\W+(?:undefined|null|nan|none|n/a))+\W*$", r"^\W*(?:undefined|nan)\W*$",
    r"^warning: .{0,60}\bline #", r"\.php line #",
]
#: How pages ask for scripts.
SCRIPTS = [
    r"\b(?:enable|activate|allow|turn on|switch on)\s+(?:java)?scripts?\b", r"\b(?:java)?scripts?(?: and cookies)? (?:must|need to|has to|have to) be (?:on|active|enabled|allowed)\b", r"\b(?:java)?scripts? (?:is|are) (?:disabled|required|turned off|not enabled|switched off)\b",
    r"\bthis (?:site|page|app|application) (?:requires|needs) (?:java)?scripts?\b", r"\bbrowser does not (?:support|run|allow) (?:java)?scripts?\b", r"^\W*noscript\b", r"\bneeds active scripting\b", r"\bverifying that you are human\b", r"\bchecking your browser before\b", r"\bscripts must be (?:on|active)\b",
]
#: Filler that stands where content should.
FILLERS = [
    r"\bdummy text\b", r"\b(?:your|type|enter|add) (?:text|content|title|area|description|name) here\b", r"\b(?:text|title|description|content|area #|area|name|item #) goes here\b", r"\bsample (?:content|text|title|area)(?: #| for\b|\W*$)", r"\btest test\b", r"\basdf\b", r"\bqwer(?:ty)?\b", r"\bhello world\b",
    r"\b(?:text|content|details|description) (?:to be|will be) (?:supplied|added|provided|inserted|entered|updated)\b", r"\bclick edit to\b", r"\breplace before publishing\b", r"^\W*x{2,}(?:\s+x{2,})*\W*$", r"\bxx\b", r"\bto be (?:filled|completed) in later\b", r"^\W*(?:tbd|tba|todo|to be announced)\W*$", r"\btest area #",
]
#: The stems of the usual filler Latin.
LATIN = ["lore", "ipsu", "dolo", "amet", "cons", "adip", "elit", "temp", "inci", "labo", "magn", "aliq", "enim", "veni", "quis", "nost", "exer", "ulla", "nisi", "duis", "aute", "irur", "repr", "volu", "veli", "esse", "cill", "fugi", "null", "pari", "exce", "sint", "occa", "cupi", "proi", "sunt", "culp", "offi", "dese", "moll", "anim"]


#: Fixed value: words of which a sentence or a list of topics has at least one.
_GRAMMAR = r"\b(?:the|of|is|are|to|for|and|in|a|an|by|on|at|will|be|with|from|as|or|not|this|no)\b"


def any_of(patterns: list[str]) -> str:
    return "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


def masked(message: Column) -> Column:
    """Lower case, addresses as @, dates and numbers as #, runs of x as xx, white space squeezed."""
    x = F.lower(message)
    x = F.regexp_replace(x, r"(?:https?://|www\.)\S*[\w/]|[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "@")
    x = F.regexp_replace(x, r"[0-9]+(?:[.,:/-][0-9]+)*", "#")
    x = F.when(x.contains("xx"), F.regexp_replace(x, r"\bx{2,}(?:\s+x{2,})*\b", "xx")).otherwise(x)
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def slot_styles(message: Column) -> Column:
    """The brackets of each slot in a masked message, the name in them as ~."""
    found = F.regexp_extract_all(message, F.lit(any_of(SLOTS)), F.lit(0))
    styles = F.transform(found, lambda x: F.regexp_replace(x, r"[a-z#](?:[a-z0-9#_ ]*[a-z0-9#])?", "~"))
    return F.when(message.rlike(r"[{<%\[]|__|@@|&lt;"), F.array_distinct(styles))


def filler_latin(message: Column) -> Column:
    """At least four words, most of which start like the usual filler Latin."""
    words = F.filter(F.split(message, "[^a-z]+"), lambda w: F.length(w) > 2)
    stems3 = F.array(*[F.lit(s[:3]) for s in LATIN])
    hits = F.size(F.filter(words, lambda w: F.array_contains(stems3, F.substring(w, 1, 3))))
    return (F.size(words) >= 4) & (hits >= 0.6 * F.size(words))


def learned_filler(groups: DataFrame) -> DataFrame:
    """(h, g) of the messages made of filler words: those of filler Latin, and those of words without grammar around them that occur in messages of filler Latin again and again."""
    words = F.filter(F.split("message", "[^a-z]+"), lambda w: F.length(w) > 2)
    bare = groups.where(~F.col("message").rlike(_GRAMMAR)).select("h", "g", F.array_distinct(words).alias("words"), filler_latin(F.col("message")).alias("latin")).where("size(words) > 0")
    each = bare.select("h", "g", "latin", F.size("words").alias("distinct"), F.explode("words").alias("w"))
    filler = each.groupBy("w").agg(F.count_if("latin").alias("inside"), F.count("*").alias("everywhere")).where("inside >= 2 and inside >= 0.2 * everywhere")
    hits = each.where(~F.col("latin")).join(filler.select("w"), "w").groupBy("h", "g", "distinct").agg(F.count("*").alias("hits"))
    return hits.where("hits >= 2 and hits >= 0.75 * distinct").select("h", "g").unionByName(bare.where("latin").select("h", "g"))


def classify(message: Column) -> Column:
    """'script', 'error', 'filler' or null for one masked message that recurs."""
    # What every rule of a bank needs is looked for first.
    return (
        F.when(message.rlike("script|human|browser") & message.rlike(any_of(SCRIPTS)), "script")
        .when(message.rlike(any_of(FAILURES)), "error")
        .when(message.rlike(any_of(FILLERS)), "filler")
    )


def messages(texts: DataFrame) -> DataFrame:
    """(table_name, rec_key, source, message) of (…, source, text, whole): sentences and lines, or the whole element."""
    split = F.when(F.col("whole"), F.array("text")).otherwise(F.split("text", r"(?<=[.!?])\s+|[\r\n]+"))
    rows = texts.where("text is not null").select("table_name", "rec_key", "source", F.explode(split).alias("part"))
    return rows.select("table_name", "rec_key", "source", masked(F.col("part")).alias("message")).where("message <> ''")


def recurring(rows: DataFrame, *by: str) -> DataFrame:
    """(by, n_sources, n) of the groups, exact: partial counts by group and source, then by group."""
    return rows.groupBy(*by, "source").agg(F.count("*").alias("n")).groupBy(*by).agg(F.count("*").alias("n_sources"), F.sum("n").alias("n"))


def learned_phrases(groups: DataFrame, judged: DataFrame, *, inside: float = 0.3, share: float = 0.67) -> DataFrame:
    """(h, g, kind) of recurring messages that no rule knows, but whose words are those of judged ones: at least ``share`` of its words stand in judged messages in ``inside`` of all messages they stand in."""
    words = F.filter(F.split(F.regexp_replace("message", _GRAMMAR, " "), "[^a-z]+"), lambda w: F.length(w) > 1)
    each = groups.join(judged, ["h", "g"], "left").select("h", "g", "kind", "open", F.explode(F.array_distinct(words)).alias("w"))
    telling = each.groupBy("w").agg(F.count("*").alias("everywhere"), F.count("kind").alias("told"), F.min("kind").alias("as")).where(F.col("told") >= F.greatest(F.lit(1.0), inside * F.col("everywhere")))
    counts = each.where("open").join(telling, "w", "left").groupBy("h", "g").agg(F.count("*").alias("n"), F.count("as").alias("n_told"), F.min("as").alias("kind"))
    return counts.where(F.col("n_told") >= share * F.col("n")).select("h", "g", "kind")


def residue(texts: DataFrame, *, sources: int = 3) -> DataFrame:
    """(table_name, rec_key, kind) of the records with residue, one row for each kind.

    ``texts`` is (table_name, rec_key, source, text, whole). A message, or a style of
    slots, must recur in ``sources`` sources to be classified at all: a lone sentence
    about a failed session is content. Counts are exact and aggregate within
    partitions first; messages meet their records on a hash of 96 bits, in a join
    that adaptive execution splits where one message holds much of all rows.

    Defined cases: null and empty texts and null keys give no rows; a null source is
    one source; records given twice give one row; an empty table gives no rows.
    """
    text = F.col("message")
    cut = messages(spread(texts.where("rec_key is not null and text is not null"))).withColumns({"source": F.coalesce("source", F.lit("")), "h": F.xxhash64(text), "g": F.hash(text), "styles": slot_styles(text)})
    parts = spool(cut, "parts")
    groups = spread(spool(recurring(parts, "message").withColumns({"h": F.xxhash64(text), "g": F.hash(text)}), "messages"))
    judged = spool(groups.where(F.col("n_sources") >= sources).select("h", "g", classify(text).alias("kind")).withColumn("open", F.col("kind").isNull()), "judged")
    filler = learned_filler(groups).select("h", "g", F.lit("filler").alias("kind"))
    kinds = judged.where("kind is not null").select("h", "g", "kind").unionByName(filler).unionByName(learned_phrases(groups, judged)).groupBy("h", "g").agg(F.min("kind").alias("kind"))
    slots = parts.where(F.size("styles") > 0).select("table_name", "rec_key", "source", F.explode("styles").alias("style"))
    usual = recurring(slots, "style").where(F.col("n_sources") >= sources)
    placed = slots.join(usual, "style", "left_semi").select("table_name", "rec_key", F.lit("placeholder").alias("kind"))
    return parts.select("table_name", "rec_key", "h", "g").join(kinds, ["h", "g"]).select("table_name", "rec_key", "kind").unionByName(placed).distinct()


def vacancy_texts(ads: DataFrame, positions: DataFrame) -> DataFrame:
    """The texts of problem 2: raw_text_excerpt of ads, the elements of areas of positions."""
    a = ads.select(F.lit("job_ads").alias("table_name"), F.col("id").alias("rec_key"), F.coalesce("institution_id", F.lit("")).alias("source"), F.col("raw_text_excerpt").alias("text"), F.lit(False).alias("whole"))
    p = positions.select(F.lit("extracted_positions").alias("table_name"), F.col("position_id").cast("string").alias("rec_key"), F.coalesce("institution_id", F.lit("")).alias("source"), F.explode("areas").alias("text"), F.lit(True).alias("whole"))
    return a.unionByName(p)
