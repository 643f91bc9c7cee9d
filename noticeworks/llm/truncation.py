"""Problem 4: texts that stop before their end, in SQL.

Words keep their shape (digits as 0, dates as one word, addresses by their parts)
and their punctuation. Each text gives the trigrams of its sentences, hashed and
counted inside texts and at their ends, each distinct text once; the last words of
all texts are counted alike. A text without an end mark is cut if its last trigram is common inside but
almost never last, or its last word is hardly ever a whole word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Marks of omission that a system puts where it cuts.
OMISSION = r"(?:\.\.\.+|…|\[\.\.\.?\]|\[…\]|\x{FFFD})\s*$"
#: Words whose point ends no sentence.
SHORT_FORMS = "(?:rs|nos?|dr|st|advt|prof|vs|viz|mrs?|ms)"
#: Where sentences part: at line ends before a capital, unless after a colon, and after end marks.
PARTS = rf"(?<![:\s])\s*[\r\n]+\s*(?=[A-Z][a-z])|(?<=[.!?])(?<!(?i:\b{SHORT_FORMS}\.))\s+"
#: Stands behind the last word of a text.
END = "\uE000"

#: A sentence in its shape. Hosts keep whether they are complete: labels before the last become h.
_SHAPE = rf"""
translate(regexp_replace(
  IF(contains(s, '/') OR contains(s, '@'),
     regexp_replace(regexp_replace(regexp_replace(lower(s), r'@(?=[a-z])', '@://'), r'://(?:[a-z0-9-]+\.)+', '://h.'), r'\b[a-z]{{3}}/(?=[0-9])', 'c/'),
     lower(s)),
  r'\b[0-9]{{1,2}}(?:\s+|-)(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*(?:\s+|-)[0-9]{{4}}\b', 'D'), '123456789{END}', '000000000')
"""
#: The sentences of a text, the last with the end sign.
_SENTENCES = rf"split(concat(trim(IF(omitted, regexp_replace(text, r'{OMISSION}', ''), text)), '{END}'), r'{PARTS}')"
_LABELLED = "coalesce(get(w, 2), '') LIKE '%:' OR coalesce(get(w, 3), '') LIKE '%:'"


def trigram_counts(ads: DataFrame, view: str = "noticeworks_ads") -> str:
    """The common table expressions up to ``judged``: each text with the counts of its last trigram and last word, over all distinct texts.

    Copies of a text count once, or a text cut again and again would make its own
    end a usual one. The counts of trigrams feed two joins from one shuffle; the texts' ends are
    shaped apart, one sentence each.
    """
    ads.createOrReplaceTempView(view)
    return rf"""
WITH latest AS (
  SELECT id, max(struct(snapshot_fetched_at, _source_method, raw_text_excerpt, pdf_excerpt)) AS r
  FROM {view} WHERE id IS NOT NULL GROUP BY id
), long AS (
  SELECT id, r._source_method AS source, f.field_name, f.text, right(trim(TRAILING ' \t\r\n' FROM f.text), 16) RLIKE r'{OMISSION}' AS omitted
  FROM latest LATERAL VIEW explode(array(
    named_struct('field_name', 'raw_text_excerpt', 'text', r.raw_text_excerpt),
    named_struct('field_name', 'pdf_excerpt', 'text', r.pdf_excerpt))) AS f
  WHERE f.text RLIKE r'[\p{{L}}\p{{N}}]'
), texts AS (
  SELECT text, omitted FROM long GROUP BY text, omitted
), sentences AS (
  SELECT s, s LIKE '%{END}' AS final FROM texts LATERAL VIEW explode({_SENTENCES}) t AS s
), last_sentences AS (
  SELECT id, source, field_name, omitted, s FROM long LATERAL VIEW explode(slice({_SENTENCES}, -1, 1)) t AS s
), words AS (
  SELECT w, final, {_LABELLED} AS labelled FROM (SELECT split(concat('~ ~ ', {_SHAPE}), r'\s+') AS w, final FROM sentences)
), grams AS (
  SELECT xxhash64(labelled, g.`0`, g.`1`, g.`2`) AS gram, xxhash64(g.`2`) AS word, xxhash64(labelled, g.`0`, g.`1`) AS lead, CASE WHEN final AND i = size(w) - 3 THEN 1 ELSE 0 END AS at_end
  FROM words LATERAL VIEW posexplode(arrays_zip(slice(w, 1, size(w) - 2), slice(w, 2, size(w) - 2), slice(w, 3, size(w) - 2))) t AS i, g
), counted AS (
  SELECT gram, word, lead, count(*) - sum(at_end) AS inside, sum(at_end) AS at_end FROM grams GROUP BY gram, word, lead
), word_counts AS (
  SELECT word, sum(inside) AS word_inside, sum(at_end) AS word_end FROM counted GROUP BY word HAVING sum(at_end) > 0
), lead_counts AS (
  SELECT lead, sum(at_end) AS lead_end FROM counted GROUP BY lead HAVING sum(at_end) > 0 AND sum(inside) >= 0
), finals AS (
  SELECT id, source, field_name, omitted, {_LABELLED} AS labelled, element_at(w, -1) RLIKE r'[.!?"”’)\]}}]$' AND NOT element_at(w, -1) RLIKE r'^{SHORT_FORMS}\.$' AS stopped,
         xxhash64({_LABELLED}, element_at(w, -3), element_at(w, -2), element_at(w, -1)) AS gram, xxhash64(element_at(w, -1)) AS word,
         xxhash64({_LABELLED}, element_at(w, -3), element_at(w, -2)) AS lead
  FROM (SELECT id, source, field_name, omitted, split(concat('~ ~ ', {_SHAPE}), r'\s+') AS w FROM last_sentences)
), judged AS (
  SELECT f.id, f.source, f.field_name, f.omitted, f.labelled, f.stopped,
         c.inside, c.at_end - 1 AS others_end, c.inside + c.at_end - 1 AS others, v.word_inside, v.word_end, x.lead_end
  FROM finals f JOIN counted c ON f.gram = c.gram AND f.word = c.word AND f.lead = c.lead JOIN word_counts v ON f.word = v.word JOIN lead_counts x ON f.lead = x.lead
)"""


def cut_condition(rare_end: float = 0.06, evidence: int = 10, usual: float = 0.05) -> str:
    """True for a cut text. The text itself does not count among the others.

    A trigram that is never inside is a proper end only in a labelled statement. A last word that is hardly ever a whole word is a cut one, unless it ends a
    labelled statement and is the ``usual`` end after the words before it.
    """
    return f"""(NOT stopped AND (omitted
    OR word_inside < word_end AND NOT (labelled AND others_end >= {evidence} AND others_end >= {usual} * lead_end)
    OR CASE WHEN others >= {evidence} THEN others_end < {rare_end} * others OR (inside = 0 AND NOT labelled) ELSE NOT (labelled AND others_end >= 0.5 * others) END))"""


def cut_texts(ads: DataFrame, *, rare_end: float = 0.06, evidence: int = 10) -> DataFrame:
    """(ad_id, field_name) of the texts that were cut.

    Defined cases: null, blank and unlettered texts are no case; a second delivery
    of an ad is the same record; texts of one or two words are padded; a mark of
    omission or a broken last character counts as a cut unless an end mark stands
    before it; null ids give no rows; an empty table gives no rows.
    """
    return ads.sparkSession.sql(trigram_counts(ads) + f" SELECT id AS ad_id, field_name FROM judged WHERE {cut_condition(rare_end, evidence)}")


def cut_shares(ads: DataFrame, *, rare_end: float = 0.06, evidence: int = 10) -> DataFrame:
    """(_source_method, field_name, n_texts, n_cut, cut_share) of each source and field."""
    cut = cut_condition(rare_end, evidence)
    return ads.sparkSession.sql(
        trigram_counts(ads)
        + f""" SELECT source AS _source_method, field_name, count(*) AS n_texts, count_if({cut}) AS n_cut, round(count_if({cut}) / count(*), 6) AS cut_share
       FROM judged GROUP BY source, field_name"""
    )
