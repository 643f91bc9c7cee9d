"""Rule banks of the example queries, in the dialect shared by Java and RE2."""

from __future__ import annotations

from noticeworks.rules import Rule

#: Fields by the words that name them, in the order in which they are listed.
FIELDS = [
    Rule("History", r"\b(?:histor(?:y|ical)|archaeolog(?:y|ical)|epigraphy|numismatics|museum)\b"),
    Rule("Language and literature", r"\b(?:literature|literary|linguistics?|phonology|poetics|translation theory)\b"),
    Rule("Society and politics", r"\b(?:sociolog(?:y|ical)|anthropolog(?:y|ical)|political|public policy|social work)\b"),
    Rule("Psychology", r"\bpsycholog(?:y|ical)\b"),
    Rule("Education", r"\b(?:education|pedagogy|curriculum studies)\b"),
    Rule("Law", r"\b(?:law|legal|jurisprudence)\b"),
    Rule("Economics", r"\b(?:economics?|econometrics|labour markets|monetary)\b"),
    Rule("Arts and design", r"\b(?:fine arts|visual arts|design|music|film studies|performing arts)\b"),
    Rule("Management", r"\b(?:management|marketing|commerce|corporate finance)\b"),
    Rule("Mathematics", r"\b(?:mathematics|statistics|algebra|topology|operations research)\b"),
    Rule("Physics", r"\b(?:physics|astrophysics|optics|quantum)\b"),
    Rule("Chemistry", r"\b(?:chemistry|chemical|polymer)\b"),
    Rule("Life sciences", r"\b(?:biolog(?:y|ical)|biosciences|botany|zoology|microbiology|physiology)\b"),
    Rule("Computing", r"\b(?:computer|software|machine learning|information technology)\b"),
    Rule("Engineering", r"\b(?:engineering|microelectronics|power systems|signal processing)\b"),
    Rule("Earth and environment", r"\b(?:geology|earth sciences|atmospheric|hydrogeology|environmental)\b"),
    Rule("Medicine", r"\b(?:medicine|nursing|epidemiology|pharmacology|public health)\b"),
    Rule("Sport", r"\b(?:sports?|physical education|yoga)\b"),
]
FIELD_ORDER = [r.label for r in FIELDS]
#: The fields that count as humanities and social sciences.
HUMANITIES = FIELD_ORDER[:8]
CORE_A = [Rule("hss", r"\b(?:histor(?:y|ical)|literature|sociolog(?:y|ical)|anthropolog(?:y|ical)|psycholog(?:y|ical)|philosophy|linguistics)\b")]
CORE_B = [Rule("ambiguous", r"\b(?:education|law|legal|economics|design|public policy|political)\b")]
CORE_NOT = [Rule("excluded", r"\b(?:engineering|chemistry|physics|mathematics|medicine|technology|sciences?)\b")]
HINT = [Rule("ambiguous", r"\b(?:faculty|professor|lecturer|fellow)\b")]
NOTICE_BY_NAME = [("corrigendum", r"corrigend"), ("result", r"result|shortlist"), ("minutes", r"minutes")]
NOTICE_BY_TEXT = [
    ("question", r"unstarred question|starred question"),
    ("minutes", r"the committee considered|minutes of the meeting|it was reported that"),
    ("circular", r"^no\. [a-z]+/[0-9]+/[0-9]+|the competent authority"),
    ("roster", r"vacancy position as on"),
    ("reading-list", r"reading list for"),
    ("faq", r"^q: "),
    ("directory", r"units recruiting this year"),
    ("vacancy", r"walk-in interview|applications are invited|invites applications|wishes to recruit|vacancies of|proposes to appoint|may apply for the position|online applications are solicited|under advertisement|requires a "),
]
TRAPS = [
    Rule("bond", r"service bonds? of [0-9]+ years"),
    Rule("no travel pay", r"no travelling allowance"),
    Rule("may not fill", r"right not to fill"),
    Rule("supersedes", r"supersedes the one dated"),
    Rule("canvassing", r"canvassing in any form"),
    Rule("fee", r"fee of rs\. ?[0-9]+"),
]
PHRASES = {"continuous": "continuous process", "autonomous": "institutions are autonomous", "special_drive": "special drive", "consideration": "under consideration", "category_data": "vacancy position as on"}
