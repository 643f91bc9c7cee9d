import datetime as dt
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noticeworks.functions import dates, fields, text, urls
from noticeworks.ids import stable_id, unique_ids
from noticeworks.rules import Rule, all_matches, first_match, phrase_counts

TODAY = dt.date(2026, 1, 15)


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()[0]


def test_stable_id(spark):
    row = spark.createDataFrame([("a", None, 3)], "p string, q string, r int")
    want = hashlib.sha256(b"a\0\0" + b"3\0").hexdigest()[:16]
    assert row.select(stable_id(F.col("p"), F.col("q"), F.col("r"))).first()[0] == want


def test_unique_ids_are_unique_even_if_a_hash_is_taken(spark):
    taken = hashlib.sha256(b"k\0" + b"s\0" + b"2\0").hexdigest()[:16]
    df = spark.createDataFrame([("k", 1), ("k", 2), (taken, 3), (None, 4), ("e", 5), ("e", 5), ("e", 5)], "b string, seq int")
    out = unique_ids(df, F.col("b"), [F.col("seq")], [F.lit("s")]).collect()
    assert len({r.uid for r in out}) == 7
    assert {r.seq: r.uid for r in out}[1] == "k" and {r.seq: r.uid for r in out}[3] == taken
    assert unique_ids(df.limit(0), F.col("b"), [F.col("seq")], []).count() == 0


@pytest.mark.parametrize(("value", "want"), [("  Café & Bar–Club ", "cafe and bar club"), ("Ångström", "angstrom"), (None, ""), ("", "")])
def test_fold(spark, value, want):
    assert text.fold(value) == want
    assert one(spark, value, text.normalized) == want


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=126), max_size=40))
def test_fold_in_plan_equals_fold(spark, value):
    assert one(spark, value, lambda c: text.normalized(c, ascii_only=True)) == text.fold(value)


@pytest.mark.parametrize(
    ("hay", "query", "want"),
    [
        ("post doctoral fellow in physics", "postdoc", True),
        ("professor of physics", "postdoc", False),
        ("machine learning group", "ML", True),
        ("html pages", "ml", False),
        ("department of economics", "econ the", True),
        ("anything", "", True),
        ("anything", "the of", True),
        ("quantum optics", "quant", True),
        ("ab c", "b", False),
        ("other backward classes", "obc posts", False),
    ],
)
def test_search(spark, hay, query, want):
    assert one(spark, hay, lambda c: text.search_condition(text.normalized(c), query)) is want


def test_text_helpers(spark):
    assert one(spark, "one two three", lambda c: text.cut_at_word(c, 9)) == "one two…"
    assert one(spark, "short", lambda c: text.cut_at_word(c, 9)) == "short"
    assert one(spark, "a & <b> \"c\"", text.escape_html) == "a &amp; &lt;b&gt; &quot;c&quot;"
    assert one(spark, "  Royal College, 2nd ", text.slug) == "royal-college-2nd"
    assert one(spark, " a \n b ", text.squeezed) == "a b"
    assert one(spark, "  ", text.squeezed) is None
    assert one(spark, "Rs. 500 in 2026, 3 posts", lambda c: text.number_print(c, 2)) == "500-2026"
    assert one(spark, "a, b; (x) c • A", text.atomised) == ["a", "b", "c"]
    assert one(spark, ["Assistant Professor Grade I", "assistant professor", "Professor", None], text.condensed_ranks, "array<string>") == ["Assistant Professor", "Professor"]
    assert one(spark, [" A  b", "a-B", "", None, "c"], text.clean_list, "array<string>") == ["A b", "c"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Faculty Recruitment Faculty Recruitment", ""),
        ("3675 | Assistant Professor | Jun 30 | Apply", ""),
        ("Home", ""),
        (None, ""),
        ("Applications are invited for the post of Lecturer in History at the institute.", "Applications are invited for the post of Lecturer in History at the institute."),
        ("Add to Calendar Applications for the post of Professor close soon at the main office.", "Applications for the post of Professor close soon at the main office."),
    ],
)
def test_clean_excerpt(spark, raw, want):
    assert one(spark, raw, lambda c: text.clean_excerpt(c, r"\b(?:applications?|post of)", ["(?i)add to calendar"])) == want


@pytest.mark.parametrize(
    ("value", "want"),
    [("2026-02-03", dt.date(2026, 2, 3)), ("03.02.2026", dt.date(2026, 2, 3)), ("3rd February, 2026", dt.date(2026, 2, 3)), ("03-FEB-2026", dt.date(2026, 2, 3)), ("Feb 3, 2026", dt.date(2026, 2, 3)), ("31.02.2026", None), ("1.1.1999", None), ("soon", None), (None, None)],
)
def test_dates(spark, value, want):
    assert one(spark, value, dates.to_date) == want


def test_date_tiers(spark):
    df = spark.createDataFrame([(None,), (dt.date(2026, 1, 14),), (TODAY,), (dt.date(2026, 1, 16),), (dt.date(2026, 1, 22),), (dt.date(2026, 2, 14),), (dt.date(2026, 4, 1),)], "d date")
    d = F.col("d")
    rows = df.select(dates.urgency(d, TODAY), dates.countdown(d, TODAY), dates.deadline_rank(d, TODAY), dates.deadline_tier(d, TODAY)).collect()
    assert [tuple(r) for r in rows] == [
        ("unknown", "", 9999, "rolling"), ("closed", "closed", 9998, "closed"), ("critical", "closes today", 0, "countdown"), ("critical", "1 day left", 1, "countdown"),
        ("critical", "in 7 days", 7, "countdown"), ("soon", "in 30 days", 30, "countdown"), ("ok", "in 76 days", 76, "date"),
    ]


def test_deadline_and_lists(spark):
    t = "Dated 1.1.2026. Apply until 5 March 2026. Last date: 04.03.2026 sharp."
    assert one(spark, t, fields.deadline) == dt.date(2026, 3, 4)
    assert one(spark, t, dates.dates_in) == [dt.date(2026, 1, 1), dt.date(2026, 3, 5), dt.date(2026, 3, 4)]
    assert one(spark, None, fields.deadline) is None
    assert one(spark, "Published 3.2.2026", lambda c: dates.labelled_date(c, "published")) == dt.date(2026, 2, 3)


@pytest.mark.parametrize(("cell", "want"), [("12", 12), ("1 2 posts", 12), ("—", None), ("-", None), ("none", None), (None, None)])
def test_lenient_int(spark, cell, want):
    assert one(spark, cell, fields.lenient_int) == want


def test_roster():
    assert fields.roster_of("Posts: UR 8, OBC 12, SC 7") == {"ur": 8, "obc": 12, "sc": 7}
    assert fields.roster_of("UR 8, SC 7") is None
    assert fields.roster_of("UR 8, SC 7, ST 300") is None
    assert fields.roster_of("UR 1 " + "x" * 300 + " SC 2, ST 3, EWS 4, GEN 5") == {"sc": 2, "st": 3, "ews": 4, "ur": 5}
    assert fields.roster_of(None) is None


def test_roster_column(spark):
    got = one(spark, "UR 1, SC 2, PwD 3", fields.roster)
    assert (got.ur, got.sc, got.pwbd, got.st) == (1, 2, 3, None)


def test_campus(spark):
    assert one(spark, "Work at Campus: Bhopal", fields.campus) == "Bhopal"
    assert one(spark, "the Ranchi campus", fields.campus) == "Ranchi"
    assert one(spark, "nothing", fields.campus) is None


@pytest.mark.parametrize(
    ("url", "domain"), [("https://www.a.ac.in/x", "a.ac.in"), ("http://jobs.b.example:80/", "b.example"), ("https://u:p@c.org/", "c.org"), ("c.org", ""), (None, ""), ("https://localhost/x", "localhost")]
)
def test_registered_domain(spark, url, domain):
    assert one(spark, url, urls.registered_domain) == domain


def test_urls(spark):
    assert one(spark, " HTTPS://A.example/x/ ", urls.url_key) == "a.example/x"
    assert one(spark, "javascript:alert(1)", urls.safe_link) == ""
    assert one(spark, "/local", urls.safe_link) == "/local"
    assert one(spark, "https://a/b c(1).pdf", urls.quoted) == "https://a/b%20c%281%29.pdf"
    name = one(spark, "https://a.example/Ad vert?x=1.pdf", urls.pdf_file_name)
    assert name.startswith("Ad-vert__") and name.endswith(".pdf")
    public, private = (lambda h: ["93.184.216.34"]), (lambda h: ["93.184.216.34", "10.0.0.1"])
    assert urls.is_public_url("https://a.example", public) and not urls.is_public_url("https://a.example", private)
    assert not urls.is_public_url("ftp://a.example", public) and not urls.is_public_url("https://a.example", lambda h: []) and not urls.is_public_url(None, public)


def test_rules(spark):
    bank = [Rule("x", r"\bcat\b"), Rule("y", "dog"), Rule("x", "kitten")]
    assert one(spark, "Dog and CAT", lambda c: first_match(c, bank)) == "x"
    assert one(spark, "dog kitten cat", lambda c: all_matches(c, bank)) == ["x", "y"]
    assert one(spark, None, lambda c: all_matches(c, bank)) == []
    assert one(spark, None, lambda c: first_match(c, bank, F.lit("none"))) == "none"
    assert one(spark, "a b A", lambda c: phrase_counts(c, {"a": "a"})["a"]) == 2
