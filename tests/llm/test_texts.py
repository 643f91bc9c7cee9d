"""Problems 1, 2, 4 and 10 on small texts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from noticeworks.llm import residue, scan_noise, spam, truncation

SENTENCES = ["The selected person shall teach quantum field theory.", "Research and teaching in solid state physics are expected.", "Applications are invited for the post of a lecturer.", "See page 4 of the information brochure for the workshop.", "Fluency in the regional language is useful but not compulsory.", "Signatures in ink on page 9 are scanned separately."]


def lexicon():
    counts = {}
    for s in SENTENCES:
        for w in s.split():
            counts[scan_noise.core(w)] = counts.get(scan_noise.core(w), 0) + 50
    counts |= {"\x01p|see": 50, "\x01p|on": 50, "\x02p|of": 50, "\x02p|are": 50}
    return scan_noise.Lexicon.of(counts, sum(counts.values()))


@pytest.mark.parametrize(
    ("text", "kinds", "clean"),
    [
        ("The selected person shall teach quan-\ntum field theory.", {"hyphen"}, "The selected person shall teach quantum field theory."),
        ("The selected person shall teach quan\xad\r\ntum field theory.", {"hyphen"}, "The selected person shall teach quantum field theory."),
        ("The selected person shall teach quan¬ tum field theory.", {"hyphen"}, "The selected person shall teach quantum field theory."),
        ("The se1ected person shall teach quantum ﬁeld theory.", {"misread"}, "The selected person shall teach quantum field theory."),
        ("The selected person shall tcach quantum field thcory.", {"misread"}, "The selected person shall teach quantum field theory."),
        ("The selected person\nshall teach\n\x0c12\nROYAL INSTITUTE OF SCIENCE\nquantum field theory.", {"pageno", "header"}, "The selected person shall teach quantum field theory."),
        ("The selected person\n- 4 -\nshall teach quantum field\nAdvertisement No. ABC/12/2026 (contd.)\ntheory.", {"pageno", "header"}, "The selected person shall teach quantum field theory."),
        ("The selected person Page 3 of 12 shall teach quantum field theory.", {"pageno"}, "The selected person shall teach quantum field theory."),
        ("The selected person shall teach ROYAL STATE UNIVERSITY ABC/1/2026 quantum field theory.", {"header"}, "The selected person shall teach quantum field theory."),
        ("See page 4 of the information brochure\nfor the workshop.", set(), "See page 4 of the information brochure for the workshop."),
        ("The selected person shall\nteach quantum field theory.", set(), "The selected person shall teach quantum field theory."),
        ("short- and long-term", set(), "short- and long-term"),
        ("", set(), ""),
    ],
)
def test_repair(text, kinds, clean):
    done = scan_noise.repair(text, lexicon())
    assert done.kinds == kinds
    assert " ".join(done.paragraphs) == clean
    assert scan_noise.noisy_at_sight(text, lexicon()) or not kinds


def test_merged_and_split_words_are_decoded():
    words, kinds = scan_noise.decode([("quantumfield", " "), ("theory", " ")], lexicon())
    assert words == ["quantum field", "theory"] and kinds == set()


def test_paragraphs():
    lines = ["The selected person shall teach quantum", "field theory.", "", "Applications are invited for the post", "of a lecturer."]
    assert scan_noise.paragraph_breaks(lines) == [False, True, True, False, True] or scan_noise.paragraph_breaks(lines)[:2] == [False, True]
    done = scan_noise.repair("\n".join(lines), lexicon())
    assert done.paragraphs == ["The selected person shall teach quantum field theory.", "Applications are invited for the post of a lecturer."]


def test_noise_kinds_on_tables(spark):
    clean = [(f"c{k}", s) for k in range(40) for s in [" ".join(SENTENCES)]]
    rows = [*clean, ("x", "The selected person shall teach quan-\ntum field thcory."), ("x", "The selected person shall teach quan-\ntum field thcory."), ("n", None), ("e", " ")]
    ads = spark.createDataFrame(rows, "id string, pdf_excerpt string").withColumn("kinds", F.lit(1))
    pos = spark.createDataFrame([(1, "The selected person\npage 7\nshall teach quantum field theory.", None), (None, "x", "y")], "position_id long, raw_section_text string, areas_text string")
    ads, pos = (df.withColumn("institution_id", F.lit("i")) for df in (ads, pos))
    texts = scan_noise.scanned_texts(ads, pos)
    got = {tuple(r) for r in scan_noise.noise_kinds(texts).collect()}
    assert got == {("job_ads", "x", "pdf_excerpt", "hyphen"), ("job_ads", "x", "pdf_excerpt", "misread"), ("extracted_positions", "1", "raw_section_text", "pageno")}
    assert scan_noise.noise_kinds(scan_noise.scanned_texts(ads.limit(0), pos.limit(0))).count() == 0
    assert scan_noise.repair_texts(texts).where("rec_key = 'x'").first().repaired == "The selected person shall teach quantum field theory."


def test_frequent_misreadings_are_no_lexicon_words():
    counts = {"retrofitting": 292, "retroﬁtting": 15, "certificate": 4523, "cer+iﬁcate": 5, "lecturer": 60, "1ecturer": 20, "5g": 900, "13a1": 383, "lie": 76, "be": 2000}
    words = scan_noise.Lexicon.of(counts, 100_000)
    assert set(words.share) == {"retrofitting", "certificate", "lecturer", "5g", "13a1", "lie", "be"}
    for text in ("retroﬁtting", "cer+iﬁcate", "1ecturer"):
        assert scan_noise.noisy_at_sight(text, words) and scan_noise.repair(text, words).kinds == {"misread"}
    two = scan_noise.Lexicon.of({"lecturer": 500, "leeturcr": 6}, 100_000)
    assert set(two.share) == {"lecturer"}


def test_copies_of_a_misread_text_do_not_teach_the_lexicon(spark):
    good = [(f"g{k}", f"Notice {k} says: " + " ".join(SENTENCES)) for k in range(12)]
    copies = [(f"c{k}", "The selected person shall tcach quantum Held thcory.") for k in range(30)]
    ads = spark.createDataFrame(good + copies, "id string, pdf_excerpt string")
    pos = spark.createDataFrame([], "position_id long, raw_section_text string, areas_text string")
    ads, pos = (df.withColumn("institution_id", F.lit("i")) for df in (ads, pos))
    texts = scan_noise.scanned_texts(ads, pos)
    assert not {"tcach", "thcory"} & set(scan_noise.build_lexicon(texts).share)
    assert {tuple(r) for r in scan_noise.noise_kinds(texts).collect()} == {("job_ads", f"c{k}", "pdf_excerpt", "misread") for k in range(30)}


RESIDUE = [
    "Apply to {{post_name}} now.", "The ${INSERT PAY LEVEL HERE} applies.", "Pay: [enter pay level].", "%DEPARTMENT% mapping", "<<insert area>>", "&lt;adv_no_5&gt; closes soon.", "@@title@@", "__area_name__", "<INSERT TITLE HERE>", "{% topic %}", "#{SUB_AREA_9}",
    "404 Not Found. The requested address /x/5 was not found on this server.", "Internal Server Error", "#REF!", "[object Object]", "undefined, undefined", "Access denied.", "Your session has expired.",
    "Please enable JavaScript to view this page.", "This site requires JavaScript.", "Scripts must be active to go on.", "Dummy text dummy text.", "xxxx xxxxxx xx.", "Area 4 goes here", "Lorem ipsum dolor sit amet consectetur.", "Text to be added",
]
HONEST = [
    "Candidates who see a page-not-found message or error 404 on the portal should write to a@b.example.", "The portal needs a browser with JavaScript and a screen of 14 inches.", "Do not leave [square brackets] empty.", "{0,1}-matrices", "[2+2] cycloadditions",
    "JavaScript frameworks", "placebo and placeholder effects", "script and orthography", "error-correcting codes", "sample surveys", "undefined terms in geometry.", "Server maintenance is planned on 4 May 2026, when the service is unavailable for 3 hours.", "Access to the studio is denied to visitors after 5 pm.", "ST {n}", "filler particles in rubber",
]


def test_headers_are_learned(spark):
    """A form that no pattern names, in lines and within a line; a boilerplate sentence that is wrapped alike is none."""
    first = ["the selected person", "each new teacher", "every other member", "any good lecturer"]
    rows = [("t", f"k{k}", "f", "inst", f"{SENTENCES[0]} Here {a}\nOffice of the Registrar, Academic Section\n{b} teach with care.\nCopies of the forms that\nAnnexure seven lists in full\nmust be sent by post.") for k, (a, b) in enumerate(zip(first, ["shall", "must", "may", "can"], strict=True))]
    rows += [("t", "inline", "f", "inst", "The selected person Office of the Registrar, Academic Section shall teach quantum field theory."), ("t", "other", "f", "else", "Write to the Office of the Registrar, Academic Section before May."), ("t", "none", "f", None, "One\nOffice of the Registrar, Academic Section\ntwo.")]
    texts = spark.createDataFrame(rows, "table_name string, rec_key string, field_name string, source string, text string").withColumn("headers", F.lit("clash"))
    assert [(r.source, r.headers) for r in scan_noise.running_headers(texts).collect()] == [("inst", ["Office of the Registrar, Academic Section"])]
    found = {r.rec_key for r in scan_noise.noise_kinds(texts).collect() if r.noise_kind == "header"}
    assert found == {"k0", "k1", "k2", "k3", "inline"}
    fixed = {r.rec_key: r.repaired for r in scan_noise.repair_texts(texts).collect()}
    assert "Registrar" not in fixed["inline"] and "Registrar" in fixed["other"]


def test_long_words_and_long_runs():
    word = "pneumonoultramicroscopicsilicovolcanoconiosis"
    lex = scan_noise.Lexicon.of({word: 50, "the": 900, "of": 800}, 2000)
    done = scan_noise.repair(f"the {word.replace('microscopic', 'micr0scopic')} of the {word[:20]}-\n{word[20:]}", lex)
    assert done.paragraphs == [f"the {word} of the {word}"] and done.kinds == {"misread", "hyphen"}
    # A word in pieces is put together wherever it stands in a run of unknown ones.
    run = " ".join(f"zq{k}xv" for k in range(11))
    assert word in scan_noise.repair(f"the {run} {word[:9]}-\n{word[9:20]}-\n{word[20:30]}-\n{word[30:]} of", lex).paragraphs[0]


def test_halves_that_are_words_are_joined():
    lex = scan_noise.Lexicon.of({"recruit": 300, "recruitment": 900, "of": 900, "staff": 500, "man": 400, "manuscript": 600}, 4000)
    assert scan_noise.repair("the recruit ment of staff", lex).paragraphs == ["the recruitment of staff"]
    assert scan_noise.repair("the manu script of staff", lex).paragraphs == ["the manuscript of staff"]
    assert scan_noise.repair("recruit Kuwat of staff", lex).paragraphs == ["recruit Kuwat of staff"]


def test_omission_before_blanks(spark):
    rows = [(f"r{k}", f"Copies must reach the section in time and {w} ...{' ' * 20}") for k, w in enumerate("abc")] + [("whole", "Copies must reach the section in time." + " " * 20)]
    ads = spark.createDataFrame([(i, dt.datetime(2026, 1, 1), "m", t, None) for i, t in rows], "id string, snapshot_fetched_at timestamp, _source_method string, raw_text_excerpt string, pdf_excerpt string")
    assert {r.ad_id for r in truncation.cut_texts(ads).collect()} == {"r0", "r1", "r2"}


MESSAGES = "table_name string, rec_key string, source string, text string, whole boolean"


def test_residue(spark):
    rows = [("job_ads", f"r{k}-{c}", f"s{c}", t, False) for k, t in enumerate(RESIDUE) for c in range(3)] + [("job_ads", f"h{k}-{c}", f"s{c}", t, False) for k, t in enumerate(HONEST) for c in range(3)]
    rows += [("job_ads", "mixed", "s", "A long notice about teaching.\nYour browser does not support scripts, so the notice cannot be shown.", False), ("job_ads", "null", "s", None, False), ("job_ads", "empty", "s", "", False), ("job_ads", None, "s", "Dummy text", False), ("job_ads", "r0-0", "s0", RESIDUE[0], False)]
    rows += [("job_ads", f"script{c}", None if c == 1 else f"s{c}", "Your browser does not support scripts, so the notice cannot be shown.", False) for c in range(3)]
    df = spark.createDataFrame(rows, MESSAGES).withColumn("message", F.lit("x"))
    found = {r.rec_key for r in residue.residue(df).collect()}
    assert {t for k, t in enumerate(RESIDUE) if f"r{k}-0" not in found} == set()
    assert {t for k, t in enumerate(HONEST) if f"h{k}-0" in found} == set()
    assert "mixed" in found and not found & {"null", "empty", None}
    assert residue.residue(df.limit(0)).count() == 0


def test_recurrence_decides(spark):
    lone = ("job_ads", "lone", "s0", "The thesis asks why your session has expired.", False)
    rows = [("job_ads", f"w{k}", f"s{k}", "Your session has expired.", False) for k in range(3)] + [("job_ads", f"one{k}", "s0", "Internal server error", False) for k in range(3)] + [lone]
    df = spark.createDataFrame(rows, MESSAGES)
    assert {r.rec_key for r in residue.residue(df).collect()} == {f"w{k}" for k in range(3)}
    assert {r.rec_key for r in residue.residue(df, sources=1).collect()} == {r[1] for r in rows}


def test_phrases_that_no_rule_knows(spark):
    known = ["JavaScript is disabled.", "Please enable JavaScript.", "Internal server error", "Server error in application"]
    rows = [("job_ads", f"k{i}-{c}", f"s{c}", t, False) for i, t in enumerate(known) for c in range(3)] + [("job_ads", f"new{c}", f"s{c}", "JavaScript disabled: server error", False) for c in range(3)]
    rows += [("job_ads", f"own{c}", f"s{c}", "Optics of thin films", False) for c in range(3)]
    found = {r.rec_key for r in residue.residue(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert {f"new{c}" for c in range(3)} <= found and "own0" not in found


def test_truncation(spark):
    parts = ["Duties include ten hours of teaching per week.", "The staff club seats 40 members in all.", "Women candidates are encouraged to apply.", "Hard copies must reach the main section in time."]
    rows = []
    for k in range(60):
        own = [parts[(k + j) % 4] for j in range(4)]
        rows.append((f"full{k}", " ".join(own)))
        rows.append((f"tail{k}", " ".join(own) + f" Contact: office{k % 10}@college.example"))
    cuts = {"c1": "Women candidates are encouraged to", "c2": parts[0] + " Hard copies must reach the ma", "c3": parts[0] + " The staff club seats…", "c4": parts[0] + " Duties include ten hours of...", "c5": parts[2] + " Contact: office5@coll", "c6": parts[0] + " The staff clu�"}
    rows += list(cuts.items()) + [("none", None), ("blank", "  "), ("marks", "...")]
    ads = spark.createDataFrame([(i, dt.datetime(2026, 1, 1), "m", t, None) for i, t in rows] + [("c1", dt.datetime(2025, 1, 1), "m", parts[0], None), (None, None, "m", "cut te", None)], "id string, snapshot_fetched_at timestamp, _source_method string, raw_text_excerpt string, pdf_excerpt string")
    ads = ads.withColumn("gram", F.lit("clash"))
    assert {r.ad_id for r in truncation.cut_texts(ads).collect()} == set(cuts)
    shares = truncation.cut_shares(ads).collect()
    assert [(r.field_name, r.n_texts, r.n_cut) for r in shares] == [("raw_text_excerpt", 126, 6)]
    assert truncation.cut_texts(ads.limit(0)).count() == 0


def test_copies_of_a_cut_text_are_cut(spark):
    parts = ["Duties include ten hours of teaching per week.", "Women candidates are encouraged to apply.", "Hard copies must reach the main section in time.", "Letters are sent to all."]
    rows = [(f"full{k}", f"Notice {chr(97 + k // 10)}{chr(97 + k % 10)} follows. " + " ".join(parts)) for k in range(60)]
    rows += [(f"copy{k}", parts[0] + " Women candidates are encouraged to") for k in range(40)]
    ads = spark.createDataFrame([(i, dt.datetime(2026, 1, 1), "m", t, None) for i, t in rows], "id string, snapshot_fetched_at timestamp, _source_method string, raw_text_excerpt string, pdf_excerpt string")
    assert {r.ad_id for r in truncation.cut_texts(ads).collect()} == {f"copy{k}" for k in range(40)}
    assert [(r.n_texts, r.n_cut) for r in truncation.cut_shares(ads).collect()] == [(100, 40)]


HAM = "The department invites applications for two posts of lecturer in physics. The selected person shall teach courses in optics and guide projects. The upper age limit is 40 years on the closing date. Fluency in the regional language is useful but not compulsory."
LIST = "S.No. | Department | Post | UR | SC\n" + "\n".join(f"{k} | Physics | Professor | {k} | 3" for k in range(1, 30))
SPAM_CASES = [
    ("\n".join(["best college jobs", "teaching vacancy 2026", "phd jobs pdf", "free job alert"] * 5), True),
    (" ".join(["best college jobs teaching vacancy phd jobs pdf free job alert"] * 6), True),
    (" | ".join(f"[lecturer jobs](https://a{k}.example/p/{k})" for k in range(12)), True),
    (" ".join(f"https://a{k}.example/x" for k in range(20)), True),
    (" ".join(f"#tag{k}" for k in range(30)), True),
    (" * ".join(f"physics guide book Rs. {k}00 buy now" for k in range(1, 12)), True),
    (HAM[:150] + "\n" + "\n".join(f"lecturer jobs https://a{k}.example/p/{k}" for k in range(30)), True),
    ("[" + "x" * 900 + "](https://a.example/" + "y" * 900 + ") " + " ".join(f"https://a{k}.example/x" for k in range(9)), True),
    (HAM, False),
    (HAM + "\nDownloads\nwww.a.example\nwww.b.example\nwww.c.example\nwww.d.example", False),
    (LIST, False),
    ("Reading list.\n" + "\n".join(f"{k}. Rao, A. (2001). Modern approaches to optics: a handbook from Delhi. City Press. Available at www.a{k}.example/b." for k in range(1, 12)), False),
    ("Apply at https://apply.example/7489 by 6 July 2025.", False),
    ("", False),
]


def prose(n):
    """Notices that differ in words, sentences and links."""
    rows = []
    for k in range(n):
        extra = [f"Room {k} is open to visitors on weekdays from nine to five.", f"See www.a{k}.example/list for the forms.", "It is one of the oldest departments in the region and has 40 teachers.", "The fee is Rs. 500 and cannot be refunded."]
        rows.append((k, " ".join([HAM, *extra[: k % 5]][k % 3 == 0 and k % 5 > 1 :]) + f" Ref. {k}."))
    return rows


def test_spam_by_distance_and_direction(spark):
    rows = prose(300) + [(1000 + k, t) for k, (t, _) in enumerate(SPAM_CASES)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in spam.spam_pages(df).collect()} == {1000 + k for k, (_, s) in enumerate(SPAM_CASES) if s}
    # The distance and the direction decide: without them rosters, lists and one-liners come along or no row does.
    assert spam.spam_pages(df, quantile=1e9).count() == 0
    features = spam.page_features(df)
    scores = {r.doc_id: r for r in spam.spam_scores(features, features.select("_text", "language", *spam.FEATURES).distinct(), key="doc_id").collect()}
    roster = scores[1000 + [t for t, _ in SPAM_CASES].index(LIST)]
    assert roster.distance > 20.09 and roster.direction == "rosters"


def test_spam_pages(spark):
    rows = prose(200) + [(900 + k, "\n".join(["best college jobs", f"vacancy {k}", "phd jobs pdf", "free job alert"] * 6)) for k in range(12)] + [(800, None), (801, ""), (802, "..."), (None, "jobs\n" * 30), (905, "jobs alert\n" * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("language", F.lit("x"))
    assert {r.doc_id for r in spam.spam_pages(df).collect()} == set(range(900, 912))
    assert spam.spam_pages(df.limit(0)).count() == 0


def test_copies_of_a_spam_page_are_not_the_centre(spark):
    rows = prose(100) + [(1000 + k, "\n".join(["best college jobs", "teaching vacancy", "phd jobs pdf", "free job alert"] * 6)) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in spam.spam_pages(df).collect()} == set(range(1000, 1300))


@pytest.mark.parametrize(("text", "language"), [(HAM, "en"), ("विभाग में दो पदों के लिए आवेदन आमंत्रित हैं।", "hi"), ("नौकरी apply online for the post now and get it", "mixed"), ("Der Fachbereich sucht zwei Personen, die mit den Studierenden und auf Deutsch arbeiten werden.", "de"), ("job alert " * 9, "en"), ("123", "en")])
def test_language(text, language):
    assert spam.measure(text)[0] == language


def test_very_long_texts_are_linear():
    import time

    start = time.time()
    page = "The selected person shall teach in room 12 of the block, see page 4 of the list. " * 4000
    done = scan_noise.repair(page, lexicon())
    assert len(" ".join(done.paragraphs).split()) == len(page.split())
    spam.measure("[x " * 20_000 + "<a " * 20_000 + page)
    assert time.time() - start < 20
