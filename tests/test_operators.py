import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noticeworks.operators import chunks, facets, layout, matching, ranking, reports, sweep, validation, vectors

TODAY = dt.date(2026, 1, 15)


def tuples(df, *order):
    return sorted(map(tuple, (df.select(*order) if order else df).collect()), key=str)


def test_last_and_first_wins_with_ties(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 3, "y"), ("b", 2, None)], "k string, seq int, v string")
    assert tuples(ranking.last_wins(df, ["k"], ["seq"]), "k", "seq", "v", "first_seq.seq") == [("a", 3, "z", 1), ("b", 2, None, 2)]
    assert tuples(ranking.first_wins(df, ["k"], ["seq"])) == [("a", 1, "x"), ("b", 2, None)]
    assert ranking.last_wins(df.limit(0), ["k"], ["seq"]).count() == 0


def test_margin_peers_repeats(spark):
    df = spark.createDataFrame([("a", 5, 1), ("a", 3, 2), ("b", 4, 3)], "k string, score int, id int")
    assert tuples(ranking.with_margin(df, ["k"], "score", [F.col("id")])) == [("a", 5, 1, 2), ("b", 4, 3, None)]
    df = spark.createDataFrame([(1, "u"), (2, "u"), (3, None), (4, None)], "id int, url string")
    assert tuples(ranking.peer_count(df, "url"), "id", "peers") == [(1, 2), (2, 2), (3, 0), (4, 0)]
    assert tuples(ranking.repeats(df, "url")) == [("u", 2), (None, 2)] or tuples(ranking.repeats(df, "url")) == [(None, 2), ("u", 2)]


def test_retention_boundaries(spark):
    days = [TODAY - dt.timedelta(n) for n in (0, 30, 31, 32, 364, 365, 400)]
    out = {r.day: (r.bucket, r.kept) for r in ranking.retained(spark.createDataFrame([(d,) for d in days], "day date"), TODAY).collect()}
    assert out[days[1]] == ("recent", True)
    assert out[days[2]][0] == "weekly" and out[days[4]][0] == "weekly" and out[days[5]][0] == "quarterly"
    same_week = days[2].isocalendar()[:2] == days[3].isocalendar()[:2]
    assert out[days[3]][1] and out[days[2]][1] is not same_week


def test_islands_densest_cumulative(spark):
    df = spark.createDataFrame([("d", i, k) for i, k in enumerate("aabba")], "g string, i int, k string")
    prev = F.lag("k").over(ranking.Window.partitionBy("g").orderBy("i"))
    assert [r.island for r in ranking.islands(df, ["g"], [F.col("i")], F.col("k") != prev).orderBy("i").collect()] == [1, 1, 2, 2, 3]
    pos = spark.createDataFrame([("g", p) for p in (0, 500, 510, 520, 900)], "g string, p int")
    assert ranking.densest(pos, ["g"], "p", 200).select("p", "n_near").first() == (500, 3)
    c = ranking.cumulative(spark.createDataFrame([("g", 1, 1.0), ("g", 2, 3.0)], "g string, o int, v double"), ["g"], [F.col("o")], "v")
    assert tuples(c, "running", "running_share") == [(1.0, 0.25), (4.0, 1.0)]
    assert tuples(ranking.top_rows(spark.range(10), [F.col("id").desc()], 2, 3), "id", "rank") == [(5, 5), (6, 4)]


def test_carry_forward_and_replace(spark):
    now = spark.createDataFrame([("1", "A"), ("2", None)], "id string, inst string")
    old = spark.createDataFrame([("8", "A"), ("9", "B"), ("7", None)], "id string, inst string")
    assert tuples(sweep.carry_forward(now, old, "inst"), "id", "carried") == [("1", False), ("2", False), ("9", True)]
    old = spark.createDataFrame([("a1", "A", 1), ("t1", "T", 2), ("a2", "A", 3), ("t2", "T", 4)], "id string, inst string, seq int")
    new = spark.createDataFrame([("T1", "T", 1), ("T2", "T", 2), ("N1", "N", 1), ("X", "A", 1)], "id string, inst string, seq int")
    out = sweep.replace_keys(old, new, spark.createDataFrame([("T",), ("N",), (None,)], "inst string"), "inst", "seq")
    order = out.orderBy(F.col("slot").asc_nulls_last(), "late_key", "seq").select("id").collect()
    assert [r.id for r in order] == ["a1", "T1", "T2", "a2", "N1"]


def test_outcomes(spark):
    df = spark.createDataFrame([("ok", False, 3, 0, False), ("ok", False, 0, 2, False), ("http-error", True, 1, 0, False), ("http-error", False, 0, 0, False), ("network-error", False, 0, 5, True), ("ok", False, 0, 0, False)], "s string, page boolean, n int, old int, fb boolean")
    got = [r[0] for r in df.select(sweep.outcome(F.col("s"), F.col("page"), F.col("n"), F.col("old"), F.col("fb"))).collect()]
    assert got == ["ok", "stale-carried", "ok", "http-error", "rolling-stub", "ok-empty"]


def test_prioritised_lookup_and_bands(spark):
    rows = spark.createDataFrame([("1", None, "k2"), ("2", "k1", "k2"), ("3", "zz", None)], "id string, a string, b string")
    names = spark.createDataFrame([("k1", "v1"), ("k2", "v2")], "key string, val string")
    assert tuples(matching.prioritised_lookup(rows, [F.col("a"), F.col("b")], names, "key", "val")) == [("1", "v2"), ("2", "v1")]
    points = spark.createDataFrame([(i, float(i)) for i in range(10)] + [(99, None)], "id int, v double")
    bands = spark.createDataFrame([(1.0, 4.0), (2.0, 3.0), (4.0, 5.0), (8.0, 7.0), (9.0, 9.0), (None, 3.0)], "lo double, hi double")
    assert tuples(matching.outside_bands(points, "v", bands, "lo", "hi"), "id") == [(0,), (6,), (7,), (8,), (99,)]


def test_chosen_pairs(spark):
    df = spark.createDataFrame([("f", "a", 1, 1, 3), ("f", "a", 2, 1, 1), ("g", "x", 3, 2, 12), ("g", "x", 4, 2, 11), ("g", "y", 3, 2, 20), ("g", "y", 4, 2, 19), ("g", "z", 5, 2, 9)], "filename string, ad_id string, position_id int, n_refs int, score int")
    assert tuples(matching.chosen_pairs(df), "ad_id", "position_id") == [("a", 1), ("a", 2), ("y", 3)]


def test_reports(spark):
    rows = spark.createDataFrame([("r1", "ur", 2), ("r1", "sc", 1), ("r2", "ur", 4)], "rank string, category string, posts int")
    cube = {(r["rank"], r.category): r.total for r in reports.cube_totals(rows, "rank", "category", "posts").collect()}
    assert cube[("all", "all")] == 7 and cube[("r1", "all")] == 3 and cube[("all", "ur")] == 6
    gap = {r.category: r.band for r in reports.mandate_gap(rows).collect()}
    assert gap == {"ur": "over", "sc": "met"}
    assert reports.argmax_rows(rows, "rank", "posts", "category").where("rank = 'r1'").first().category == "ur"
    assert reports.mandate_gap(rows.limit(0)).count() == 0


def test_rank_flags(spark):
    df = spark.createDataFrame([("Asst/Assoc/Prof in X", None, "Faculty"), ("Assistant Professor", None, None), ("Professor of Law", None, None), ("Call", ["Professor"], None), ("Visiting Faculty", None, "Visiting"), ("Postdoctoral Fellow", None, None), (None, None, None)], "t string, r array<string>, p string")
    flags = facets.rank_flags(F.col("t"), F.col("r"), F.col("p"))
    got = ["".join(k[0] for k, v in zip(flags, row, strict=True) if v) for row in df.select(*flags.values()).collect()]
    assert got == ["faf", "f", "f", "f", "v", "r", ""]


def _ads(spark):
    return spark.createDataFrame([("1", ["H"], "hss", "IIT", "S1", True, False, TODAY + dt.timedelta(3)), ("2", ["H", "L"], "hss", "NIT", "S1", False, True, None), ("3", ["P"], "non-hss", "IIT", None, True, True, TODAY)], "id string, fields array<string>, relevance string, inst_type string, state string, is_faculty boolean, is_associate boolean, closing_date date").withColumns({f"is_{r}": F.lit(False) for r in ("full", "research", "visiting")}).withColumn("is_reserved", F.lit(False)).withColumn("folded", F.lit("text"))


def test_facets_leave_their_own_dimension_out(spark):
    spec = facets.FilterSpec(types=frozenset(["IIT"]), closing_within=7)
    assert tuples(facets.filtered(_ads(spark), spec, TODAY), "id") == [("1",), ("3",)]
    n = {(r.dimension, r.value): r.n for r in facets.facet_counts(_ads(spark), spec, TODAY).collect()}
    assert n[("type", "NIT")] == 1 and n[("type", "IIT")] == 2 and ("field", "L") not in n and n[("rank", "faculty")] == 2
    assert facets.FilterSpec().active() == 0 and spec.active() == 2
    assert facets.filtered(_ads(spark), facets.FilterSpec(), TODAY).count() == 3


def test_validation(spark):
    df = spark.createDataFrame([("1", "a"), ("1", None), (None, "z")], "id string, inst string")
    got = tuples(validation.row_rules(df, F.col("id"), {"no inst": F.col("inst").isNull()}))
    assert got == [("no inst", "1", 1)]
    assert tuples(validation.duplicate_keys(df, "id")) == [("duplicate id", "1", 1)]
    assert tuples(validation.orphans(df, "inst", spark.createDataFrame([("a",)], "i string"), "i", "id", "orphan")) == [("orphan", None, 1)]
    good, bad = validation.split_valid(df, {"no id": F.col("id").isNull()})
    assert (good.count(), bad.count()) == (2, 1)
    assert tuples(validation.whole_groups(df, "id", F.col("inst").isNull()), "id") == [(None,)]
    assert validation.volume_drop(79, 100) and not validation.volume_drop(80, 100) and not validation.volume_drop(0, None)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=300), st.integers(1, 40), st.integers(10, 80))
def test_chunks_cover_the_text(t, least, most):
    spans = chunks.chunk_spans(t, least, most)
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert "".join("".join(t[a:b].split()) for a, b in spans) == "".join(t.split())


def test_chunks(spark):
    long = "One sentence here. " * 100
    df = spark.createDataFrame([(1, "a" * 250 + "\n\n" + "b" * 50 + "\n\n" + long), (2, None), (3, "")], "doc_id long, text string")
    rows = chunks.chunked(df).orderBy("doc_id", "idx").collect()
    assert {r.doc_id for r in rows} == {1} and max(r.char_end - r.char_start for r in rows) <= 1200
    assert rows[0].chunk == "a" * 250 and rows[1].chunk == "b" * 50


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[7] = x[3]
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(300)] + [(900, None)], "vec_id long, embedding array<float>").repartition(5)
    got = {(r.query_id, r["rank"]): r.vec_id for r in vectors.nearest(df, df.where("vec_id % 100 = 0"), block=2, k=4).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for q in (0, 100, 200):
        s = u @ u[q]
        s[q] = -9
        assert [got[(q, k + 1)] for k in range(4)] == np.argsort(-s, kind="stable")[:4].tolist()


def test_kmeans_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 4))
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(120)], "vec_id long, embedding array<double>")
    out, centres = vectors.kmeans(df, [0, 1, 2], rounds=5, tolerance=0)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u[[0, 1, 2]]
    for _ in range(5):
        best = (u @ c.T).argmax(1)
        c = np.array([u[best == k].mean(0) for k in range(3)])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
    assert np.allclose(c, centres, atol=1e-6)
    assert [r.cluster for r in out.orderBy("vec_id").collect()] == (u @ c.T).argmax(1).tolist()


def test_layout_words_and_sections(spark):
    words = [("p", 1, "Hello", 0.0, 20.0, 10.0, 9.0), ("p", 1, "world", 23.0, 40.0, 11.0, 9.0), ("p", 1, "wide", 40.5, 50.0, 10.0, 9.0), ("p", 1, "TITLE", 0.0, 20.0, 30.0, 14.0)]
    lines = layout.words_to_lines(spark.createDataFrame(words, "pdf string, page int, text string, x0 double, x1 double, top double, size double"))
    assert [r.text for r in lines.orderBy("line_no").collect()] == ["Hello worldwide", "TITLE"]
    bands = spark.createDataFrame([("p", 1, 25.0, 40.0)], "pdf string, page int, y_top double, y_bottom double")
    assert layout.outside_tables(lines, bands).count() == 1
    assert {r.text: r.kind for r in layout.classed_lines(lines).collect()} == {"Hello worldwide": "paragraph", "TITLE": "header"}
    docs = spark.createDataFrame([(1, "ABOUT THE POSTS\nfirst line\nsecond line\n\n- one\n- two\r\nend"), (2, None)], "doc_id long, text string")
    assert [(r.kind, r.n_lines) for r in layout.sections(layout.text_lines(docs)).orderBy("section").collect()] == [("header", 1), ("paragraph", 2), ("list", 2), ("paragraph", 1)]


def test_units_columns_tables(spark):
    text = "1  Old Name   2  Other\n1  Civil Works\nbody one\n2  Physics\nbody two\n9  Far Away\n3  Law\n"
    assert [(u.number, u.name) for u in layout.units_of(text)] == [(1, "Civil Works"), (2, "Physics")] or [(u.number, u.name) for u in layout.units_of(text)][:2] == [(1, "Civil Works"), (2, "Physics")]
    assert layout.units_of(None) == []
    spark.udtf.register("split_units", layout.SplitUnits)
    assert spark.sql("SELECT unit_name FROM split_units('1  Alpha\nx')").first()[0] == "Alpha"
    cols = layout.columns_of("Area            Eligibility\nsolid state     PhD in physics\noptics          five years", ["Area", "Eligibility"])
    assert cols == {"Area": "solid state optics", "Eligibility": "PhD in physics five years"}
    assert layout.columns_of("none", ["Area"]) == {}
    assert layout.areas_by_heading("Topology: knots. Algebra: rings, fields.") == [("Topology", "knots"), ("Algebra", "rings, fields")]
    assert layout.areas_by_heading(None) == [] and layout.areas_by_heading("plain") == [(None, "plain")]
    assert layout.named_slices("Physics: " + "x" * 50 + "\nLaw: short", ["Physics", "Law"]) == [("Physics", "x" * 50)]
    t = spark.createDataFrame([("p", 1, 1.0, ["A", "B"], [["1", "2"]]), ("p", 2, 1.0, ["A", "B"], [["3", "4"]]), ("p", 3, 1.0, None, [["5", "6"]]), ("p", 4, 1.0, ["C"], [["7"]])], "pdf string, page int, y double, columns array<string>, rows array<array<string>>")
    assert [(r.columns, len(r.rows)) for r in layout.merged_tables(t).orderBy("table_no").collect()] == [(["A", "B"], 3), (["C"], 1)]
    heads = spark.createDataFrame([(["S.No.", "Name of Post", "UR", "SC", "ST"],)], "c array<string>")
    assert heads.select(layout.role_index(F.col("c"), ["post", "name of post"]), layout.is_roster_table(F.col("c"))).first() == (1, True)


@pytest.mark.parametrize(("raw", "want"), [("a\fb", "a b"), ("x\nPage 3 of 9\ny", "x\n \ny"), ("x\n- 4 -\ny", "x\n \ny"), ("see page 4 of it", "see page 4 of it")])
def test_pagination(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(layout.without_pagination(F.col("x"))).first()[0] == want


def test_picked_chunks(spark):
    body = " qualification and experience " + "x" * 100
    c = spark.createDataFrame([(1, 0, "intro" + body), (1, 1, "Optics unit" + body), (1, 2, "z" * 90 + " optics law" + body * 2), (1, 3, "short")], "doc_id long, idx int, chunk string")
    w = spark.createDataFrame([("a", 1, ["Optics"]), ("b", 1, ["law"]), ("c", 1, ["none"]), ("d", 2, ["optics"])], "key string, doc_id long, words array<string>")
    got = tuples(chunks.picked_chunks(c, w, ["qualification", "experience"]), "key", "idx", "how")
    assert got == [("a", 1, "head"), ("b", 2, "anywhere"), ("c", 0, "fallback"), ("c", 1, "fallback"), ("c", 2, "fallback")]
    assert chunks.named_sections("Physics: Candidates with " + "a" * 50 + " Law: Candidates b", ["Candidates"]) == {"Physics": "Candidates with " + "a" * 50}


def test_details_rosters_wildcards(spark):
    index = spark.createDataFrame([("https://a.example/1/", "One"), ("https://a.example/2", "Two")], "url string, title string")
    details = spark.createDataFrame([("http://a.example/1", "Open Positions: 3 Teach physics.")], "url string, text string")
    assert tuples(matching.with_details(index, details), "title", "detail", "open_positions") == [("One", "Teach physics.", 3), ("Two", None, None)]
    pos = spark.createDataFrame([(1, "f", "Physics"), (2, "f", "Law"), (3, "g", "Physics"), (4, "f", None)], "position_id int, pdf_filename string, department string")
    ros = spark.createDataFrame([("f", 0, "Department of Physics"), ("f", 1, "Physics")], "pdf_filename string, row_no int, department string")
    assert tuples(matching.roster_of_unit(pos, ros)) == [(1, 0)]
    df = spark.createDataFrame([("IN",), ("Multi",), ("US",)], "r string")
    assert [r[0] for r in df.select(matching.wildcard_match(F.col("r"), ["IN"], "Multi")).collect()] == [True, True, False]


def test_index_finds_nearly_all_neighbours(spark, root):
    v = spark.read.parquet(f"{root.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    asked = v.where("vec_id % 20 = 0")
    exact = {(r.query_id, r.vec_id) for r in vectors.nearest(v, asked).collect()}
    rows = vectors.nearest_by_index(v, asked, chunk=40).collect()
    found = {(r.query_id, r.vec_id) for r in rows}
    assert len(rows) == len(found) == len(exact) and len(found & exact) / len(exact) >= 0.9
    assert vectors.nearest_by_index(v.limit(0), asked).count() == 0 and vectors.nearest_by_index(v, asked.limit(0)).count() == 0


def test_cards(spark):
    from noticeworks.functions import cards, fields

    row = spark.createDataFrame([(None, "x")], "t string, u string")
    empty = row.select(*[c.alias(f"a{k}") for k, c in enumerate([cards.unit_name(F.col("t")), cards.unit_from_title(F.col("t")), *cards.headline(F.col("t")), cards.numbered_items(F.col("t")), cards.cue(F.col("t"), "areas"), cards.statements(F.col("t"), "x"), cards.public_address(F.col("t")), fields.reservation_note(F.col("t"))])]).first()
    assert list(empty) == [None, None, "", "", [], None, "", False, None]
    texts = spark.createDataFrame([("Dept. of  Physics *", "Lecturer in Optics", "1. Apply soon\n2) Optics of films\n3. Lasers", "http://10.0.0.1/x"), ("Maths", "Recruitment of Fellow (topology)", "No list", "https://a.example/b")], "d string, t string, x string, u string")
    rank, rest = cards.headline(F.col("t"))
    got = texts.select(cards.unit_name(F.col("d"), {"maths": "Mathematics"}), cards.unit_from_title(F.col("t")), rank, rest, cards.numbered_items(F.col("x")), cards.public_address(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [("Physics", "Optics", "Lecturer", "Optics", ["Optics of films", "Lasers"], False), ("Mathematics", "topology", "Fellow", "topology", [], True)]
    note = spark.createDataFrame([("Posts are few. SC 15 per cent and ST 7.5 per cent are reserved. End.",)], "t string").select(fields.reservation_note(F.col("t"))).first()[0]
    assert note == "SC 15 per cent and ST 7.5 per cent are reserved"
    state = spark.createDataFrame([(True, False, False, False, True), (False, True, True, True, False), (False, False, True, True, False), (False, False, False, True, True), (False, False, None, False, True), (False, False, None, False, None)], "p boolean, c boolean, d boolean, m boolean, s boolean")
    assert [r[0] for r in state.select(cards.reservation_state(*[F.col(c) for c in "pcdms"])).collect()] == ["private", "counted", "drive", "composite", "single", "unknown"]


def test_hashed_encoding(spark):
    rows = spark.createDataFrame([("a b",), ("b a",), (None,), ("",)], "t string").select(vectors.hashed_encoding(F.col("t")).alias("v")).collect()
    assert rows[0].v == rows[1].v and len(rows[0].v) == 64 and abs(sum(x * x for x in rows[0].v) - 1) < 1e-5 and set(rows[2].v) == set(rows[3].v) == {0.0}
