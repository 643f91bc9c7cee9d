"""Problems 3, 5 and 6 against brute force and held-out labels."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noticeworks.llm import canonical, near_duplicates, subjects

NAMES = {1: "Pure Mathematics", 2: "Organic Chemistry", 3: "Condensed Matter Physics", 4: "Optics and Photonics", 5: "Civil Engineering", 6: "Social Work", 7: "Statistics", 8: "Psychology", 9: "Computer Science and Engineering", 10: "Supply Chain Management"}
TYPED = [
    ("Pure Mathematics", 1), ("pure  maths", 1), ("Mathematics, Pure (re-advertised)", 1), ("Field of PURE MATHEMATICS", 1), ("Pure Mahtematics", 1), ("organic chem.", 2), ("Chemistry (Organic)", 2), ("Orgnaic Chemistri", 2), ("Condensed Matter P", 3),
    ("Optics & Photonics", 4), ("Optics/Photonics - Regular", 4), ("Opticsand Photonics", 4), ("Dept. of Civil Engg", 5), ("Work, Social", 6), ("Statiztics", 7), ("C.S.E.", 9), ("Supply Chain Mgmt", 10), ("Human\xa0Resources", 0), ("Philosophy", 0),
    ("Leather Chemistry", 0), ("Marine Engineering", 0), ("Various", 0), ("As per annexure", 0), ("x", 0),
]


@pytest.mark.parametrize(("typed", "ref"), TYPED)
def test_lookup(typed, ref):
    assert canonical.CanonicalIndex([(i, n, 0) for i, n in NAMES.items()]).lookup(typed)[0] == ref


@settings(max_examples=80, deadline=None)
@given(st.sampled_from([n for n in NAMES.values() if len(n) > 9]), st.integers(0, 60), st.sampled_from("abcdefghij"), st.sampled_from(["swap", "drop", "add", "change"]))
def test_one_edit_is_always_found(name, at, letter, edit):
    at = at % (len(name) - 1)
    typed = {"swap": name[:at] + name[at + 1] + name[at] + name[at + 2 :], "drop": name[:at] + name[at + 1 :], "add": name[:at] + letter + name[at:], "change": name[:at] + letter + name[at + 1 :]}[edit]
    index = canonical.CanonicalIndex([(i, n, 0) for i, n in NAMES.items()])
    assert NAMES.get(index.lookup(typed)[0]) == name


def brute(a, b):
    d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=100, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_weighted_distance_is_bounded_by_the_plain_one(a, b):
    got = canonical.weighted_distance(a, b, 20)
    assert 0.7 * brute(a, b) - 1e-9 <= got <= brute(a, b) + 1e-9


def test_mapping_by_broadcast_and_by_join(spark):
    names = spark.createDataFrame([(i, "f", n) for i, n in NAMES.items()] + [(None, "f", "Lost"), (99, "f", None)], "ref_id int, field_name string, canonical_name string")
    values = spark.createDataFrame([(str(k), "f", t) for k, (t, _) in enumerate(TYPED)] + [("n", "f", None), ("g", "other", "Statistics")], "ad_id string, field_name string, value string")
    want = {str(k): r for k, (_, r) in enumerate(TYPED)} | {"n": 0, "g": 0}
    assert {r.ad_id: r.ref_id for r in canonical.map_to_canonical(values, names).collect()} == want
    assert {tuple(r) for r in canonical.map_by_join(values, names).collect()} == {tuple(r) for r in canonical.map_to_canonical(values, names).collect()}
    assert {r.ref_id for r in canonical.map_to_canonical(values, names.limit(0)).collect()} == {0}


def test_typed_values_take_the_latest_delivery(spark):
    ads = spark.createDataFrame([("a", dt.datetime(2026, 1, 1), "Old", " "), ("a", dt.datetime(2026, 1, 2), "New", " "), (None, None, "x", "y"), ("b", None, None, "D")], "id string, snapshot_fetched_at timestamp, department string, discipline string")
    assert {tuple(r) for r in canonical.typed_values(ads, ["department", "discipline"]).collect()} == {("a", "department", "New"), ("b", "discipline", "D")}


def test_subjects_on_held_out_labels(spark, root):
    root = root.replace("sf0.001", "sf0.1")
    ads, pos = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("job_ads", "extracted_positions"))
    labels, names = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("subject_labels", "canonical_names"))
    held = F.pmod(F.xxhash64("ad_id"), F.lit(4)) == 0
    got = subjects.ad_subjects(ads, pos, labels.where(~held), names)
    test = labels.where(held)
    truth = {tuple(r) for r in test.collect()}
    ours = {tuple(r) for r in got.join(test.select("ad_id").distinct(), "ad_id", "left_semi").collect()}
    assert len(truth & ours) / len(truth) > 0.95
    assert len(truth & ours) / len(ours) > 0.95
    seeds = {tuple(r) for r in labels.where(~held).collect()}
    kept = {tuple(r) for r in got.join(labels.where(~held).select("ad_id").distinct(), "ad_id", "left_semi").collect()}
    assert kept == seeds


def test_subjects_small_cases(spark):
    edges = spark.createDataFrame([(f"a{k}", "area optics") for k in range(6)] + [("z", "area optics"), ("z", "area noise"), ("y", "area noise")], "ad_id string, feature string")
    seeds = spark.createDataFrame([(f"a{k}", "phys") for k in range(4)] + [("a0", "math"), ("a0", "math"), (None, "x"), ("gone", "law")], "ad_id string, subject_code string")
    got = {tuple(r) for r in subjects.propagate(edges, seeds).collect()}
    assert got == {("a0", "phys"), ("a0", "math"), ("a1", "phys"), ("a2", "phys"), ("a3", "phys"), ("a4", "phys"), ("a5", "phys"), ("z", "phys"), ("gone", "law")}
    assert subjects.propagate(edges.limit(0), seeds.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    rng = random.Random(3)
    sets = []
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(100)]
        sets += [sorted(set(base)), sorted(set(base[: rng.randrange(40, 100)] + [f"w{rng.randrange(5000)}" for _ in range(20)]))]
    tool = near_duplicates.SuperMinHash(256)
    sig = tool.signatures(sets)
    assert np.isfinite(sig).all() and (sig < 256).all()
    errors = []
    for k in range(0, len(sets), 2):
        a, b = set(sets[k]), set(sets[k + 1])
        errors.append((sig[k] == sig[k + 1]).mean() - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.031  # independent hashes would give 0.031 at one half
    slow = np.full((2, 256), np.inf, np.float32)
    for row, s in enumerate(sets[:2]):
        for w in s:
            i = tool.known[w]
            for j in range(256):
                p = tool.places[i, j]
                slow[row, p] = min(slow[row, p], j + tool.parts[i, j])
    assert np.array_equal(slow, sig[:2])  # early stopping changes nothing


def ad_rows(seed=5, n=60):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = [f"word{rng.randrange(900)}" for _ in range(110)]
        for c in range(rng.choice([1, 1, 2, 4])):
            own = words[:]
            for _ in range(rng.choice([0, 3, 8, 16, 30])):
                own[rng.randrange(len(own))] = f"edit{rng.randrange(900)}"
            rows.append((f"{k:03d}-{c}", rng.choice(["A", "B"]) if c == 0 else rows[-1][1], "Title", " ".join(own), dt.datetime(2026, 1, 1)))
    return rows


SCHEMA = "id string, institution_id string, title string, raw_text_excerpt string, snapshot_fetched_at timestamp"


def exact_pairs(rows):
    import re

    bags = {}
    for i, inst, title, text, _ in rows:
        own = set(re.findall("[a-z0-9]+", (text or "").lower()))
        if i and inst and len(own) >= 60:
            bags[i] = (inst, own | set(re.findall("[a-z0-9]+", (title or "").lower())))
    return {(a, b) for a in bags for b in bags if a < b and bags[a][0] == bags[b][0] and len(bags[a][1] & bags[b][1]) >= 0.75 * len(bags[a][1] | bags[b][1])}


def test_similar_ads_match_brute_force(spark):
    rows = ad_rows()
    rows += [("copy1", "A", "T", rows[0][3], rows[0][4]), ("copy2", "A", "T", rows[0][3], rows[0][4]), ("copy2", "A", "T", rows[0][3], rows[0][4]), ("nul", None, "T", rows[0][3], None), (None, "A", "T", rows[0][3], None), ("short", "A", "T", "too short", None), ("none", "A", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rep", F.lit(1)).withColumn("block", F.lit("x"))
    got = [tuple(r)[:2] for r in near_duplicates.similar_ads(df).collect()]
    assert len(got) == len(set(got)) and set(got) == exact_pairs(rows)
    assert near_duplicates.similar_ads(df.limit(0)).count() == 0


def test_groups_are_the_components_and_buckets_split(spark):
    rows = ad_rows(7)
    df = spark.createDataFrame(rows, SCHEMA)
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in exact_pairs(rows):
        parent[find(a)] = find(b)
    groups = {}
    for i in parent:
        groups.setdefault(find(i), set()).add(i)
    want = {frozenset(g) for g in groups.values() if len(g) > 1}
    got = {}
    for r in near_duplicates.ad_groups(df).collect():
        got.setdefault(r.group_id, set()).add(r.ad_id)
    assert {frozenset(g) for g in got.values()} == want and all(min(g) == k for k, g in got.items())
    _, sets = near_duplicates.ad_word_sets(df)
    whole = {tuple(r)[:2] for r in near_duplicates.similar_sets(sets).collect()}
    assert whole == {tuple(r)[:2] for r in near_duplicates.similar_sets(sets, chunk=1).collect()}


def test_equal_sets_are_split(spark):
    rows = [(f"{k:03d}", "A", "T", " ".join(f"w{j}" for j in range(70)), dt.datetime(2026, 1, 1)) for k in range(40)] + [(f"x{k}", "A", "T", " ".join(f"w{j}" for j in range(3, 73)), dt.datetime(2026, 1, 1)) for k in range(7)]
    df = spark.createDataFrame(rows, SCHEMA)
    members, sets = near_duplicates.ad_word_sets(df)
    got = [tuple(r)[:2] for r in near_duplicates.expanded(near_duplicates.similar_sets(sets), members, chunk=4).collect()]
    assert len(got) == len(set(got)) == 47 * 46 // 2 and set(got) == exact_pairs(rows)


def test_unfinished_groups_raise(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)], "rep_a long, rep_b long")
    with pytest.raises(RuntimeError):
        near_duplicates.connected_groups(spark.range(202).select(F.col("id").alias("rep")), links, max_rounds=2)


def test_long_chains_close(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)], "rep_a long, rep_b long")
    nodes = spark.range(202).select(F.col("id").alias("rep"))
    out = {r.rep: r.group_rep for r in near_duplicates.connected_groups(nodes, links).collect()}
    assert set(out.values()) == {0, 201} and out[200] == 0
