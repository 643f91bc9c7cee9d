import datetime as dt

from noticeworks.operators.snapshots import snapshot_changes

SCHEMA = "snapshot_date date, id string, title string, closing_date date, fetched_at timestamp, change_kind string, _key string"
D = [dt.date(2026, 1, d) for d in (1, 5, 20)]


def rows(spark, data):
    return spark.createDataFrame([(D[s], i, t, c, dt.datetime(2026, 1, 1, h), "x", "y") for s, i, t, c, h in data], SCHEMA)


def found(df):
    return sorted(map(tuple, snapshot_changes(df).collect()), key=str)


def test_added_removed_changed(spark):
    c = dt.date(2026, 3, 1)
    df = rows(spark, [
        (0, "a", "One", c, 1), (1, "a", " One\n", c, 1), (2, "a", "one", c, 1),  # white space is no change, case is
        (0, "b", "Two", None, 1), (1, "b", "Two", c, 1),  # null is a value; gone later
        (1, "n", "New", c, 1), (2, "n", "New", c, 1),
        (0, "r", "Back", c, 1), (2, "r", "Back", c, 1),
    ])
    assert found(df) == sorted([(D[1], "b", "changed"), (D[1], "n", "added"), (D[1], "r", "removed"), (D[2], "a", "changed"), (D[2], "b", "removed"), (D[2], "r", "added")], key=str)


def test_latest_reading_counts_and_repeats_do_not(spark):
    df = rows(spark, [(0, "a", "Old", None, 1), (0, "a", "Newer", None, 2), (1, "a", "Newer", None, 1), (1, "a", "Newer", None, 1)])
    assert found(df) == []


def test_nulls_single_snapshot_and_empty(spark):
    df = rows(spark, [(0, "a", None, None, 1), (1, "a", None, None, 1), (1, None, "x", None, 1)])
    assert found(df) == []
    assert found(rows(spark, [(0, "a", "t", None, 1)])) == []
    assert found(spark.createDataFrame([], SCHEMA)) == []
    null_day = spark.createDataFrame([(None, "a", "t", None, None, "x", "y")], SCHEMA)
    assert found(null_day) == []
    empty_against_null = rows(spark, [(0, "a", "", None, 1), (1, "a", None, None, 1)])
    assert found(empty_against_null) == [(D[1], "a", "changed")]


def test_ties_are_defined_and_hot_key(spark):
    tie = [(0, "a", "X", None, 1), (0, "a", "Y", None, 1), (1, "a", "X", None, 1), (1, "a", "Y", None, 1)]
    assert found(rows(spark, tie)) == found(rows(spark, tie[::-1])) == []
    hot = rows(spark, [(s, "hot", "T", None, h % 24) for s in (0, 1) for h in range(500)])
    assert found(hot) == []
