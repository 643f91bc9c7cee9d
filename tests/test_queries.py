"""Every core query runs; those with SQL agree with it."""

import pytest

from noticeworks.plans import card_queries, feed_queries, report_queries, snapshot_queries, source_queries
from tests.compare import both

MODULES = (feed_queries, snapshot_queries, card_queries, report_queries, source_queries)
QUERIES = {n: q for m in MODULES for n, q in m.QUERIES.items()}
ORACLE = {n: q for m in MODULES for n, q in m.ORACLE.items()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees_with_sql(spark, root, name):
    ours, theirs = both(spark, root, QUERIES[name], ORACLE[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, root, name):
    assert QUERIES[name](spark, root).count() > 0


def test_one_scan_of_ads_for_all_facets(spark, root):
    plan = feed_queries.facet_counts_reactive(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("job_ads.parquet") == 1
    # What a query does not ask for is not read.
    for name in ("facet_counts_static", "sort_closing_page", "map_grid"):
        plan = QUERIES[name](spark, root)._jdf.queryExecution().executedPlan().toString()
        assert "raw_text_excerpt" not in plan and "pdf_excerpt" not in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_matches_in_one_pass(spark, root):
    plan = feed_queries.position_matches(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("job_ads.parquet") == 1


def test_bands_by_ranges(spark):
    from datetime import date, timedelta

    from noticeworks.operators.matching import outside_bands

    day = lambda k: date(2026, 1, 1) + timedelta(k)
    bands = spark.createDataFrame([(day(0), day(100)), (day(3), day(4)), (day(150), day(149)), (None, day(3)), (day(200), day(200))], "lo date, hi date")
    rows = spark.createDataFrame([(k, day(k) if k != 7 else None) for k in range(0, 300, 7)] + [(7, None)], "id int, d date")
    for parts in (1, 3, 9):
        out = sorted(r.id for r in outside_bands(rows, "d", bands, "lo", "hi", parts=parts).collect())
        assert out == [7, 7, *range(105, 200, 7), *range(203, 300, 7)]
    assert outside_bands(rows, "d", bands.limit(0), "lo", "hi").count() == rows.count() and outside_bands(rows.limit(0), "d", bands, "lo", "hi").count() == 0


def test_partition_count_does_not_matter(spark, root):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = sorted(map(tuple, feed_queries.collision_free_ids(spark, root).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert one == sorted(map(tuple, feed_queries.collision_free_ids(spark, root).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pair_of_all_rows_in_any_plan(spark, root, name):
    plan = QUERIES[name](spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
