"""Findings of round 4."""

import re


def _far(spark, n):
    from loomgraph.operators import links as D
    from loomgraph.sources.shared import written

    edges = spark.range(n).selectExpr("id + 10 as source", "id % 2 as target")
    pages = spark.range(n + 10).toDF("slug")
    return D.khop(edges, pages, pages, 3, written)


def test_rows_of_a_pair_of_lists_are_not_held_at_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", False)  # else the plan shows its loops only after a run
    try:
        plan = _far(spark, 40)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    loops = re.findall(r"(?:\*\((\d+)\) )?Generate explode\([^\n]*(?:origins|slugs)#", plan)
    assert len(loops) == 2 and len({x or i for i, x in enumerate(loops)}) == 2


def test_tasks_of_the_last_hop_follow_the_rows(spark, monkeypatch):
    from loomgraph.operators import links as D

    monkeypatch.setattr(D, "_ROWS", 100, raising=False)
    monkeypatch.setattr(D, "_LIST", 4)
    small, large = (_far(spark, n) for n in (40, 80))
    rows = 2 * 80 + 2 * 40 * 39  # two hubs, each with 40 members that are two apart
    assert large.count() == len({tuple(x) for x in large.collect()}) == rows
    assert large.rdd.getNumPartitions() > 3 * small.rdd.getNumPartitions() > 3 * 8
