"""Semi-masked reads: the rows of a plain semi join, and how little of the files is read for them."""

import random

import pytest

from loomgraph.sources import masks


def scanned(df):
    """(files, rows) read by the scan of the data, and the rows returned."""
    out = df.collect()
    nodes, found = [df._jdf.queryExecution().executedPlan()], []
    df._jdf.queryExecution().toRdd().count()
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            nodes.append(node.plan())
        elif name.startswith("Scan parquet"):
            m = node.metrics()
            if "/data" in node.toString():
                found.append((m.apply("numFiles").value(), m.apply("numOutputRows").value()))
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return found[0], out


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('masked')}"
    nodes = spark.range(200_000).selectExpr("id * 3 as k", "concat('name ', id, repeat('x', 20)) as name")
    masks.write_shards(nodes, "k", path, 50_000, group_bytes=200_000)
    return path


def test_masked_rows(spark, stored):
    rng = random.Random(1)
    for rows in ([], [0], [199_999, 5, 5, None, 300_000], [rng.randrange(200_000) for _ in range(500)], list(range(49_990, 50_010)), list(range(0, 200_000, 7))):
        got = masks.read_masked(spark, stored, spark.createDataFrame([(r,) for r in rows], "row long"))
        assert sorted((r["row"], r["k"]) for r in got.collect()) == sorted((r, 3 * r) for r in {x for x in rows if x is not None and x < 200_000})
        assert got.columns == ["row", "k", "name"]


def test_only_files_and_row_groups_with_rows_are_read(spark, stored):
    rows = spark.createDataFrame([(r,) for r in range(60_100, 60_150)], "row long")
    (files, read), out = scanned(masks.read_masked(spark, stored, rows))
    assert len(out) == 50 and files == 1 and read < 20_000
    rows = spark.createDataFrame([(10,), (160_000,)], "row long")
    (files, read), out = scanned(masks.read_masked(spark, stored, rows))
    assert len(out) == 2 and files == 2 and read < 40_000
    assert masks.read_masked(spark, stored, rows.limit(0)).collect() == []


def test_ranges_are_bounded():
    rng = random.Random(2)
    found = sorted([s, a, a + rng.randrange(5)] for s in range(3) for a in rng.sample(range(0, 100_000, 10), 400))
    joined = masks._joined(found)
    assert len(joined) == masks.RANGES
    assert all(any(s == t and a <= x and y <= b for t, a, b in joined) for s, x, y in found)
