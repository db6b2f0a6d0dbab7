"""Owners of spans against a plain search, with files that are split over many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import nesting
from loomgraph.sources.shared import written


@pytest.fixture
def ranges(spark):
    """Small tables in as many ranges as there are shuffle partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain(rows):
    """{(file, uid): owner} of (file, uid, start, end, weight), owners being those without weight."""
    out = {}
    for file, uid, a, b, _ in rows:
        if None in (file, uid, a, b) or b < a:
            continue
        out[file, uid] = None
        above = [(s, -e, u) for f, u, s, e, w in rows if w is None and None not in (f, u, s, e) and f == file and s <= e and e >= b and (s, -e, u) < (a, -b, uid)]
        if above:
            out[file, uid] = max(above)[2]
    return out


def nested(rng, file, lo, hi, depth, rows):
    rows.append((file, len(rows), lo, hi, rng.choice([None, None, 1, 3])))
    at = lo
    while depth and at < hi:
        a = rng.randint(at, hi)
        b = rng.randint(a, hi)
        nested(rng, file, a, b, depth - 1, rows)
        at = b + 1 if rng.random() < 0.7 else hi


def check(spark, rows):
    df = spark.createDataFrame(rows, "file string, uid long, start long, end long, weight long")
    want = plain(rows)
    got = nesting.owners(df, F.col("weight").isNull(), written).collect()
    assert len(got) == len(rows)
    assert {(r["file"], r["uid"]): r["owner"] for r in got if (r["file"], r["uid"]) in want} == want
    assert all(r["owner"] is None for r in got if (r["file"], r["uid"]) not in want)
    n = {(f, u): 1 for f, u, _, _, w in rows if w is None}
    for f, u, *_, w in rows:
        if w is not None and (o := want.get((f, u))) is not None:
            n[f, o] += w
    assert {(r["file"], r["uid"]): r["complexity"] for r in nesting.complexity(df, written).collect()} == n


def test_nested_and_crossing_spans(spark, ranges):
    rng = random.Random(7)
    rows = []
    for file, depth in (("hot", 6), ("b", 3), ("c", 1)):
        for k in range(8 if file == "hot" else 1):
            nested(rng, file, k * 1000, k * 1000 + 999, depth, rows)
    rows.append(("hot", 900_001, -5, 10**6, None))  # one that every range is within
    for k in range(150):  # any spans, equal and empty ones among them
        a = rng.randrange(60)
        rows.append(("any", 910_000 + k, a, a + rng.choice([0, 0, 1, 5, 30]), rng.choice([None, 2])))
    check(spark, rows)


def test_nulls_and_no_rows(spark, ranges):
    check(spark, [("a", 1, 0, 9, None), ("a", 2, None, 3, None), ("a", 3, 5, 4, None), ("a", 4, 2, 3, 1), (None, 5, 0, 9, 1), ("a", 6, 3, None, 4)])
    df = spark.createDataFrame([], "file string, uid long, start long, end long, weight long")
    assert nesting.owners(df, F.lit(True), written).count() == 0


def test_files_are_split(spark, ranges):
    df = spark.range(4000).selectExpr("'one' as file", "id as uid", "id as start", "8000 - id as end")
    got = nesting.owners(df, F.lit(True), written)
    assert got.where("owner = uid - 1").count() == 3999 and got.where("owner is null").count() == 1
