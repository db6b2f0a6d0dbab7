"""Ranges of prepared texts against loops over all segments, with files that are split over many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import coordinates
from loomgraph.sources.shared import written


@pytest.fixture
def ranges(spark):
    """Small tables in as many ranges as there are shuffle partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain(segments, start, end):
    """(state, original start, original end, pieces) by looking at each segment of a file."""
    total = max((s[1] for s in segments), default=0)
    if start is None or end is None or end < start or start < 0 or end > total or not segments:
        return "Invalid", None, None, None
    if start == end:
        found = []
        for a, b, kind, o, e in segments:
            if a < start < b:
                return ("Exact", o + start - a, o + start - a, 0) if kind == "Direct" else ("Unmappable", None, None, 0)
            if kind != "Synthetic" and b == start:
                found.insert(0, e)
            if kind != "Synthetic" and a == start:
                found.append(o)
        if not found:
            return "Unmappable", None, None, 0
        return ("Exact" if found[0] == found[-1] else "Ambiguous"), found[0], found[-1], 0
    met = []
    for a, b, kind, o, e in segments:
        lo, hi = max(a, start), min(b, end)
        if lo < hi:
            if kind == "Direct":
                met.append((kind, o + lo - a, o + hi - a))
            elif kind == "Atom" and (lo, hi) == (a, b):
                met.append((kind, o, e))
            else:
                met.append((kind, None, None))
    if len(met) > 1:
        return "Compound", met[0][1], met[-1][2], len(met)
    kind, lo, hi = met[0]
    return ("Synthetic" if kind == "Synthetic" else "Exact" if lo is not None else "Unmappable"), lo, hi, 1


def test_projection(spark, ranges):
    rng = random.Random(3)
    segments, asked = {}, []
    for file, n in (("hot", 120), ("b", 7), ("c", 1), ("none", 0)):
        at, o, own = 0, 10, []
        for _ in range(n):
            k, kind = rng.randint(1, 6), rng.choice(["Direct", "Direct", "Atom", "Synthetic"])
            o += rng.choice([0, 0, 2])
            size = k if kind == "Direct" else rng.randint(0, 3)
            own.append((at, at + k, kind, *((None, None) if kind == "Synthetic" else (o, o + size))))
            at, o = at + k, o + (0 if kind == "Synthetic" else size)
        segments[file] = own
        for i in range(300 if n > 100 else 60):
            a = rng.randint(0, at + 1)
            asked.append((file, i, a, a + rng.choice([0, 0, 1, 2, 5, 40])))
    asked += [("b", 900, None, 3), ("b", 901, 4, 2), ("b", 902, -1, 2), ("b", 903, -1, -1)]
    rows = [(f, *s) for f, own in segments.items() for s in own]
    rng.shuffle(rows)
    got = coordinates.project(
        spark.createDataFrame(rows, "file string, start long, end long, kind string, original_start long, original_end long"),
        spark.createDataFrame(asked, "file string, id long, start long, end long"), written,
    ).collect()
    want = {(f, i): plain(segments[f], a, b) for f, i, a, b in asked}
    seen = {(r["file"], r["id"]): tuple(r[2:]) for r in got}
    assert len(got) == len(asked) and {k: (seen[k], want[k]) for k in want if seen[k] != want[k]} == {}
    assert {w[0] for w in want.values()} == {"Exact", "Ambiguous", "Unmappable", "Compound", "Synthetic", "Invalid"}


def test_latest_over_a_split_group(spark, ranges):
    rows = [("g", k, k if k in (0, 700) else None) for k in range(2000)] + [("h", k, None) for k in range(50)] + [("i", 1, 5), (None, 1, 1)]
    got = coordinates.latest(spark.createDataFrame(rows, "g string, at long, x long"), "g", ["at"], F.col("x"), "v", written).collect()
    assert len(got) == 2051
    assert all(r["v"] == (None if r["g"] == "h" else 5 if r["g"] == "i" else 0 if r["at"] < 700 else 700) for r in got)


def test_no_rows(spark):
    s = spark.createDataFrame([], "file string, start long, end long, kind string, original_start long, original_end long")
    r = spark.createDataFrame([("a", 1, 0, 1)], "file string, id long, start long, end long")
    assert [tuple(x) for x in coordinates.project(s, r, written).collect()] == [("a", 1, "Invalid", None, None, None)]
    assert coordinates.project(s, r.limit(0), written).count() == 0
