"""The pattern language: its grammar on tiny tables, and walks on graphs with circles against plain enumeration."""

import random
from collections import Counter

import pytest

from loomgraph.operators.cypher import cypher, walks
from loomgraph.sources.shared import written

EDGES = "kind string, src_label string, src long, dst_label string, dst long, uid string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def small(spark):
    nodes = {
        "A": spark.createDataFrame([(1, "x AND y", 5), (2, "z", None), (3, "p, q", 7)], "id long, name string, size int"),
        "B": spark.createDataFrame([(1, "b1", True), (2, None, False)], "id long, name string, flag boolean"),
    }
    edges = [("K", "A", 1, "A", 2, "e1"), ("K", "A", 2, "A", 3, "e2"), ("K", "A", 2, "A", 2, "loop"), ("L", "A", 3, "B", 1, "e3"), ("L", "A", 1, "B", 1, "e4"), ("K", "B", 1, "A", 1, "e5"), ("K", "A", 1, "A", 2, "e6")]
    return nodes, spark.createDataFrame(edges, EDGES)


@pytest.mark.parametrize(
    "text, want",
    [
        ("MATCH (a:A)-[:K]->(b:A) WHERE a.name = 'x AND y' AND b.name <> 'q OR r' RETURN a.id, b.name", [(1, "z"), (1, "z")]),
        ("MATCH (a:A {name: 'p, q'}) RETURN a.id", [(3,)]),
        ("MATCH (a:A) RETURN coalesce(a.size, 0) AS s, a.id", [(0, 2), (5, 1), (7, 3)]),
        ("MATCH (a:A) WHERE a.size = 5 OR a.size = 7 AND a.id = 1 RETURN a.id", [(1,)]),
        ("MATCH (a:A) WHERE (a.size = 5 OR a.size = 7) AND NOT a.id IN [1, 9] RETURN a.id", [(3,)]),
        ("MATCH (a:A) WHERE NOT a.size = 5 RETURN a.id", [(3,)]),
        ("MATCH (a:A) WHERE a.size IS NULL OR a.size > 2 * 3 RETURN a.id", [(2,), (3,)]),
        ("MATCH (a:A) WHERE a.id IN $ids AND a.name CONTAINS $part RETURN a.id", [(2,)]),
        ("MATCH (a)-[:K]->(a) RETURN a.id", [(2,)]),
        ("MATCH (a)-[:K]->(b)-[:L]->(c) RETURN a.id, label(b) AS l, c.name", [(1, "A", "b1"), (2, "A", "b1")][1:] + [(1, "A", "b1")]),
        ("MATCH (a)-[r:L]->(b) RETURN r.uid, r.kind, label(a) AS l", [("e3", "L", "A"), ("e4", "L", "A")]),
        ("MATCH (b:B)<--(a) RETURN a.id ORDER BY a.id DESC LIMIT 1", [(3,)]),
        ("MATCH (a:A)-[:K|L]-(b) WHERE a.id = 1 RETURN label(b) AS l, b.id", [("A", 2), ("A", 2), ("B", 1), ("B", 1)]),
        ("MATCH (a:A)-[:K]->(b) RETURN a.id, count(*) AS n, count(DISTINCT b.id) AS d ORDER BY n DESC", [(1, 2, 1), (2, 2, 2)]),
        ("MATCH (a:A) RETURN count(a.size) AS n, sum(a.size) AS s, min(a.name)", [(2, 12, "p, q")]),
        ("MATCH (a:A)-[:K]->(b:A), (a)-[:L]->(c:B) WHERE b.id > c.id RETURN DISTINCT a.id, b.id, c.id", [(1, 2, 1)]),
        ("MATCH (a:A) RETURN a.name ORDER BY a.size, a.id SKIP 1 LIMIT 1", [("x AND y",)]),
        ("MATCH (a:A)-[:K*0..1]->(b:A) WHERE a.id = 3 RETURN b.id", [(3,)]),
        ("MATCH (a:B {flag: TRUE}) RETURN toUpper(a.name) AS n", [("B1",)]),
        ("match (a:A) where a.name = 'it\\'s' return a.id", []),
    ],
)
def test_shapes(small, text, want):
    assert rows(cypher(text, *small, written, ids=[1, 2], part="z")) == sorted(want, key=repr)


@pytest.mark.parametrize("text", ["CREATE (n)", "MATCH x RETURN x.p", "MATCH (a:C) RETURN a.id", "MATCH (a:A) RETURN a.none", "MATCH (a:A) WHERE a.name = $q RETURN a.id", "MATCH (a:A) RETURN b.id", "MATCH (a:A), (b:B) RETURN a.id", "MATCH (a:A) RETURN a.id; DROP", "MATCH (a:A) RETURN DISTINCT a.id ORDER BY a.name", "MATCH (a:A)-[*2]->(b) RETURN b.id", "MATCH (a:A)-[*3..2]->(b) RETURN b.id", "MATCH (a:A) RETURN a.id SET a.id", "MATCH (a:A)-[r:K*1..2]->(b) RETURN r.uid", "MATCH (a:A)-[:K]->(a:B) RETURN a.id", "MATCH (a:A) RETURN a"])
def test_what_cannot_be_asked(small, text):
    with pytest.raises(ValueError):
        cypher(text, *small, written)


def test_conditions_and_labels_reach_the_scans(spark, tmp_path, small):
    """Only columns asked for are read; conditions on a node and the pattern's labels are pushed to the files."""
    small[0]["A"].write.parquet(f"{tmp_path}/a")
    small[1].write.parquet(f"{tmp_path}/e")
    df = cypher("MATCH (a:A)-[:K]->(b:A) WHERE a.size > 5 RETURN b.id", {"A": spark.read.parquet(f"{tmp_path}/a")}, spark.read.parquet(f"{tmp_path}/e"), written)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThan(size,5)" in plan and "EqualTo(dst_label,A)" in plan and "name" not in plan


@pytest.mark.parametrize("low, high", [(1, 6), (3, 6), (0, 4), (2, 2)])
def test_walks_on_circles(spark, low, high):
    """Distinct ends and numbers of walks as by taking all walks one by one; in a circle no level is larger than the ends."""
    rng = random.Random(low * 10 + high)
    pairs = {(i, (i + 1) % 6) for i in range(6)} | {(rng.randrange(12), rng.randrange(12)) for _ in range(10)}
    edges = [("X" if a % 2 else "Y", a, "X" if b % 2 else "Y", b) for a, b in sorted(pairs)] + [("Y", 0, "X", 1)] * 2
    starts = [("X" if v % 2 else "Y", v) for v in range(0, 12, 3)]
    now = Counter((s, s) for s in starts)
    want = Counter(now) if low == 0 else Counter()
    for depth in range(1, high + 1):
        after = Counter()
        for (s, t), n in now.items():
            for a, b, c, d in edges:
                if (a, b) == t:
                    after[s, (c, d)] += n
        now = after
        if depth >= low:
            want.update(now)
    df, frames = spark.createDataFrame(edges, "l1 string, s long, l2 string, t long"), []

    def noted(x):
        frames.append(written(x))
        return frames[-1]

    first = spark.createDataFrame(starts + starts, "l string, v long")
    assert {((r["l1"], r["s"]), (r["l2"], r["t"])): r["n"] for r in walks(df, first, low, high, False, noted).collect()} == dict(want)
    frames.clear()
    got = [((r["l1"], r["s"]), (r["l2"], r["t"]), r["n"]) for r in walks(df, first, low, high, True, noted).collect()]
    assert sorted(got) == sorted((*k, 1) for k in want)
    if low == 1:
        assert sum(x.count() for x in frames[2:]) == len(want)  # the frontiers together are the ends reached
    text = f"MATCH (a)-[*{low}..{high}]->(b:X) RETURN DISTINCT a.id, b.id"
    nodes = {k: spark.createDataFrame([(i,) for i in range(12) if (i % 2 == 1) == (k == "X")], "id long") for k in "XY"}
    graph = df.selectExpr("'K' as kind", "l1 as src_label", "s as src", "l2 as dst_label", "t as dst", "'u' as uid")
    some = [r for r in rows(cypher(text, nodes, graph, written)) if r[0] % 3 == 0]
    assert some == sorted({(s[1], t[1]) for s, t in want if t[0] == "X"}, key=repr)
