"""Adjacency by ranges of sources against a full rewrite, and which files a delta leaves alone."""

import os
import random

from loomgraph.sources import tables
from loomgraph.streaming.adjacency import Adjacency

SCHEMA = "source long, target long, uid string, file string, revision long"


def files(root):
    return {os.path.relpath(os.path.join(d, x), root) for d, _, names in os.walk(f"{root}/edges/rows") for x in names if x.startswith("part-")}


def test_deltas_equal_a_full_rewrite(spark, tmp_path):
    """Files of 300 sources with a hub of half the edges: replaced, emptied, late and repeated; only ranges with an edge of them are written."""
    rng = random.Random(5)
    state = {f"f{k}": [(0 if rng.random() < 0.5 else rng.randrange(40 * k, 40 * k + 40), rng.randrange(300), f"u{k}/{i}") for i in range(60)] for k in range(7)}
    nodes = spark.createDataFrame([(i,) for i in range(300)], "row long")
    own = Adjacency(spark, f"file://{tmp_path}", span=40, files=2)
    frame = lambda some, revision: spark.createDataFrame([(*e, f, revision) for f in some for e in some[f]], SCHEMA)
    names = lambda *x: spark.createDataFrame(list(x), "file string, revision long")

    def same():
        edges = spark.createDataFrame([e for es in state.values() for e in es], "source long, target long, uid string")
        indptr, indices = tables.csr_write(edges, nodes)
        assert sorted((r["position"], r["target"], r["uid"]) for r in own.indices().collect()) == sorted((r["position"], r["target"], r["uid"]) for r in indices.collect())
        assert sorted(map(tuple, own.pointers(nodes).collect())) == sorted(map(tuple, indptr.where("row < 300").collect()))

    assert own.publish(frame(state, 1), names(*[(f, 1) for f in state])) == 7
    same()
    before = files(tmp_path)
    state["f3"] = [e for e in state["f3"] if e[0]][:10] + [(200, 1, "u3/new")]
    assert own.publish(frame({"f3": state["f3"], "f4": [(1, 1, "not named")]}, 2), names(("f3", 2))) == 3  # the hub's range, its own, and that of the new edge
    kept = before & files(tmp_path)
    assert {x.split("/")[2] for x in before - kept} == {"bucket=0", "bucket=3", "bucket=5"}
    same()
    state["f6"] = []
    own.publish(spark.createDataFrame([], SCHEMA), names(("f6", 2)))
    same()
    after = files(tmp_path)
    assert own.publish(frame({"f6": [(1, 2, "late")]}, 1), names(("f6", 1), ("f3", 2))) == 0 and files(tmp_path) == after
    same()


def test_adjacency_of_nothing(spark, tmp_path):
    own = Adjacency(spark, f"file://{tmp_path}")
    assert own.publish(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "file string, revision long")) == 0
    assert own.indices().collect() == []
