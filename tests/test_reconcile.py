"""Reconciliation of files: what is written, what is left alone, and what absence does."""

import os

import pytest

from loomgraph.streaming.buckets import Buckets
from loomgraph.streaming.reconcile import HEAD, reconcile


def test_reconcile(spark, tmp_path):
    root = f"{tmp_path}/corpus"
    corpus = Buckets(spark, f"file://{root}", "origin", "revision", f"{HEAD}, body string", buckets=8)
    files = lambda rows: spark.createDataFrame(rows, "origin string, digest string, recipe string, body string")
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "origin string")
    stored = lambda: {os.path.join(d, f) for d, _, fs in os.walk(f"{root}/rows") for f in fs if f.endswith(".parquet")}
    heads = lambda: {r["origin"]: (r["state"], r["revision"], r["body"]) for r in corpus.read().collect()}

    first = [(f"f{i}", f"d{i}", "r", f"b{i}") for i in range(20)]
    got = reconcile(corpus, "s", files([*first, first[3], (None, "x", "r", "x")]))
    assert (got["added"], got["changed"], got["removed"]) == (20, 0, 0) and got["buckets"] > 1
    was = stored()
    assert reconcile(corpus, "s", files(first[:7])) == {"added": 0, "changed": 0, "removed": 0, "buckets": 0}
    assert reconcile(corpus, "s", files(first), full=True)["buckets"] == 0 and stored() == was
    # A delta: one changed by content, one by recipe, one absent, one absent that never was, one absent but there.
    got = reconcile(corpus, "s", files([("f0", "new", "r", "n0"), ("f1", "d1", "r2", "b1"), first[2]]), names("f5", "zz", "f2", None))
    assert (got["added"], got["changed"], got["removed"]) == (0, 2, 1) and len(was & stored()) > 0
    now = heads()
    assert now["f0"] == ("Active", 2, "n0") and now["f1"] == ("Active", 2, "b1") and now["f2"] == ("Active", 1, "b2") and now["f5"] == ("Removed", 2, None) and len(now) == 20
    # Absent once more changes nothing; it comes again.
    assert reconcile(corpus, "s", files([]), names("f5"))["buckets"] == 0
    assert reconcile(corpus, "s", files([first[5]]))["added"] == 1 and heads()["f5"] == ("Active", 3, "b5")
    # Another source's full batch leaves these alone, and may not take their origins.
    assert reconcile(corpus, "t", files([("t0", "d", "r", "b")]), full=True)["removed"] == 0
    with pytest.raises(ValueError, match="another source"):
        reconcile(corpus, "t", files([("f1", "d", "r", "b")]))
    got = reconcile(corpus, "s", files(first[10:]), full=True)
    assert (got["added"], got["changed"], got["removed"]) == (0, 0, 10)
    assert sum(x[0] == "Active" for x in heads().values()) == 11
