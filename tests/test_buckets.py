"""State in buckets: the rows of plain merges, and which files a batch leaves alone."""

import os

import pytest

from loomgraph.streaming import publish
from loomgraph.streaming.buckets import Buckets

SCHEMA = "key long, rev long, value string"


def files(root):
    return {os.path.relpath(os.path.join(d, x), root) for d, _, names in os.walk(f"{root}/rows") for x in names if x.startswith("part-")}


def content(state):
    return {r["key"]: (r["rev"], r["value"]) for r in state.read().collect()}


def test_a_batch_writes_its_own_buckets_only(spark, tmp_path):
    """Newest revisions win, late and repeated ones change nothing, and of 16 buckets a batch of one key replaces one."""
    state = Buckets(spark, f"file://{tmp_path}", "key", "rev", SCHEMA, buckets=16)
    assert state.read().count() == 0
    first = [(k, 1, f"a{k}") for k in range(400)]
    assert state.upsert(spark.createDataFrame(first, SCHEMA)) == 16
    before = files(tmp_path)
    assert len(before) == 16
    batch = [(7, 3, "z"), (7, 3, "y"), (7, 2, "x"), (8, 1, "late"), (9, 0, "late"), (None, 5, "no key"), (10, None, "no revision")]
    assert state.upsert(spark.createDataFrame(batch, SCHEMA)) == 1
    after = files(tmp_path)
    assert len(before - after) == 1 and len(after) == 16
    assert content(state) == {k: (1, f"a{k}") for k in range(400)} | {7: (3, "y")}
    assert state.upsert(spark.createDataFrame(batch, SCHEMA)) == 0 and state.upsert(spark.createDataFrame([], SCHEMA)) == 0
    assert files(tmp_path) == after
    again = Buckets(spark, f"file://{tmp_path}", "key", "rev", SCHEMA, buckets=16)
    assert content(again)[7] == (3, "y")
    with pytest.raises(ValueError):
        Buckets(spark, f"file://{tmp_path}", "key", "rev", SCHEMA, buckets=8)
    with pytest.raises(ValueError):
        Buckets(spark, f"file://{tmp_path}/x", "id", "rev", SCHEMA)


def test_a_run_that_breaks_off_is_carried_out(spark, tmp_path, monkeypatch):
    """Whether it breaks off before the buckets are replaced or after some are gone, opening the state again completes it."""
    root = f"file://{tmp_path}"
    state = Buckets(spark, root, "key", "rev", SCHEMA, buckets=4)
    state.upsert(spark.createDataFrame([(k, 1, "a") for k in range(40)], SCHEMA))
    for lost in (False, True):
        def broken(self, name):
            if lost:
                self._fs.delete(self._path("rows/bucket=1"), True)
                self._fs.delete(self._path("rows/bucket=2"), True)
            raise RuntimeError("the driver is gone")

        with monkeypatch.context() as m:
            m.setattr(Buckets, "_apply", broken)
            with pytest.raises(RuntimeError):
                state.upsert(spark.createDataFrame([(k, 2 + lost, "b") for k in range(0, 40, 2)], SCHEMA))
        state = Buckets(spark, root, "key", "rev", SCHEMA, buckets=4)
        assert content(state) == {k: (2 + lost, "b") if k % 2 == 0 else (1, "a") for k in range(40)}
        assert not os.listdir(f"{tmp_path}/pending") and not os.listdir(f"{tmp_path}/staged")


def test_paths_are_replaced_whole(spark, tmp_path):
    schema = "path string, rev int, line int"
    state = Buckets(spark, f"file://{tmp_path}", "path", "rev", schema, buckets=8, files=2)
    paths = lambda *x: spark.createDataFrame(list(x), "path string, rev int")
    rows = spark.createDataFrame([(f"f{i}", 1, k) for i in range(20) for k in range(3)], schema)
    state.replace(rows, rows.select("path", "rev"))
    before = files(tmp_path)
    new = spark.createDataFrame([("f3", 2, 9), ("f4", 1, 9), ("f5", 7, 9)], schema)  # f4 is not new, f5's revision isn't the one named
    assert 1 <= state.replace(new, paths(("f3", 2), ("f4", 1), ("f6", 2))) <= 2
    assert len(before - files(tmp_path)) <= 4
    got = sorted((r["path"], r["rev"], r["line"]) for r in state.read().where("path in ('f3', 'f4', 'f5', 'f6')").collect() if r["line"] is not None)
    assert got == [("f3", 2, 9)] + [(f"f{i}", 1, k) for i in (4, 5) for k in range(3)]
    assert state.replace(rows, paths(("f6", 1))) == 0  # late, after a deletion


def test_a_stream_grows_by_its_batches(spark, tmp_path):
    """Three batches of one new key each; a hot key with most of the rows."""
    for k in range(3):
        spark.createDataFrame([(k, k, f"v{k}")] + [(99, 10 * k + i, f"h{i}") for i in range(300)], SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
    state = Buckets(spark, f"file://{tmp_path}/state", "key", "rev", SCHEMA)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    publish.run(source, state, f"{tmp_path}/ckpt")
    assert content(state) == {k: (k, f"v{k}") for k in range(3)} | {99: (319, "h299")}
