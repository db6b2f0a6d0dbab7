"""Graph packages: round trips, empty labels, pruned reads, and faults that are told."""

import copy
import json
import uuid

import pytest

from loomgraph.sources import package as P


def made(spark, root):
    files = spark.createDataFrame([(f"p/{i % 3} ü", f"f{i:02}", i) for i in range(40)] + [("q", "g", None)], "file string, path string, size long")
    people = spark.createDataFrame([], "file string, id long, name string")
    edges = spark.createDataFrame([(f"f{i:02}", f"f{i * 7 % 40:02}", f"u{i}") for i in range(40)] + [("g", "g", "loop"), ("g", "g", "loop2")], "source string, target string, uid string")
    return P.write_package(spark, root, {"File": (files, "path"), "Person": (people, "id")}, {"USES": ("File", "File", edges), "KNOWS": ("Person", "File", edges.limit(0).selectExpr("cast(null as long) as source", "target", "uid"))}), files, edges


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def test_round_trip(spark, root):
    own, files, edges = made(spark, root)
    own = P.Package(spark, root)
    assert sorted(map(tuple, own.nodes("File").select("file", "path", "size").collect()), key=str) == sorted(map(tuple, files.collect()), key=str)
    assert sorted(r["row"] for r in own.nodes("File").collect()) == list(range(41))
    assert sorted(map(tuple, own.edges("USES").collect())) == sorted(map(tuple, edges.collect()))
    assert own.nodes("Person").count() == 0 and own.nodes("Person").columns == ["file", "id", "name", "row"] and own.edges("KNOWS").count() == 0
    assert own.faults().count() == 0
    assert (own.about["node_total"], own.about["edge_total"]) == (41, 42)
    some = own.nodes("File", ["q"])
    assert [r["path"] for r in some.collect()] == ["g"] and "PartitionFilters: [" in some._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="holds a package"):
        made(spark, root)


def test_what_is_refused(spark, root):
    nodes = spark.createDataFrame([("a", 1)], "file string, id long")
    with pytest.raises(ValueError, match="1 edges have an end"):
        P.write_package(spark, root, {"N": (nodes, "id")}, {"E": ("N", "N", spark.createDataFrame([(1, 2, "u")], "source long, target long, uid string"))})
    with pytest.raises(ValueError, match="no package"):
        P.Package(spark, root)


def test_faults(spark, root, tmp_path):
    own, *_ = made(spark, root)
    for change, says in (
        (lambda m: m.update(version=2), "version"),
        (lambda m: m["nodes"]["File"].update(primary_key="x"), "primary key"),
        (lambda m: m["edges"]["USES"].update({"to": "Nobody"}), "unknown end"),
        (lambda m: m["edges"]["USES"].update(rows=41), "edge_total"),
        (lambda m: m.update(node_total=40), "node_total"),
    ):
        m = copy.deepcopy(own.about)
        change(m)
        with pytest.raises(ValueError, match=says):
            P.checked(m)
    own.about["edges"]["USES"]["rows"] = 41
    own.about["nodes"]["File"]["rows"] = 40
    assert {tuple(r) for r in own.faults().collect()} == {("File", "shards do not add up"), ("USES", "edges do not add up"), ("USES", "ends are not there")}
    own = P.Package(spark, root)
    spark.createDataFrame([("f00", 1, 41)], "path string, size long, row long").write.mode("append").parquet(f"{root}/nodes/File/file=q")
    assert {tuple(r) for r in own.faults().collect()} == {("File/q", "the rows of the shard differ"), ("File", "keys are null or repeated")}
    assert json.dumps(own.about)
