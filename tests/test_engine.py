"""Facts of the engine's operators on tiny frames, and all registered queries against their SQL on the smallest tables."""

import decimal
import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from loomgraph.functions import text as T
from loomgraph.operators import links, records, retrieval, versions
from loomgraph.plans.catalog import oracle_sql, queries
from loomgraph.operators.textindex import TextIndex
from loomgraph.sources import tables
from loomgraph.sources.shared import written

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for n in NAMES:
        c.sql(f"CREATE VIEW {n} AS SELECT * FROM '{sf_dir}/{n}.parquet'")
    return c


def plain(x):
    """A value as both engines have it: numbers to nine digits, times without zone."""
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        x = float(x)
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return x.replace(tzinfo=None).isoformat() if hasattr(x, "tzinfo") else str(x)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_values(spark, sf_dir, duck, name):
    got = queries()[name](spark, sf_dir)
    want = duck.sql(oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    mine = sorted((repr([plain(r[c]) for c in columns]) for r in got.collect()))
    order = [want.columns.index(c) for c in columns]
    theirs = sorted(repr([plain(r[k]) for k in order]) for r in want.fetchall())
    assert mine == theirs


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_link_facts(spark):
    raw = spark.createDataFrame([("alpha", "beta"), ("alpha", "ghost"), ("alpha", "ghost"), ("alpha", "alpha"), ("alpha", None), ("beta", "alpha")], "source string, target string")
    pages = spark.createDataFrame([("alpha",), ("beta",), ("lonely",)], "slug string")
    assert rows(links.stats(links.link_graph(raw), pages)) == [(3, 3, 2, 1, 1)]


def test_stale_facts(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e")], "source string, target string")
    causes = written(spark.createDataFrame([("c", "SourceChanged")], "slug string, cause string"))
    assert rows(links.stale(e, causes, written)) == [("a", "Dependency", "c"), ("b", "Dependency", "c"), ("c", "SourceChanged", None)]


def test_vectors(spark):
    v = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, None), (3, [-1.0, 0.0])], "k long, v array<float>")
    assert rows(v.select("k", retrieval.cosine_distance(v["v"], [1.0, 0.0]))) == [(0, 1.0), (1, 0.0), (2, None), (3, 2.0)]
    assert [r[0] for r in retrieval.knn(v, "k", "v", [1.0, 0.1], 2).collect()] == [1, 0]
    for q in ([], [float("nan")], [float("inf"), 1.0]):
        with pytest.raises(ValueError):
            retrieval.cosine_distance(v["v"], q)
    with pytest.raises(ValueError):
        retrieval.cosine_distance(v["v"], [0.0, 0.0])
    for bad in ([1.0], [1.0, float("inf")], [float("nan"), 1.0], [None, 1.0], []):
        w = spark.createDataFrame([(0, [1.0, 1.0]), (1, bad)], "k long, v array<float>")
        for metric in ("cosine", "l2", "dot"):
            with pytest.raises(Exception, match="vector"):
                retrieval.knn(w, "k", "v", [1.0, 0.0], 1, metric).collect()
    with pytest.raises(Exception, match="direction"):
        retrieval.knn(spark.createDataFrame([(0, [0.0, 0.0])], "k long, v array<float>"), "k", "v", [1.0, 0.0], 1).collect()


def test_fusion_ranks_whole_lists(spark):
    """A row far down in both lists beats one that is first in a single list only if both shares count."""
    lex = spark.createDataFrame([(i, 100.0 - i) for i in range(60)], "k long, score double")
    near = spark.createDataFrame([(i, (i * 7 % 60) / 60.0) for i in range(60)], "k long, distance double")
    want = sorted(((round(1 / (61 + i) + 1 / (61 + sorted((j * 7 % 60, j) for j in range(60)).index((i * 7 % 60, i))), 9), -i) for i in range(60)), reverse=True)
    got = [(r["score"], -r["k"], r["place"], r["total"]) for r in retrieval.fused_page(lex, near, "k", written, 10, 10).orderBy("place").collect()]
    assert got == [(s, k, 11 + n, 60) for n, (s, k) in enumerate(want[10:20])]


def test_fusion_of_first_ones(spark):
    """Of either list only the first k have a share: a row that is just beyond k in both is not found at all."""
    lex = spark.createDataFrame([(i, 100.0 - i) for i in range(60)], "k long, score double")
    near = spark.createDataFrame([(i, float((i * 7) % 60)) for i in range(60)], "k long, distance double")
    share = Counter()
    for rank, i in enumerate(range(5), 1):
        share[i] += 1 / (60 + rank)
    for rank, i in enumerate(sorted(range(60), key=lambda i: (i * 7) % 60)[:5], 1):
        share[i] += 1 / (60 + rank)
    want = sorted(((-round(s, 9), i) for i, s in share.items()))[:5]
    got = sorted((r["place"], -r["score"], r["k"]) for r in retrieval.fused_first(lex, near, "k", 5).collect())
    assert got == [(n, *w) for n, w in enumerate(want, 1)]


def test_text_index(spark, tmp_path):
    docs = spark.createDataFrame([(i, ["alpha beta", "beta", "", None, "gamma gamma alpha"][i % 5], i % 4) for i in range(40)], "k long, t string, f long")
    own = TextIndex(spark, f"file://{tmp_path}", {"t": T.tokens(docs["t"])})
    assert own.state() == "Missing"
    for f in range(4):
        own.append(docs.where(docs["f"] <= f), "k", docs["f"])
    assert own.state() == "Ready" and own.append(docs, "k", docs["f"]) == 4 == own.store.head()
    want = rows(retrieval.bm25(docs, "k", T.tokens(docs["t"]), ["alpha", "gamma", "none"]))
    assert rows(own.bm25("t", ["alpha", "Gamma", "none"])) == want and len(own.segments()) == 4
    assert own.merge(4) == 5 and len(own.segments()) == 1 and rows(own.bm25("t", ["alpha", "gamma"])) == want
    assert TextIndex(spark, f"file://{tmp_path}", {"u": T.tokens(docs["t"])}).state() == "Incompatible"


def test_gates(spark):
    """Facts about prerequisites, children, cancelled tasks and circles."""

    def run(tasks, deps):
        t = spark.createDataFrame([(i, s, o, p, 1) for i, s, o, p in tasks], "id long, status string, own boolean, parent long, session long")
        d = spark.createDataFrame(deps, "id long, needs long")
        g = records.gates(t, d, written)
        return {r["id"]: (r["completion"], r["ready"], r["valid"]) for r in g.collect()}, rows(records.closable(g, t))

    # An open prerequisite does not count although its checks pass; a completed one with failing checks does not either.
    assert run([(1, "open", True, None), (2, "open", True, None), (3, "completed", False, None), (4, "open", True, None), (5, "completed", True, None), (6, "open", True, None)], [(2, 1), (4, 3), (6, 5)]) == ({1: (True, True, False), 2: (False, False, False), 3: (False, False, False), 4: (False, False, False), 5: (True, False, True), 6: (True, True, False)}, [(1, False)])
    # A completed task falls with what it needs, along the chain; closing needs all valid.
    assert run([(1, "open", True, None), (2, "completed", True, None), (3, "completed", True, None)], [(2, 1), (3, 2)])[0] == {1: (True, True, False), 2: (False, False, False), 3: (False, False, False)}
    assert run([(1, "completed", True, None), (2, "completed", True, None), (3, "cancelled", False, None)], [(2, 1)]) == ({1: (True, False, True), 2: (True, False, True), 3: (False, False, False)}, [(1, True)])
    # A cancelled task has no prerequisites, and can be none.
    assert run([(1, "cancelled", True, None), (2, "open", True, None), (3, "open", True, None), (4, "cancelled", True, None)], [(2, 1), (4, 3)])[0] == {1: (False, False, False), 2: (False, False, False), 3: (True, True, False), 4: (False, False, False)}
    # Parents wait for children but are ready without them; a cancelled child counts as closed unless something below it is open.
    assert run([(1, "open", True, None), (2, "open", True, 1), (3, "completed", True, None), (4, "cancelled", True, 3), (5, "completed", True, None), (6, "cancelled", True, 5), (7, "open", True, 6)], [])[0] == {1: (False, True, False), 2: (True, True, False), 3: (True, False, True), 4: (False, False, False), 5: (False, False, False), 6: (False, False, False), 7: (True, True, False)}
    for tasks, deps in (([(1, "completed", True, None), (2, "completed", True, None)], [(1, 2), (2, 1)]), ([(1, "open", True, None), (2, "open", True, 1)], [(2, 1)])):
        with pytest.raises(ValueError):
            run(tasks, deps)


def test_validate_parents(spark):
    t = spark.createDataFrame([(1, 1, None), (2, 1, 1), (3, 2, 1), (4, 2, 4), (5, 2, 99)], "id long, session long, parent long")
    assert rows(records.validate(t, spark.createDataFrame([], "id long, needs long"))) == [(3, "parent of another session"), (4, "is its own parent"), (5, "unknown parent")]


def test_guarded(spark):
    assert records.guarded(spark.range(5), 5).count() == 5
    with pytest.raises(ValueError):
        records.guarded(spark.range(6), 5)


def test_preview_and_yaml(spark):
    df = spark.createDataFrame([("\n\t ", " a body"), (" sum ", "x"), (None, "abcde\nfghij klm"), (None, "a b cdefghijklmnop"), (None, None)], "s string, b string")
    assert [r[0] for r in df.select(T.preview(df["s"], df["b"], 10)).collect()] == [" a body", " sum ", "abcde…", "a b cdefgh…", ""]
    kinds = {"0x1F": "number", "0o17": "number", "0o18": "string", ".inf": "number", "-.Inf": "number", ".nan": "number", "+.NaN": "string", "1e3": "number", ".": "string", "Null": "null", "yes": "string"}
    df = spark.createDataFrame([(k,) for k in kinds], "v string")
    assert {r[0]: r[1] for r in df.select("v", T.yaml_kind(df["v"])).collect()} == kinds


def test_cursors(spark):
    t = spark.createDataFrame([(1, "x")], "record_id long, payload string")
    assert records.acyclic(spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "id long, needs long"), written).count() == 3
    q = {"a": 1}
    assert records.after(q, "g", records.cursor(q, "g", "x")) == "x"
    for bad in (records.cursor(q, "h", "x"), "zz", ""):
        with pytest.raises(ValueError):
            records.after(q, "g", bad)
    with pytest.raises(ValueError):
        records.project(t, ["payload"])


def test_store_conflicts(spark, tmp_path):
    s = versions.Store(spark, f"file://{tmp_path}")
    df = spark.range(3)
    v = s.commit(df, 0)
    s.tag("t")
    s.tag("t")
    s.commit(spark.range(5), v)
    with pytest.raises(versions.Conflict):
        s.commit(df, v)
    with pytest.raises(versions.Conflict):
        s.tag("t")
    assert s.clean() == 1 and s.resolve("none") == "Unresolved"
    assert s.read().count() == 5 and s.at_tag("t").count() == 3 and s.at_tag("none") is None and s.read(version=v).count() == 3


def test_manifest():
    good = '{"version": 3, "nodes": [{"label": "A", "primary_key": "k", "rows": 2, "columns": [{"name": "k", "type": "STRING"}], "shards": [{"file": "f", "row_base": 0, "rows": 2}]}], "edges": []}'
    assert tables.manifest(good)["version"] == 3
    for a, b in (('"version": 3', '"version": 2'), ('"rows": 2,', '"rows": 3,'), ("STRING", "FLOAT"), ('"k", "rows"', '"z", "rows"')):
        with pytest.raises(ValueError):
            tables.manifest(good.replace(a, b, 1))
