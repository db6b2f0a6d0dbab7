"""Queries against their SQL on small tables made to differ where round 3 found them to."""

from datetime import datetime

import pytest

import __spark_entry__


@pytest.fixture
def against(spark, tmp_path):
    """Runs a query on tables of (schema, rows), and tells its rows and those of its SQL, both sorted."""
    import duckdb

    def go(name, tables):
        db = duckdb.connect()
        for t, (schema, rows) in tables.items():
            path = f"{tmp_path}/{t}.parquet"
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)
            db.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')")
        got = __spark_entry__.queries()[name](spark, str(tmp_path))
        want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
        return sorted(map(tuple, got.collect()), key=str), sorted(want, key=str)

    return go


PAGES = "page_id long, url string, html string"


def test_ignored_paths_with_slashes_at_the_end(against):
    paths = ["a.b/en/25/", "a.b/en/25", "a.b/en/15", "a.b/25/x", "a.b/m.c/x", "m.a/x", "m.a5/x", "m.a5", "blog.a/de/x", "blog.a/de", "blog.a/en/de/x", "blog.a/25/x5", "blog.a5", "a.b/x15/y5", "a.b//5", "a.b/15/"]
    got, want = against("s13_s19_ignored_paths", {"pages": (PAGES, [(i, f"https://{p}?q#f", "") for i, p in enumerate(paths)])})
    assert got == want


def test_documents_with_references_cut_short(against):
    page = '<html><title>{0}</title><body><article><h1>x</h1><p>{0} <b>y</b></p></article><a href="/a&amp;b">{0}</a></body></html>'
    tables = {"pages": (PAGES, [(i, f"https://a.b/{i}", page.format(x)) for i, x in enumerate(["a &amp; b", "a&amp", "a &quot;b&quot; &lt", "&amp;quot; & c", "&", "&#65; &amp;amp;"])])}
    for name in ("s14_documents", "d15_page_references", "d1_page_links"):
        got, want = against(name, tables)
        assert got == want


def test_semantic_search_builds_no_text_index(spark, sf_dir, monkeypatch):
    from loomgraph.plans import retrieval

    monkeypatch.setattr(retrieval, "index", lambda *_: pytest.fail("an index is built"))
    assert __spark_entry__.queries()["h4_semantic_task"](spark, sf_dir).count() == 20


def test_fusion_without_ranking_the_lists(spark, monkeypatch):
    from loomgraph.operators import retrieval
    from loomgraph.sources.shared import written

    monkeypatch.setattr(retrieval, "numbered", lambda *_: pytest.fail("a list is ranked whole"))
    n = 1500
    lex = {k: (k * 7919) % 97 / 10 for k in range(n)}
    near = {k: (k * 104729) % 89 / 10 for k in range(500, n + 700)}
    ranks = [{k: i + 1 for i, (k, _) in enumerate(sorted(x.items(), key=lambda y: (f * y[1], y[0])))} for f, x in ((-1, lex), (1, near))]
    score = {k: round(sum(1 / (60 + r[k]) for r in ranks if k in r), 9) for k in lex | near}
    want = [(k, score[k]) for k in sorted(score, key=lambda k: (-score[k], k))]
    frames = [spark.createDataFrame(list(x.items()), f"k long, {c} double") for c, x in (("score", lex), ("distance", near))]
    for offset, size in ((0, 20), (10, 10), (90, 40)):
        got = retrieval.fused_page(*frames, "k", written, offset, size).orderBy("place").collect()
        assert [(r["k"], r["score"]) for r in got] == want[offset : offset + size]
        assert {r["total"] for r in got} == {len(score)}


def test_postings_are_counted_without_moving_them(spark, tmp_path):
    from pyspark.sql import functions as F

    from loomgraph.operators.textindex import TextIndex

    docs = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "a")], "k long, t string")
    own = TextIndex(spark, f"file://{tmp_path}", {"t": F.filter(F.split(F.coalesce("t", F.lit("")), " "), lambda w: w != "")})
    found = own.postings(docs, "k", F.lit(0))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1
    rows = {(r["term"], r["key"], r["tf"], r["n"]) for r in found.collect()}
    assert {("a", 1, 1, 3), ("b", 1, 2, 3), ("a", 4, 1, 1)} <= rows
    assert found.where("term = '' and key is null").agg(F.sum("tf"), F.sum("n")).first() == (4, 4)


def test_pairs_that_share_a_node_are_counted_not_made(spark):
    from loomgraph.operators.cypher import cypher
    from loomgraph.sources.shared import written

    where = [(i, i % 3 if i % 7 else None, i // 2) for i in range(60)]
    nodes = {"C": spark.createDataFrame([(i, x) for i, _, x in where], "id long, x long"), "N": spark.createDataFrame([(0,), (1,), (2,)], "id long")}
    edges = spark.createDataFrame([("IN", "C", i, "N", g, str(i)) for i, g, _ in where if g is not None], "kind string, src_label string, src long, dst_label string, dst long, uid string")
    for op, f in (("<", int.__lt__), ("<=", int.__le__), (">", int.__gt__), (">=", int.__ge__)):
        found = cypher(f"MATCH (a:C)-[:IN]->(n:N), (b:C)-[:IN]->(n) WHERE a.x {op} b.x RETURN count(*) AS pairs", nodes, edges, written)
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and found.columns == ["pairs"]
        assert found.first()[0] == sum(f(x, y) for _, g, x in where for _, h, y in where if g is not None and g == h)


def test_sample_puts_nulls_last(spark):
    from loomgraph.operators import graph

    edges = spark.createDataFrame([("K", "A", k, "B", k, u) for k, u in ((1, None), (2, "b"), (3, "a"))], "kind string, src_label string, src long, dst_label string, dst long, uid string")
    nodes = spark.createDataFrame([("A", None), ("A", 7)], "label string, node long")
    assert {tuple(r) for r in graph.sample(edges, nodes, 1, 1).collect()} == {("A", 7), ("A", 3), ("B", 3)}


def test_rounds_of_communities_broadcast_nothing(spark):
    from loomgraph.operators import links
    from loomgraph.sources.shared import written

    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    pages = spark.createDataFrame([(i,) for i in range(6)], "slug long")
    found = links.communities(spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (2, 3)], "source long, target long"), pages, seen)
    assert {tuple(r) for r in found.collect()} == {(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 3)}
    assert plans and not any("Broadcast" in p for p in plans)


def test_ranges_grow_in_number_with_the_input(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from loomgraph.operators import ordering
    from loomgraph.sources.shared import written

    spark.range(300000).select(F.xxhash64("id").alias("k")).coalesce(1).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    asked = []
    monkeypatch.setattr(ordering, "tasks", lambda df, mb: asked.append(df) or 13, raising=True)
    out = ordering.numbered(df, [F.col("k")], "n", written)
    assert asked and out.agg(F.countDistinct("n"), F.max("n")).first() == (300000, 299999)


def test_validation_reads_tasks_only(against):
    orders = [(i, i % 4, "F", 1.0, datetime(2024, 1, 1 + i % 9), "1-URGENT") for i in range(60)]
    got, want = against("t11_validate", {"orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string", orders)})
    assert got == want and got


def test_few_failures_do_not_move_the_many(spark, monkeypatch):
    from loomgraph.operators import records
    from loomgraph.sources.shared import written

    tasks = spark.createDataFrame([(i, "completed", i % 7 != 0) for i in range(30)], "id long, status string, own boolean")
    deps = spark.createDataFrame([(i, i - 1) for i in range(1, 30) if i % 5], "id long, needs long")
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    few = sorted(map(tuple, records.gates(tasks, deps, seen).collect()))
    assert any("BroadcastHashJoin" in p and "LeftSemi" in p and "LeftAnti" in p for p in plans)
    monkeypatch.setattr(records, "_FEW", -1)
    assert few == sorted(map(tuple, records.gates(tasks, deps, written).collect()))


def _hops(links, pages, depth):
    near = {}
    for a, b in links:
        if None not in (a, b) and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    rows = set()
    for start in pages:
        seen, front = {start}, {start}
        for k in range(1, depth + 1):
            front = {y for x in front & pages for y in near.get(x, ())} - seen
            seen |= front
            rows |= {(start, y, k) for y in front}
    return rows


def test_hops_of_twins_are_made_at_the_end(spark, monkeypatch):
    import random

    from loomgraph.operators import links as D
    from loomgraph.sources.shared import written

    monkeypatch.setattr(D, "_LIST", 2, raising=False)
    r, moved = random.Random(5), []

    def seen(df):
        out = written(df)
        moved.append(out.count())
        return out

    twins = [(i, t) for i in range(100, 160) for t in (1, 2)] + [(1, 3), (3, 3), (2, 900), (900, 4), (4, None)]  # a hub's twins, self links, dangling pages
    chance = [(r.randrange(30), r.randrange(36)) for _ in range(40)]
    for edges, pages, starts in ((twins, {*range(1, 5), *range(100, 150)}, None), (twins, {*range(1, 5), *range(100, 150)}, {100, 3, 155}), (chance, set(range(30)), None)):
        of = lambda x: spark.createDataFrame([(p,) for p in [*x, *list(x)[:2]]], "slug long")
        moved.clear()
        got = [tuple(x) for x in D.khop(spark.createDataFrame(edges, "source long, target long"), of(pages), of(starts or pages), 3, seen).collect()]
        assert len(got) == len(set(got)) and set(got) == {x for x in _hops(edges, pages, 3) if not starts or x[0] in starts}
        if edges is twins and not starts:
            assert max(moved) <= len(twins) * 2 < 2000 < len(got)


def test_nodes_of_equal_hashes_are_no_twins(spark, monkeypatch):
    from pyspark.sql import functions as F

    from loomgraph.operators import links as D
    from loomgraph.sources.shared import written

    monkeypatch.setattr(D.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    edges, pages = [(i, 10 + i % 2) for i in range(6)], {*range(6), 10, 11}
    got = D.khop(spark.createDataFrame(edges, "source long, target long"), *[spark.createDataFrame([(p,) for p in pages], "slug long")] * 2, 3, written)
    assert {tuple(x) for x in got.collect()} == _hops(edges, pages, 3)


def test_reconciling_writes_what_it_read_and_what_is_new(spark, tmp_path, monkeypatch):
    from loomgraph.streaming import buckets, reconcile
    from loomgraph.sources.shared import written

    moved = []

    def seen(df):
        out = written(df)
        moved.append(out.count())
        return out

    for m in (buckets, reconcile):
        monkeypatch.setattr(m, "written", seen)
    corpus = buckets.Buckets(spark, f"file://{tmp_path}/c", "origin", "revision", f"{reconcile.HEAD}, body string", buckets=2)
    files = lambda rows: spark.createDataFrame(rows, "origin string, digest string, recipe string, body string")
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "origin string")
    heads = lambda: {r["origin"]: (r["source"], r["state"], r["revision"], r["digest"], r["body"]) for r in corpus.read().collect()}
    rows = [(f"f{i}", f"d{i}", "r", f"b{i}") for i in range(9)]
    reconcile.reconcile(corpus, "s", files(rows), full=True)
    assert moved == [9, 9]
    reconcile.reconcile(corpus, "t", files([("t0", "d", "r", "b")]))
    # One new, one changed, absent ones of either source (with one twice, one null, one unknown): three rows are written.
    moved.clear()
    got = reconcile.reconcile(corpus, "s", files([("f9", "d9", "r", "b9"), ("f0", None, "r", None), rows[1]]), names("f1", "f2", "f2", "t0", None, "zz"))
    assert (got["added"], got["changed"], got["removed"]) == (1, 1, 1) and moved == [6, 3]
    was = heads()
    assert was["f0"] == ("s", "Active", 2, None, None) and was["f2"] == ("s", "Removed", 2, None, None) and was["t0"] == ("t", "Active", 1, "d", "b") and len(was) == 11
    # Who names an origin of another source changes nothing, not even its own.
    with pytest.raises(ValueError, match="another source"):
        reconcile.reconcile(corpus, "t", files([("t1", "d", "r", "b"), ("f2", "d", "r", "b")]))
    assert heads() == was
    # A full batch removes all that it doesn't hold, be it named as absent or not; what was removed comes again.
    got = reconcile.reconcile(corpus, "s", files([rows[2], rows[3]]), names("f3", "f4"), full=True)
    assert (got["added"], got["changed"], got["removed"]) == (1, 0, 8)
    assert {o: x[1:3] for o, x in heads().items() if x[1] == "Active"} == {"f2": ("Active", 3), "f3": ("Active", 1), "t0": ("Active", 1)}
