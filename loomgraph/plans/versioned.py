"""Joins and set operations between snapshots, versions, streams and extras."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import versions as V
from loomgraph.plans.registry import query
from loomgraph.sources.shared import shared_path as shared
from loomgraph.sources.tables import table
from loomgraph.streaming import publish
from loomgraph.streaming.buckets import Buckets
from loomgraph.streaming.reconcile import HEAD, reconcile


def before(s, d):
    return table(s, d, "part").where("p_partkey % 7 <> 0").select("p_partkey", "p_brand", "p_size")


def after(s, d):
    p = table(s, d, "part").where("p_partkey % 5 <> 0")
    return p.select("p_partkey", "p_brand", (F.col("p_size") + F.when(F.col("p_partkey") % 3 == 0, 1).otherwise(0)).alias("p_size"))


SNAP = "a AS (SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey % 7 <> 0), b AS (SELECT p_partkey, p_brand, CAST(p_size + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS INT) AS p_size FROM part WHERE p_partkey % 5 <> 0)"
UPSERTED = f"WITH {SNAP} SELECT * FROM a WHERE p_partkey NOT IN (SELECT p_partkey FROM b) UNION ALL SELECT * FROM b"


@query("u3_d17_diff", f"WITH {SNAP} SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'removed' ELSE 'updated' END AS change FROM a FULL JOIN b USING (p_partkey) WHERE a.p_size IS DISTINCT FROM b.p_size")
def _(s, d):
    return V.diff(before(s, d), after(s, d), "p_partkey", F.col("p_size"))


@query("j15_d20_upsert", UPSERTED)
def _(s, d):
    return V.upsert(before(s, d), after(s, d), ["p_partkey"])


@query("d20_reconciliation", """SELECT CAST(p_partkey AS VARCHAR) AS origin, CASE WHEN p_partkey % 11 = 0 AND p_partkey % 3 <> 0 THEN 'Removed' ELSE 'Active' END AS state,
CAST(CASE WHEN p_partkey % 3 = 0 OR p_partkey % 11 = 0 THEN 2 ELSE 1 END AS BIGINT) AS revision, CASE WHEN p_partkey % 3 = 0 THEN p_name || '!' WHEN p_partkey % 11 <> 0 THEN p_name END AS name FROM part""")
def _(s, d):
    """A full batch, a delta of the third that changed and of absent ones (of which those that are there stay), and the same delta again, which writes nothing."""
    corpus = Buckets(s, shared(s, "corpus"), "origin", "revision", f"{HEAD}, name string")
    part = table(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_partkey").cast("string").alias("origin"), F.lit("1").alias("recipe"), F.col("p_name").alias("name"))
    files = lambda df: df.withColumn("digest", F.sha2("name", 256))
    reconcile(corpus, "parts", files(part), full=True)
    delta, absent = files(part.where("k % 3 = 0").withColumn("name", F.concat("name", F.lit("!")))), part.where("k % 11 = 0").select("origin")
    reconcile(corpus, "parts", delta, absent)
    if reconcile(corpus, "parts", delta, absent)["buckets"]:
        raise ValueError("an unchanged delta was written")
    return corpus.read().select("origin", "state", "revision", "name")


@query("x8_k5_replace_paths", f"WITH {SNAP} SELECT * FROM a WHERE p_brand NOT IN ('Brand#11', 'Brand#12') UNION ALL SELECT * FROM b WHERE p_brand = 'Brand#11'")
def _(s, d):
    paths = s.createDataFrame([("Brand#11",), ("Brand#12",)], "p_brand string")
    return V.replace_paths(before(s, d), after(s, d).where("p_brand = 'Brand#11'"), paths, "p_brand").select("p_partkey", "p_brand", "p_size")


@query("j14_m5_three_way", f"""WITH {SNAP}, t AS (SELECT p_partkey, p_brand, CAST(p_size + CASE WHEN p_partkey % 6 = 0 THEN 2 WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS INT) AS p_size FROM a),
j AS (SELECT coalesce(a.p_partkey, b.p_partkey, t.p_partkey) AS p_partkey, a.p_size AS x, b.p_size AS o, t.p_size AS y FROM a FULL JOIN b ON a.p_partkey = b.p_partkey FULL JOIN t ON t.p_partkey = coalesce(a.p_partkey, b.p_partkey)),
k AS (SELECT *, CASE WHEN o IS NOT DISTINCT FROM y THEN 'same' WHEN o IS NOT DISTINCT FROM x THEN 'theirs' WHEN y IS NOT DISTINCT FROM x THEN 'ours' ELSE 'conflict' END AS state FROM j)
SELECT p_partkey, CASE state WHEN 'conflict' THEN NULL WHEN 'theirs' THEN y ELSE o END AS p_size, state FROM k""")
def _(s, d):
    a = before(s, d)
    theirs = a.withColumn("p_size", F.col("p_size") + F.when(F.col("p_partkey") % 6 == 0, 2).when(F.col("p_partkey") % 4 == 0, 1).otherwise(0))
    return V.three_way(a, after(s, d), theirs, "p_partkey", "p_size")


@query("x1_x6_versions", f"{UPSERTED} ")
def _(s, d):
    store = V.Store(s, shared(s, "store"))
    v1 = store.commit(before(s, d), 0)
    store.tag("git-1")
    store.branch("side")
    v2 = store.commit(V.upsert(store.read(), after(s, d), ["p_partkey"]), v1)
    store.restore(v1)
    return store.read(version=v2)


@query("x3_x4_tag_and_branch", f"WITH {SNAP} SELECT * FROM a UNION ALL SELECT * FROM b WHERE p_partkey % 7 = 0")
def _(s, d):
    store = V.Store(s, shared(s, "store"))
    v = store.commit(before(s, d), 0)
    store.tag("git-1")
    store.branch("side")
    store.append(after(s, d).where("p_partkey % 7 = 0"), v, "side")
    return store.read("side")


@query("x5_restore", f"WITH {SNAP} SELECT * FROM a")
def _(s, d):
    store = V.Store(s, shared(s, "store"))
    v = store.commit(before(s, d), 0)
    store.commit(after(s, d), v)
    store.restore(v)
    return store.read()


@query("x9_delete", f"WITH {SNAP} SELECT * FROM a WHERE NOT p_size > 25")
def _(s, d):
    store = V.Store(s, shared(s, "store"))
    v = store.commit(before(s, d), 0)
    store.commit(store.read().where("not p_size > 25"), v)
    return store.read()


@query("x10_columns", f"WITH {SNAP} SELECT p_partkey, p_size, CAST(NULL AS VARCHAR) AS note FROM a")
def _(s, d):
    store = V.Store(s, shared(s, "store"))
    v = store.commit(before(s, d), 0)
    store.commit(store.read().drop("p_brand").withColumn("note", F.lit(None).cast("string")), v)
    return store.read()


@query("x7_recovery", "SELECT * FROM (VALUES ('t1', 'Applied'), ('t2', 'Conflicted'), ('t3', 'Unresolved')) v(txn, outcome)")
def _(s, d):
    store = V.Store(s, shared(s, "store"))
    store.commit(before(s, d), 0, txn="t1")
    try:
        store.commit(after(s, d), 0, txn="t2")
    except V.Conflict:
        pass
    return s.createDataFrame([(t, store.resolve(t)) for t in ("t1", "t2", "t3")], "txn string, outcome string")


@query("x11_a13_compaction", f"WITH {SNAP} SELECT * FROM a")
def _(s, d):
    store = V.Store(s, shared(s, "store"))
    v = store.commit(before(s, d).where("p_partkey % 2 = 0"), 0)
    store.append(before(s, d).where("p_partkey % 2 = 1"), v)
    store.compact()
    return store.read()


@query("x12_j5_vector_retention", "SELECT e.vec_id, d.doc_id IS NOT NULL AND d.n_chars % 2 = 0 AS kept FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id")
def _(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "n_chars")
    return table(s, d, "embeddings").select("vec_id").join(docs, "vec_id", "left").select("vec_id", F.coalesce(F.col("n_chars") % 2 == 0, F.lit(False)).alias("kept"))


@query("j3_hits_join", "SELECT vec_id, source FROM embeddings JOIN documents ON doc_id = vec_id WHERE length(lang) = 2 AND label % 2 = n_chars % 2")
def _(s, d):
    return table(s, d, "embeddings").join(table(s, d, "documents"), F.col("vec_id") == F.col("doc_id")).where("length(lang) = 2 and label % 2 = n_chars % 2").select("vec_id", "source")


@query("j4_right_orphans", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 10 <> 0)")
def _(s, d):
    return table(s, d, "labels").select("doc_id").join(table(s, d, "documents").where("doc_id % 10 <> 0"), "doc_id", "left_anti")


@query("j6_reusable", "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE n_chars % 3 = quality")
def _(s, d):
    return table(s, d, "documents").join(table(s, d, "labels"), "doc_id").where("n_chars % 3 = quality").select("doc_id")


@query("j7_ordered_rejoin", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank, c_name FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10) JOIN customer ON c_custkey = o_custkey")
def _(s, d):
    from loomgraph.operators.retrieval import ranked

    top = ranked(table(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10), "o_orderkey", F.desc("o_totalprice"))
    return top.join(table(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", F.col("rank").cast("long"), "c_name")


@query("j8_computed_key", "SELECT e.event_id, c.turn FROM events e JOIN conversations c ON 'c/' || c.conv_id || '/' || c.turn = 'c/' || e.user_id || '/' || (e.event_id % 4)")
def _(s, d):
    e = table(s, d, "events").select("event_id", F.concat_ws("/", F.lit("c"), F.col("user_id").cast("string"), (F.col("event_id") % 4).cast("string")).alias("k"))
    c = table(s, d, "conversations").select("turn", F.concat_ws("/", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("k"))
    return e.join(c, "k").select("event_id", "turn")


@query("j9_referential", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3)")
def _(s, d):
    return table(s, d, "orders").join(table(s, d, "customer").where("c_nationkey <> 3").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti").select("o_orderkey")


@query("j12_drift", "SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'unobserved' WHEN quality = 1 THEN 'equal' ELSE 'changed' END AS state FROM documents d LEFT JOIN labels l USING (doc_id)".replace("SELECT doc_id, CASE WHEN l.doc_id", "SELECT d.doc_id, CASE WHEN l.doc_id"))
def _(s, d):
    return table(s, d, "documents").select("doc_id").join(table(s, d, "labels"), "doc_id", "left").select("doc_id", F.when(F.col("quality").isNull(), "unobserved").when(F.col("quality") == 1, "equal").otherwise("changed").alias("state"))


@query("j16_coverage", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def _(s, d):
    return table(s, d, "documents").select("doc_id").join(table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("u2_union_distinct", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def _(s, d):
    return table(s, d, "orders").select(F.col("o_custkey").alias("k")).union(table(s, d, "customer").select("c_custkey")).distinct()


@query("u4_uncovered", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)")
def _(s, d):
    return table(s, d, "lineitem").select("l_partkey").distinct().join(table(s, d, "part").where("p_size < 40").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_anti")


@query("u5_intersection", "SELECT doc_id FROM documents INTERSECT SELECT vec_id FROM embeddings")
def _(s, d):
    return table(s, d, "documents").select("doc_id").intersect(table(s, d, "embeddings").select("vec_id"))


@query("u6_mixed_types", "SELECT CAST(p_partkey AS VARCHAR) AS v FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT CAST(p_size AS VARCHAR) FROM part")
def _(s, d):
    p = table(s, d, "part")
    return p.select(F.col("p_partkey").cast("string").alias("v")).union(p.select("p_brand")).union(p.select(F.col("p_size").cast("string")))


def stream(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    path = shared(s, "feed")
    for k in range(3):  # one file set to a micro-batch
        e.where(F.col("event_id") % 3 == k).select("event_id", "user_id", "event_type", "ts").write.mode("append").parquet(f"{path}/b={k}")
    return s.readStream.schema("event_id long, user_id long, event_type string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{path}/b=*")


@query("st1_st4_stream_upsert", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY ALL")
def _(s, d):
    arriving = stream(s, d)
    state = Buckets(s, shared(s, "state"), "user_id", "event_id", arriving.schema)
    publish.run(arriving, state, shared(s, "ckpt"))
    return state.read().select("user_id", "event_id")


@query("st2_embedding_stream", "SELECT vec_id, label FROM embeddings JOIN documents ON doc_id = vec_id WHERE n_chars % 3 = label % 3")
def _(s, d):
    """Embeddings arrive with the fingerprint of the text they were made of; those of texts that have changed since are refused."""
    path = shared(s, "feed")
    made = table(s, d, "embeddings").select("vec_id", "label", (F.col("label") % 3).cast("long").alias("fingerprint"), F.lit(1).alias("revision"))
    for k in range(2):
        made.where(F.col("vec_id") % 2 == k).write.parquet(f"{path}/b={k}")
    arriving = s.readStream.schema(made.schema).option("maxFilesPerTrigger", 8).parquet(f"{path}/b=*")
    now = table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), (F.col("n_chars") % 3).cast("long").alias("fingerprint"))
    state = Buckets(s, shared(s, "state"), "vec_id", "revision", made.schema)
    publish.run(arriving, state, shared(s, "ckpt"), current=(now, ["vec_id", "fingerprint"]))
    return state.read().select("vec_id", "label")


@query("g13_st3_file_deltas", f"WITH {SNAP} SELECT p_partkey, p_brand, p_size FROM a WHERE p_brand NOT IN ('Brand#11', 'Brand#12') UNION ALL SELECT * FROM b WHERE p_brand = 'Brand#11'")
def _(s, d):
    """Deltas of files (here brands) on a published graph: replaced, deleted, sent twice, and one that comes late."""
    first = before(s, d).withColumns({"path": F.col("p_brand"), "revision": F.lit(1)})
    state = Buckets(s, shared(s, "state"), "path", "revision", first.schema)
    state.replace(first, first.select("path", "revision"))
    new = after(s, d).where("p_brand = 'Brand#11'").withColumns({"path": F.col("p_brand"), "revision": F.lit(3)})
    state.replace(new, s.createDataFrame([("Brand#11", 3)], "path string, revision int"))
    state.replace(new, s.createDataFrame([("Brand#11", 3)], "path string, revision int"))
    state.replace(new.limit(0), s.createDataFrame([("Brand#11", 2), ("Brand#12", 2)], "path string, revision int"))
    return state.read().where("p_partkey is not null").select("p_partkey", "p_brand", "p_size")


@query("st6_lease_expiry", "SELECT user_id, max(ts) + INTERVAL 2 DAY > TIMESTAMP '2024-01-31' AS alive FROM events GROUP BY ALL")
def _(s, d):
    return table(s, d, "events").groupBy("user_id").agg((F.max("ts") + F.expr("interval 2 days") > F.lit("2024-01-31").cast("timestamp_ntz")).alias("alive"))


@query("st7_change_feed", "SELECT event_id FROM events WHERE event_id <= 900 AND event_id > 850 ORDER BY event_id LIMIT 20")
def _(s, d):
    return table(s, d, "events").where("event_id <= 900 and event_id > 850").orderBy("event_id").limit(20).select("event_id")


@query("extra_windows", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(s, d):
    return publish.windows(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))


@query("extra_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(s, d):
    return table(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("s17_k4_fact_rows", "SELECT p_partkey, p_brand AS brand FROM part")
def _(s, d):
    path = shared(s, "facts")
    table(s, d, "part").select("p_partkey", F.to_json(F.struct(F.col("p_brand").alias("brand"))).alias("payload")).write.parquet(path)
    return s.read.parquet(path).select("p_partkey", F.from_json("payload", "brand string").alias("j")).select("p_partkey", "j.brand")


@query("s18_source_lookup", "SELECT w.page_id, CASE WHEN p.page_id IS NULL THEN 'missing' ELSE 'hit' END AS outcome, url FROM (VALUES (3), (99999999)) w(page_id) LEFT JOIN pages p ON p.page_id = w.page_id")
def _(s, d):
    want = s.createDataFrame([(3,), (99999999,)], "page_id long")
    return want.join(table(s, d, "pages").select("page_id", "url"), "page_id", "left").select("page_id", F.when(F.col("url").isNull(), "missing").otherwise("hit").alias("outcome"), "url")


@query("k6_export_round_trip", "SELECT doc_id, lang, n_chars FROM documents")
def _(s, d):
    path = shared(s, "export")
    table(s, d, "documents").select("doc_id", "lang", "n_chars").write.json(path)
    return s.read.schema("doc_id long, lang string, n_chars long").json(path)


@query("k7_structured_output", """SELECT event_id, '{"event_type":"' || event_type || '","user_id":' || user_id || '}' AS line FROM events""")
def _(s, d):
    return table(s, d, "events").select("event_id", F.to_json(F.struct("event_type", "user_id")).alias("line"))


@query("k8_log_tail", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 25")
def _(s, d):
    return table(s, d, "events").orderBy(F.desc("event_id")).limit(25).select("event_id", "event_type")
