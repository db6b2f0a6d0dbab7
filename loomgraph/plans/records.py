"""Typed queries over records: orders as tasks, line items as their checks, the customer's previous order as prerequisite and a later one as parent; conversations as revisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import records as R
from loomgraph.plans.registry import query
from loomgraph.sources.shared import tasks as dealt
from loomgraph.sources.shared import written
from loomgraph.sources.tables import table

STATUS = "CASE WHEN o_orderkey % 13 = 5 THEN 'cancelled' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'in_progress' END"
TASKS = f"""tasks AS (SELECT 'T' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS record_id, o_custkey AS session_id, o_orderpriority AS title, {STATUS} AS status, CAST(left(o_orderpriority, 1) AS INT) AS priority, o_orderkey AS id,
epoch_ms(o_orderdate) AS created_at, epoch_ms(o_orderdate) + o_orderkey % 1000 AS updated_at, o_orderkey % 17 = 0 AS flagged,
CASE WHEN o_orderkey % 4 = 1 THEN lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) END AS parent FROM orders)"""


def tasks(s, d):
    status = F.when(F.col("o_orderkey") % 13 == 5, "cancelled").when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "open").otherwise("in_progress")
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return table(s, d, "orders").select(F.concat(F.lit("T"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("record_id"), F.col("o_custkey").alias("session_id"), F.col("o_orderpriority").alias("title"), status.alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_orderkey").alias("id"), ms.alias("created_at"), (ms + F.col("o_orderkey") % 1000).alias("updated_at"), (F.col("o_orderkey") % 17 == 0).alias("flagged"))


@query("p1_projection", f"WITH {TASKS} SELECT record_id, status, priority FROM tasks")
def _(s, d):
    return R.project(tasks(s, d), ["record_id", "status", "priority"])


@query("p2_typed_predicate", f"WITH {TASKS} SELECT record_id FROM tasks WHERE status IN ('open', 'in_progress') AND session_id IN (1, 2, 3, 4, 5)")
def _(s, d):
    return tasks(s, d).where(F.col("status").isin("open", "in_progress") & F.col("session_id").isin(1, 2, 3, 4, 5)).select("record_id")


@query("p3_catalogue_filter", f"WITH {TASKS} SELECT record_id FROM tasks WHERE contains(lower(title), 'urg') AND flagged AND status = 'open'")
def _(s, d):
    return tasks(s, d).where(F.lower("title").contains("urg") & F.col("flagged") & (F.col("status") == "open")).select("record_id")


@query("p5_memory_filter", "SELECT event_id FROM events WHERE event_type = 'view' AND user_id % 2 = 0 AND NOT value > 50")
def _(s, d):
    e = table(s, d, "events").withColumn("tags", F.array("event_type"))
    return e.where(F.array_contains("tags", "view") & (F.col("user_id") % 2 == 0) & ~(F.col("value") > 50)).select("event_id")


@query("p6_live_heads", "SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id HAVING max(turn) % 5 <> 4")
def _(s, d):
    return table(s, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn")).where("turn % 5 <> 4")


@query("p7_active_leases", f"WITH {TASKS} SELECT record_id FROM tasks WHERE status = 'in_progress' AND session_id % 3 = 0 AND updated_at + 86400000 > 800000000000")
def _(s, d):
    return tasks(s, d).where("status = 'in_progress' and session_id % 3 = 0 and updated_at + 86400000 > 800000000000").select("record_id")


@query("p8_vector_eligible", "SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL AND label = 4")
def _(s, d):
    return table(s, d, "embeddings").where("embedding is not null and label = 4").select("vec_id")


@query("p9_identities", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey = 1 AND l_linenumber = 1) OR (l_orderkey = 2 AND l_linenumber = 1) OR (l_orderkey = 3 AND l_linenumber = 2)")
def _(s, d):
    ids = s.createDataFrame([(1, 1), (2, 1), (3, 2)], "l_orderkey long, l_linenumber int")
    return table(s, d, "lineitem").join(F.broadcast(ids), ["l_orderkey", "l_linenumber"], "left_semi").select("l_orderkey", "l_linenumber")


@query("p10_observed", "SELECT event_id FROM events WHERE coalesce(value > 90, false) = false")
def _(s, d):
    return table(s, d, "events").where(~F.coalesce(F.col("value") > 90, F.lit(False))).select("event_id")


@query("p13_exact_entity", "SELECT CASE WHEN count(*) = 1 THEN 'exact' WHEN count(*) = 0 THEN 'missing' ELSE 'ambiguous' END AS outcome FROM (SELECT 1 FROM part WHERE p_brand = 'Brand#11' LIMIT 2)")
def _(s, d):
    two = table(s, d, "part").where("p_brand = 'Brand#11'").limit(2)
    return two.agg(F.when(F.count(F.lit(1)) == 1, "exact").when(F.count(F.lit(1)) == 0, "missing").otherwise("ambiguous").alias("outcome"))


@query("p14_schema", "SELECT 'part' AS \"table\", column_name AS \"column\", column_type AS type FROM (DESCRIBE part)")
def _(s, d):
    names = {"bigint": "BIGINT", "string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE"}
    return s.createDataFrame([("part", f.name, names[f.dataType.simpleString()]) for f in table(s, d, "part").schema], "`table` string, `column` string, type string")


@query("a1_session_rollup", f"WITH {TASKS} SELECT session_id, count(*) FILTER (status <> 'cancelled') AS total, count(*) FILTER (status = 'completed') AS completed FROM tasks GROUP BY ALL")
def _(s, d):
    return tasks(s, d).groupBy("session_id").agg(F.count_if(F.col("status") != "cancelled").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"))


@query("a4_language_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY ALL")
def _(s, d):
    return table(s, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


CLASS = "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END"


@query("a5_m3_attribute_merge", f"SELECT user_id, bool_or(value > 90) AS mandatory, bool_or(value < 5) AS important, max({CLASS}) AS class FROM events GROUP BY ALL")
def _(s, d):
    order = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "purchase", 3).otherwise(4)
    return table(s, d, "events").groupBy("user_id").agg(F.bool_or(F.col("value") > 90).alias("mandatory"), F.bool_or(F.col("value") < 5).alias("important"), F.max(order).alias("class"))


@query("a6_best_score", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def _(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.max(F.struct("value", (-F.col("event_id")).alias("less"))).alias("m")).select("user_id", (-F.col("m.less")).alias("event_id"))


@query("a8_grouped", "SELECT conv_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT role) AS roles FROM conversations GROUP BY ALL")
def _(s, d):
    return table(s, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.countDistinct("role").alias("roles"))


@query("a14_count_where", "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'A'")
def _(s, d):
    return table(s, d, "lineitem").where("l_returnflag = 'A'").agg(F.count(F.lit(1)).alias("n"))


@query("a16_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("a17_duplicates", "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("w2_m2_revision_chain", "SELECT conv_id, turn, lag(role) OVER w AS before, role AS after, coalesce(lag(turn) OVER w, -1) + 1 = turn AND NOT coalesce(lag(role = 'tool') OVER w, false) AS sound FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def _(s, d):
    return R.chain(table(s, d, "conversations"), "conv_id", "turn", "role", F.col("role") == "tool")


@query("w3_transitions", f"WITH {TASKS} SELECT record_id, coalesce(updated_at >= lag(updated_at) OVER (PARTITION BY session_id ORDER BY created_at, record_id), true) AS monotone FROM tasks")
def _(s, d):
    w = Window.partitionBy("session_id").orderBy("created_at", "record_id")
    return tasks(s, d).select("record_id", F.coalesce(F.col("updated_at") >= F.lag("updated_at").over(w), F.lit(True)).alias("monotone"))


@query("w4_sequence", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) = turn + 1 AS contiguous FROM conversations")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) == F.col("turn") + 1).alias("contiguous"))


@query("w7_n1_now", f"WITH {TASKS} SELECT status AS section, record_id, total, place, total > 20 AS has_more FROM (SELECT *, count(*) OVER (PARTITION BY status) AS total, row_number() OVER (PARTITION BY status ORDER BY updated_at DESC, record_id) AS place FROM tasks) WHERE place <= 20")
def _(s, d):
    return R.top_per_section(tasks(s, d), "status", [F.desc("updated_at"), F.col("record_id")]).select(F.col("status").alias("section"), "record_id", "total", F.col("place").cast("long"), "has_more")


@query("t2_t16_catalogue_page", f"WITH {TASKS} SELECT record_id, title, status FROM tasks WHERE status = 'open' ORDER BY created_at DESC, record_id LIMIT 20")
def _(s, d):
    return R.late(tasks(s, d).where("status = 'open'"), "record_id", [F.desc("created_at"), F.col("record_id")], 20, ["created_at"]).select("record_id", "title", "status")


@query("t3_first_page", f"WITH {TASKS} SELECT record_id, status FROM tasks ORDER BY record_id NULLS LAST LIMIT 20")
def _(s, d):
    return R.keyset(tasks(s, d), "record_id").select("record_id", "status")


@query("t4_keyset", f"WITH {TASKS} SELECT record_id, status FROM tasks WHERE record_id > 'T0000000100' ORDER BY record_id LIMIT 10")
def _(s, d):
    q = {"table": "tasks"}
    return R.keyset(tasks(s, d), "record_id", R.after(q, "g1", R.cursor(q, "g1", "T0000000100")), 20, 50, 40).select("record_id", "status")


@query("t5_t6_offset_page", f"WITH {TASKS} SELECT record_id, place FROM (SELECT record_id, row_number() OVER (ORDER BY priority DESC, record_id) AS place FROM tasks) WHERE place BETWEEN 41 AND 60")
def _(s, d):
    return R.offset_page(tasks(s, d), [F.desc("priority"), F.col("record_id")], 40).select("record_id", F.col("place").cast("long"))


@query("t7_m1_category_order", "SELECT event_id, row_number() OVER (ORDER BY CASE WHEN value > 90 THEN 0 WHEN value < 5 THEN 1 ELSE 2 END, ts DESC, event_id) AS place FROM events ORDER BY place LIMIT 50")
def _(s, d):
    order = [F.when(F.col("value") > 90, 0).when(F.col("value") < 5, 1).otherwise(2), F.desc("ts"), F.col("event_id")]
    return R.offset_page(table(s, d, "events"), order, 0, 50).select("event_id", F.col("place").cast("long"))


@query("t8_rerank_order", "SELECT event_id FROM events ORDER BY value DESC, event_id LIMIT 10")
def _(s, d):
    return table(s, d, "events").orderBy(F.desc("value"), "event_id").limit(10).select("event_id")


@query("t9_d17_history_page", "SELECT conv_id, turn FROM conversations WHERE turn <= 4 AND turn < 3 ORDER BY turn DESC, conv_id LIMIT 20")
def _(s, d):
    return table(s, d, "conversations").where("turn <= 4 and turn < 3").orderBy(F.desc("turn"), "conv_id").limit(20).select("conv_id", "turn")


@query("t10_unlimited", f"WITH {TASKS} SELECT record_id FROM tasks WHERE status = 'open'")
def _(s, d):
    top_k = 0
    df = tasks(s, d).where("status = 'open'").select("record_id")
    return df.limit(top_k) if top_k else df


OWN = """own AS (SELECT l_orderkey AS id, bool_or(l_linenumber % 2 = 1) AND bool_or(l_linenumber % 2 = 0) AND bool_and(l_quantity > 2) AS ok FROM lineitem WHERE l_returnflag <> 'N' OR l_linestatus <> 'F' GROUP BY ALL)"""


def checked(s, d):
    """Each task with an array of checks made of its line items."""
    li = table(s, d, "lineitem")
    status = F.when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"), "superseded").when(F.col("l_quantity") > 2, "passed").otherwise("pending")
    c = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(F.when(F.col("l_linenumber") % 2 == 1, "acceptance").otherwise("test").alias("kind"), status.alias("status"), F.lit("seen").alias("evidence"))).alias("checks"))
    t = tasks(s, d).join(c, "id", "left")
    return t.withColumn("own", F.coalesce(R.checks_pass(F.col("checks"), F.col("flagged")), F.lit(False)))


CHECKED = f"{TASKS}, {OWN}, checked AS (SELECT t.*, NOT flagged AND coalesce(ok, false) AS own FROM tasks t LEFT JOIN own USING (id))"


@query("t12_checks_pass", f"WITH {CHECKED} SELECT id, own FROM checked")
def _(s, d):
    return checked(s, d).select("id", "own")


def _sessions(s, d):
    """Tasks dealt out by session, in tasks of a fixed share of the input."""
    t = tasks(s, d)
    return t.repartition(dealt(t, 4), "session_id"), Window.partitionBy("session_id").orderBy("created_at", "id")


def deps(s, d):
    """Each order needs the one before it of the same customer."""
    t, w = _sessions(s, d)
    return t.withColumn("needs", F.lag("id").over(w)).where("needs is not null").select("id", "needs")


def parents(s, d):
    """Every fourth order with the second after it as parent."""
    t, w = _sessions(s, d)
    return t.select("id", F.col("session_id").alias("session"), F.when(F.col("id") % 4 == 1, F.lead("id", 2).over(w)).alias("parent"))


def facts(s, d):
    """Checked tasks with their parents; all edges lead upwards in rank."""
    return checked(s, d).join(parents(s, d), "id").withColumn("rank", F.struct("created_at", "id"))


def gated(s, d):
    """The gates of all tasks, joined with them."""
    t = written(facts(s, d).select("id", "status", "own", "parent", "session", "rank", "title", "flagged"))
    return R.gates(t, deps(s, d), written, "rank"), t


DEPS = "deps AS (SELECT id, needs FROM (SELECT id, lag(id) OVER (PARTITION BY session_id ORDER BY created_at, id) AS needs FROM tasks) WHERE needs IS NOT NULL)"
GATES = f"""WITH RECURSIVE {CHECKED}, {DEPS},
need AS (SELECT d.id, d.needs, n.status AS ns, t.status AS ts FROM deps d JOIN checked t ON t.id = d.id JOIN checked n ON n.id = d.needs WHERE t.status <> 'cancelled'),
base AS (SELECT id, status, NOT own OR id IN (SELECT id FROM need WHERE ns = 'cancelled') AS bad FROM checked),
ev AS (SELECT id, unnest(CASE WHEN bad THEN ['bad', 'invalid'] WHEN status <> 'completed' THEN ['invalid'] ELSE [] END || CASE WHEN (bad OR status <> 'completed') AND status <> 'cancelled' THEN ['unmet'] ELSE [] END) AS kind FROM base
UNION SELECT id, unnest(kinds) AS kind FROM (
SELECT n.id, CASE WHEN ts = 'completed' THEN ['bad', 'invalid', 'unmet'] ELSE ['bad'] END AS kinds FROM ev JOIN need n ON ev.kind = 'invalid' AND n.needs = ev.id
UNION ALL SELECT p.id, CASE p.status WHEN 'completed' THEN ['bad', 'invalid', 'unmet'] WHEN 'cancelled' THEN ['bad', 'unmet'] ELSE ['bad'] END FROM ev JOIN checked c ON ev.kind = 'unmet' AND c.id = ev.id JOIN checked p ON p.id = c.parent)),
failed AS (SELECT id, bool_or(kind = 'bad') AS bad, bool_or(kind = 'invalid') AS invalid FROM ev GROUP BY id),
gates AS (SELECT c.id, c.status <> 'cancelled' AND NOT coalesce(f.bad, false) AS completion, c.status = 'open' AND c.id NOT IN (SELECT n.id FROM need n JOIN failed x ON x.id = n.needs AND x.invalid) AS ready,
NOT coalesce(f.invalid, false) AS valid, c.session_id, c.status, c.title, c.flagged FROM checked c LEFT JOIN failed f ON f.id = c.id)"""


@query("t11_t13_t14_a9_gates", f"{GATES} SELECT id, completion, ready, valid FROM gates")
def _(s, d):
    return gated(s, d)[0]


@query("t15_session_closable", f"{GATES} SELECT session_id AS session, bool_and(status = 'cancelled' OR valid) AS closable FROM gates GROUP BY ALL")
def _(s, d):
    return R.closable(*gated(s, d))


@query("t11_validate", f"WITH {TASKS}, {DEPS} SELECT id, 'unknown dependency' AS problem FROM deps WHERE needs % 5 = 0 UNION ALL SELECT id, 'unknown parent' FROM tasks WHERE id % 5 <> 0 AND parent % 5 = 0")
def _(s, d):
    return R.validate(written(parents(s, d).where("id % 5 <> 0")), written(deps(s, d)))  # both are read several times


@query("t17_read_view", f"{GATES} SELECT id, ready, completion, count(*) OVER (PARTITION BY session_id) AS in_session FROM gates")
def _(s, d):
    g, t = gated(s, d)
    size = t.groupBy("session").agg(F.count(F.lit(1)).alias("in_session"))
    return g.join(t.select("id", "session"), "id").join(size, "session").select("id", "ready", "completion", "in_session")


@query("p4_search_filter", f"{GATES} SELECT id FROM gates WHERE ready AND NOT flagged AND contains(lower(title), 'urg')")
def _(s, d):
    g, t = gated(s, d)
    return g.where("ready").join(t.where(~F.col("flagged") & F.lower("title").contains("urg")), "id").select("id")


@query("p15_guards", "SELECT * FROM (VALUES ('nation', 'rejected'), ('region', 'admitted')) v(name, outcome)")
def _(s, d):
    def outcome(name):
        try:
            return "admitted" if R.guarded(table(s, d, name), 10).count() else "empty"
        except ValueError:
            return "rejected"

    return s.createDataFrame([(n, outcome(n)) for n in ("nation", "region")], "name string, outcome string")


@query("t18_history", "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3 ORDER BY turn LIMIT 20")
def _(s, d):
    return R.keyset(table(s, d, "conversations").where("conv_id = 3"), "turn").select("conv_id", "turn", "role")


@query("t19_session", f"WITH {TASKS} SELECT session_id, record_id FROM tasks WHERE session_id = 7 ORDER BY record_id LIMIT 20")
def _(s, d):
    return R.keyset(tasks(s, d).where("session_id = 7"), "record_id").select("session_id", "record_id")


@query("t20_activity", f"WITH {TASKS} SELECT session_id, status, count(*) AS n, max(updated_at) AS last FROM tasks GROUP BY ALL")
def _(s, d):
    return tasks(s, d).groupBy("session_id", "status").agg(F.count(F.lit(1)).alias("n"), F.max("updated_at").alias("last"))


@query("t21_schedule", "SELECT l_orderkey, l_linenumber, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) + 1 AS days FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate >= o_orderdate")
def _(s, d):
    j = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate >= o_orderdate")
    return j.select("l_orderkey", "l_linenumber", (F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")) + 1).cast("long").alias("days"))


@query("t22_t23_reset_checks", "SELECT l_orderkey AS id, count(*) FILTER (l_orderkey % 2 = 0 AND NOT (l_returnflag = 'N' AND l_linestatus = 'F')) AS reset FROM lineitem GROUP BY ALL")
def _(s, d):
    c = checked(s, d).where("checks is not null")
    done = F.when(F.col("id") % 2 == 0, F.transform("checks", lambda x: F.when(x["status"] == "superseded", x["status"]).otherwise("reset"))).otherwise(F.array().cast("array<string>"))
    return c.select("id", F.size(F.filter(done, lambda x: x == "reset")).cast("long").alias("reset"))


@query("t24_event_kinds", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def _(s, d):
    return table(s, d, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


HEADS = "heads AS (SELECT conv_id AS id, max(turn) AS revision, arg_max(role, turn) AS value, max(turn) % 5 = 4 AS tombstone FROM conversations GROUP BY ALL)"


@query("t25_m6_mutations", f"""WITH {HEADS}, ch AS (SELECT DISTINCT conv_id AS id, conv_id % 6 AS expected, 'update' AS kind, CASE WHEN conv_id % 4 = 0 THEN 'user' ELSE 'assistant' END AS value FROM conversations WHERE conv_id % 2 = 0 UNION ALL SELECT -1, 0, 'update', 'x'),
o AS (SELECT ch.id, revision, CASE WHEN revision IS NULL THEN 'unknown' WHEN tombstone THEN 'deleted' WHEN expected <> revision THEN 'conflict' WHEN ch.value = heads.value THEN 'no change' ELSE 'applied' END AS outcome FROM ch LEFT JOIN heads USING (id))
SELECT id, outcome, CASE WHEN outcome = 'applied' THEN revision + 1 ELSE revision END AS revision FROM o""")
def _(s, d):
    heads = table(s, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.max("turn").alias("revision"), F.max_by("role", "turn").alias("value"), (F.max("turn") % 5 == 4).alias("tombstone"))
    ch = heads.where("id % 2 = 0").select("id", (F.col("id") % 6).alias("expected"), F.lit("update").alias("kind"), F.when(F.col("id") % 4 == 0, "user").otherwise("assistant").alias("value"))
    return R.mutate(heads, ch.unionAll(s.createDataFrame([(-1, 0, "update", "x")], "id long, expected long, kind string, value string")))


@query("t26_calendar", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'interval' WHEN l_linenumber % 3 = 1 THEN 'marker' ELSE 'undated' END AS shape FROM lineitem")
def _(s, d):
    li = table(s, d, "lineitem").withColumn("a", F.when(F.col("l_linenumber") % 3 != 2, F.col("l_shipdate"))).withColumn("b", F.when(F.col("l_linenumber") % 3 == 0, F.col("l_shipdate")))
    return li.select("l_orderkey", "l_linenumber", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "interval").when(F.col("a").isNotNull() | F.col("b").isNotNull(), "marker").otherwise("undated").alias("shape"))


@query("m4_idempotent", "SELECT conv_id, min(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY ALL")
def _(s, d):
    return table(s, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min("turn").alias("turn"))


@query("a7_best_revision", "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn DESC) = 1")
def _(s, d):
    m = F.min(F.struct(F.length("text").alias("n"), (-F.col("turn")).alias("less")))
    return table(s, d, "conversations").groupBy("conv_id").agg(m.alias("m")).select("conv_id", (-F.col("m.less")).alias("turn"))


@query("fn_codecs", "SELECT doc_id, sha256(text) AS sha, rtrim(replace(replace(base64(encode(lang || '?>' || source)), '+', '-'), '/', '_'), '=') AS b64, hex(encode(lang)) AS hex FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), T.base64url(F.concat("lang", F.lit("?>"), "source").cast("binary")).alias("b64"), F.hex("lang").alias("hex"))


@query("fn_yaml_scalars", r"SELECT event_id, CASE WHEN v IN ('null', '', '~') THEN 'null' WHEN v IN ('true', 'false') THEN 'bool' WHEN v IN ('0x1F', '-.INF') OR regexp_full_match(v, '[-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?') THEN 'number' ELSE 'string' END AS kind FROM (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'null' WHEN 1 THEN 'true' WHEN 2 THEN CAST(event_id AS VARCHAR) || '.5e3' WHEN 3 THEN event_type WHEN 4 THEN '0x1F' WHEN 5 THEN '-.INF' WHEN 6 THEN '0o78' ELSE '' END AS v FROM events)")
def _(s, d):
    m = F.col("event_id") % 8
    v = F.when(m == 0, "null").when(m == 1, "true").when(m == 2, F.concat(F.col("event_id").cast("string"), F.lit(".5e3"))).when(m == 3, F.col("event_type")).when(m == 4, "0x1F").when(m == 5, "-.INF").when(m == 6, "0o78").otherwise("")
    return table(s, d, "events").select("event_id", T.yaml_kind(v).alias("kind"))


@query("fn_strict_dates", "SELECT event_id, try_cast(v AS DATE) AS day FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN '2024-02-30' ELSE 'soon' END AS v FROM events)")
def _(s, d):
    m = F.col("event_id") % 3
    v = F.when(m == 0, F.date_format("ts", "yyyy-MM-dd")).when(m == 1, "2024-02-30").otherwise("soon")
    return table(s, d, "events").select("event_id", T.strict_date(v).alias("day"))
