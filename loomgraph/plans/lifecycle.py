"""Lives of records: orders as memories, tasks and specifications, with a command for each of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import lifecycle as L
from loomgraph.plans.registry import query
from loomgraph.sources.tables import table

MEMORY = """m AS (SELECT o_orderkey AS id, o_custkey AS customer, o_orderkey % 4 + 1 AS revision, o_orderkey % 13 <> 5 AS alive, o_orderpriority AS title, o_orderkey % 11 = 0 AS mandatory,
o_orderkey % 3 = 0 AS important, CAST(left(o_orderpriority, 1) AS INT) AS class, [o_custkey] AS refs, o_orderkey % 7 AS generation, epoch_ms(o_orderdate) AS updated_at FROM orders)"""


def memories(s, d):
    k = F.col("o_orderkey")
    return table(s, d, "orders").select(
        k.alias("id"), (k % 4 + 1).alias("revision"), (k % 13 != 5).alias("alive"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("body"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("class"), (k % 11 == 0).alias("mandatory"), (k % 3 == 0).alias("important"),
        F.array("o_custkey").alias("refs"), (k % 7).alias("generation"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("updated_at"),
    )


@query("m6_lifecycle", f"""WITH {MEMORY}, ch AS (SELECT id, 1 AS seq, CASE id % 5 WHEN 0 THEN 'update' WHEN 1 THEN 'delete' WHEN 2 THEN 'automatic delete' WHEN 3 THEN 'promote' ELSE 'demote' END AS kind,
CASE WHEN id % 17 = 0 THEN 0 ELSE revision END AS expected, updated_at + CASE WHEN id % 19 = 0 THEN -1 ELSE 5 END AS clock, CASE WHEN id % 2 = 0 THEN '1-URGENT' END AS title, CASE WHEN id % 4 = 0 THEN [id] END AS refs FROM m
UNION ALL SELECT id, 2, 'update', revision, updated_at, 'second', NULL FROM m WHERE id % 3 = 1 UNION ALL SELECT -1, 1, 'update', 1, 1, 'x', NULL),
o AS (SELECT m.*, ch.id AS cid, seq, kind, ch.title AS t, ch.refs AS r, clock, CASE WHEN m.id IS NULL THEN 'unknown' WHEN expected <> revision THEN 'conflict' WHEN NOT alive THEN 'deleted'
WHEN kind = 'update' AND coalesce(ch.title, m.title) = m.title AND coalesce(ch.refs, m.refs) = m.refs THEN 'no change' WHEN kind = 'automatic delete' AND (important OR mandatory) THEN 'protected'
WHEN kind = 'promote' AND important OR kind = 'demote' AND NOT important THEN 'no change' WHEN clock < updated_at THEN 'backward clock' ELSE 'applied' END AS raw FROM ch LEFT JOIN m USING (id)),
f AS (SELECT *, CASE WHEN raw = 'applied' AND row_number() OVER (PARTITION BY cid, raw ORDER BY seq) > 1 THEN 'conflict' ELSE raw END AS outcome FROM o)
SELECT cid AS id, seq, outcome, CASE WHEN outcome = 'applied' THEN revision + 1 END AS revision, CASE WHEN outcome = 'applied' THEN CASE WHEN kind = 'update' THEN coalesce(t, title) ELSE title END END AS title,
CASE WHEN outcome = 'applied' THEN kind NOT IN ('delete', 'automatic delete') END AS alive, CASE WHEN outcome = 'applied' THEN CASE kind WHEN 'promote' THEN true WHEN 'demote' THEN false ELSE important END END AS important,
CASE WHEN outcome = 'applied' THEN generation + CASE WHEN kind IN ('delete', 'automatic delete') OR kind = 'update' AND r IS NOT NULL AND r <> refs THEN 1 ELSE 0 END END AS generation,
CASE WHEN outcome = 'applied' THEN CASE WHEN kind IN ('delete', 'automatic delete') THEN 0 ELSE 1 END END AS n_refs FROM f""")
def _(s, d):
    m, k = memories(s, d), F.col("id")
    null = lambda t: F.lit(None).cast(t)
    rest = [null("string").alias("body"), null("int").alias("class"), null("boolean").alias("mandatory"), null("boolean").alias("important")]
    kind = F.when(k % 5 == 0, "update").when(k % 5 == 1, "delete").when(k % 5 == 2, "automatic delete").when(k % 5 == 3, "promote").otherwise("demote")
    one = m.select("id", F.lit(1).alias("seq"), kind.alias("kind"), F.when(k % 17 == 0, 0).otherwise(F.col("revision")).alias("expected"), (F.col("updated_at") + F.when(k % 19 == 0, -1).otherwise(5)).alias("at"), F.when(k % 2 == 0, "1-URGENT").alias("title"), F.when(k % 4 == 0, F.array("id")).alias("refs"), *rest)
    two = m.where("id % 3 = 1").select("id", F.lit(2), F.lit("update"), "revision", "updated_at", F.lit("second"), null("array<bigint>"), *rest)
    lost = s.range(1).select(F.lit(-1), F.lit(1), F.lit("update"), F.lit(1), F.lit(1), F.lit("x"), null("array<bigint>"), *rest)
    a = F.col("after")
    return L.mutations(m, one.union(two).union(lost)).select("id", "seq", "outcome", a["revision"].alias("revision"), a["title"].alias("title"), a["alive"].alias("alive"), a["important"].alias("important"), a["generation"].alias("generation"), F.when(a.isNotNull(), F.size(a["refs"])).alias("n_refs"))


@query("m3_fold", f"""WITH {MEMORY}, f AS (SELECT *, customer AS fold, revision + CASE WHEN id % 53 = 0 THEN 1 ELSE 0 END AS expected, id = min(id) OVER (PARTITION BY customer) AS survives FROM m WHERE id % 13 <> 5 OR id % 4 = 0),
g AS (SELECT fold, count(*) < 2 AS few, bool_and(alive AND expected = revision) AS sound, bool_or(mandatory) AS mandatory, bool_or(important) AS important, max(class) AS class FROM f GROUP BY fold)
SELECT fold, id, CASE WHEN few THEN 'invalid' WHEN sound THEN 'applied' ELSE 'conflict' END AS outcome, CASE WHEN sound AND NOT few THEN survives END AS alive, CASE WHEN sound AND NOT few THEN CASE WHEN survives THEN g.class ELSE f.class END END AS class,
CASE WHEN sound AND NOT few THEN CASE WHEN survives THEN g.mandatory ELSE f.mandatory END END AS mandatory, CASE WHEN sound AND NOT few THEN CASE WHEN survives THEN 1 ELSE 0 END END AS n_refs FROM f JOIN g USING (fold)""")
def _(s, d):
    m, k = memories(s, d), F.col("id")
    mine = m.select("id", "revision", "updated_at", F.col("refs")[0].alias("fold")).where((k % 13 != 5) | (k % 4 == 0))
    least = mine.groupBy("fold").agg(F.min("id").alias("least"))
    folds = mine.join(least, "fold").select("fold", "id", (F.col("revision") + F.when(k % 53 == 0, 1).otherwise(0)).alias("expected"), (k == F.col("least")).alias("survives"), F.col("updated_at").alias("at"))
    a = F.col("after")
    return L.fold(m, folds).select("fold", "id", "outcome", a["alive"].alias("alive"), a["class"].alias("class"), a["mandatory"].alias("mandatory"), F.when(a.isNotNull(), F.size(a["refs"])).alias("n_refs"))


@query("t25_claims", """WITH h AS (SELECT o_orderkey AS id, o_orderkey % 3 AS revision, CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'open' END AS status, CASE WHEN o_orderkey % 5 > 1 THEN 'a' || o_custkey % 2 END AS owner, o_orderkey % 6 + 1 AS epoch,
CASE WHEN o_orderkey % 5 > 1 THEN 1000000 + (o_orderkey % 100 - 30) * 1000 END AS expires_at, o_custkey FROM orders),
r AS (SELECT *, CASE id % 3 WHEN 0 THEN 'claim' WHEN 1 THEN 'heartbeat' ELSE 'release' END AS kind, CASE WHEN id % 7 = 0 THEN 'a0' ELSE 'a' || o_custkey % 2 END AS actor, epoch - CASE WHEN id % 11 = 0 THEN 1 ELSE 0 END AS fence, id % 13 <> 0 AS fresh, CASE WHEN id % 17 = 0 THEN 0 ELSE 60000 END AS lease FROM h),
o AS (SELECT *, CASE WHEN NOT fresh THEN 'conflict' WHEN kind <> 'release' AND lease = 0 THEN 'invalid' WHEN kind = 'claim' THEN CASE WHEN status = 'completed' THEN 'closed' WHEN expires_at > 1000000 THEN 'held' ELSE 'applied' END
WHEN owner IS NULL OR owner <> actor OR fence <> epoch THEN 'fenced' WHEN kind = 'heartbeat' AND expires_at <= 1000000 THEN 'expired' ELSE 'applied' END AS outcome FROM r)
SELECT id, outcome, CASE WHEN outcome = 'applied' AND kind <> 'release' THEN actor END AS owner, CASE WHEN outcome = 'applied' THEN epoch + CASE WHEN kind = 'claim' THEN 1 ELSE 0 END END AS epoch, CASE WHEN outcome = 'applied' AND kind <> 'release' THEN CAST(1060000 AS BIGINT) END AS expires_at FROM o""")
def _(s, d):
    k, now = F.col("o_orderkey"), F.lit(1_000_000).cast("long")
    held, mine = k % 5 > 1, F.concat(F.lit("a"), (F.col("o_custkey") % 2).cast("string"))
    o = table(s, d, "orders")
    heads = o.select(k.alias("id"), (k % 3).alias("revision"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("open").alias("status"), F.when(held, mine).alias("owner"), (k % 6 + 1).alias("epoch"), F.when(held, now - 100_000).alias("claimed_at"), F.when(held, now - 90_000).alias("heartbeat_at"), F.when(held, now + (k % 100 - 30) * 1000).alias("expires_at"))
    kind = F.when(k % 3 == 0, "claim").when(k % 3 == 1, "heartbeat").otherwise("release")
    asked = o.select(k.alias("id"), F.lit(1).alias("seq"), kind.alias("kind"), F.when(k % 7 == 0, "a0").otherwise(mine).alias("actor"), (k % 6 + 1 - F.when(k % 11 == 0, 1).otherwise(0)).alias("epoch"), (k % 3 + F.when(k % 13 == 0, 1).otherwise(0)).alias("expected"), now.alias("at"), F.when(k % 17 == 0, 0).otherwise(60_000).alias("lease_ms"))
    a = F.col("after")
    return L.claims(heads, asked).select("id", "outcome", a["owner"].alias("owner"), a["epoch"].alias("epoch"), a["expires_at"].alias("expires_at"))


CHECKS = """c AS (SELECT l_orderkey AS id, l_linenumber AS n, CASE WHEN l_linenumber % 2 = 1 THEN 'acceptance' ELSE 'test' END AS kind, CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'superseded' WHEN l_quantity > 20 THEN 'passed' ELSE 'pending' END AS status FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL))"""


def specs(s, d):
    """Orders as specifications, their line items as checks; items of one number, which the sample tables have, are one."""
    n = F.col("l_linenumber")
    status = F.when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"), "superseded").when(F.col("l_quantity") > 20, "passed").otherwise("pending")
    one = F.struct(n.alias("id"), F.when(n % 2 == 1, "acceptance").otherwise("test").alias("kind"), F.concat(F.lit("c"), n.cast("string")).alias("text"), status.alias("status"), F.when(status == "passed", "seen").alias("evidence"))
    items = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in ("l_returnflag", "l_linestatus", "l_quantity")])
    checks = items.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(one).alias("checks"))  # at most the items of one order
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3).alias("revision"), F.col("o_orderpriority").alias("title"), F.lit("").alias("description"), F.lit("task").alias("type"), (F.col("o_orderkey") % 5).alias("priority"))
    return o.join(checks, "id")


def counted(done):
    n = lambda status: F.size(F.filter("after.checks", lambda c: c["status"] == status)).cast("long")
    return done.select("id", "outcome", *[F.when(F.col("after").isNotNull(), n(x)).alias(x) for x in ("passed", "pending", "superseded")])


@query("t22_revision", f"""WITH {CHECKS}, k AS (SELECT id, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'superseded') AS superseded FROM c GROUP BY id),
o AS (SELECT *, CASE WHEN id % 13 = 0 THEN 'conflict' WHEN id % 23 = 0 OR (id % 4 = 0 AND id % 7 > 4) THEN 'invalid' WHEN id % 3 <> 1 AND (id % 4 <> 0 OR id % 7 = id % 5) THEN 'no change' ELSE 'applied' END AS outcome FROM k JOIN orders ON o_orderkey = id)
SELECT id, outcome, CASE WHEN outcome = 'applied' THEN CASE WHEN id % 3 = 1 THEN 0 ELSE passed END END AS passed, CASE WHEN outcome = 'applied' THEN pending + CASE WHEN id % 3 = 1 THEN passed ELSE 0 END END AS pending, CASE WHEN outcome = 'applied' THEN superseded END AS superseded FROM o""")
def _(s, d):
    t, k = specs(s, d), F.col("id")
    title = F.when(k % 3 == 0, F.concat(F.lit(" "), "title", F.lit(" "))).when(k % 3 == 1, "renamed")
    null = F.lit(None).cast("string")
    return counted(L.revise(t, t.select("id", F.lit(1).alias("seq"), (F.col("revision") + F.when(k % 13 == 0, 1).otherwise(0)).alias("expected"), title.alias("title"), null.alias("description"), null.alias("type"), F.when(k % 4 == 0, k % 7).alias("priority"), F.lit("me").alias("actor"), F.when(k % 23 == 0, " ").otherwise("why").alias("reason"))))


@query("t23_verification", f"""WITH {CHECKS}, k AS (SELECT id, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'superseded') AS superseded, max(status) FILTER (n = id % 4 + 1) AS target FROM c GROUP BY id),
o AS (SELECT k.*, CASE WHEN id % 13 = 0 THEN 'conflict' WHEN id % 23 = 0 THEN 'invalid' WHEN target IS NULL THEN 'unknown check' WHEN target = 'superseded' THEN 'superseded check' ELSE 'applied' END AS outcome FROM k JOIN orders ON o_orderkey = id)
SELECT id, outcome, CASE WHEN outcome = 'applied' THEN passed - CAST(target = 'passed' AS INT) + CAST(id % 2 = 0 AS INT) END AS passed, CASE WHEN outcome = 'applied' THEN pending - CAST(target = 'pending' AS INT) END AS pending, CASE WHEN outcome = 'applied' THEN superseded END AS superseded FROM o""")
def _(s, d):
    t, k = specs(s, d), F.col("id")
    return counted(L.verify(t, t.select("id", F.lit(1).alias("seq"), (F.col("revision") + F.when(k % 13 == 0, 1).otherwise(0)).alias("expected"), (k % 4 + 1).cast("int").alias("check"), (k % 2 == 0).alias("passed"), F.when(k % 23 == 0, " ").otherwise("log").alias("evidence"), F.lit("me").alias("actor"))))


@query("t23_supersession", f"""WITH {CHECKS}, x AS (SELECT *, n = id % 4 + 1 AS hit, id % 2 = 0 AS repl, CASE WHEN id % 4 = 0 THEN CASE WHEN (id % 4 + 1) % 2 = 1 THEN 'acceptance' ELSE 'test' END ELSE 'test' END AS new_kind, CASE WHEN id % 3 = 0 THEN 'c2' ELSE 'new' END AS new_text FROM c),
k AS (SELECT id, any_value(repl) AS repl, any_value(new_kind) AS new_kind, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'superseded') AS superseded, max(status) FILTER (hit) AS target,
bool_or(repl AND kind = new_kind AND 'c' || n = new_text) AS twice, coalesce(bool_or(kind = 'test') FILTER (NOT hit AND status <> 'superseded'), false) AS test, coalesce(bool_or(kind = 'acceptance') FILTER (NOT hit AND status <> 'superseded'), false) AS acc FROM x GROUP BY id),
o AS (SELECT k.*, CASE WHEN id % 13 = 0 THEN 'conflict' WHEN id % 23 = 0 THEN 'invalid' WHEN target IS NULL THEN 'unknown check' WHEN target = 'superseded' THEN 'superseded check' WHEN twice THEN 'repeated check'
WHEN NOT ((test OR repl AND new_kind = 'test') AND (acc OR repl AND new_kind = 'acceptance')) THEN 'missing kind' ELSE 'applied' END AS outcome FROM k JOIN orders ON o_orderkey = id)
SELECT id, outcome, CASE WHEN outcome = 'applied' THEN passed - CAST(target = 'passed' AS INT) END AS passed, CASE WHEN outcome = 'applied' THEN pending - CAST(target = 'pending' AS INT) + CAST(repl AS INT) END AS pending, CASE WHEN outcome = 'applied' THEN superseded + 1 END AS superseded FROM o""")
def _(s, d):
    t, k = specs(s, d), F.col("id")
    some = k % 2 == 0
    return counted(L.supersede(t, t.select("id", F.lit(1).alias("seq"), (F.col("revision") + F.when(k % 13 == 0, 1).otherwise(0)).alias("expected"), (k % 4 + 1).cast("int").alias("check"), F.lit("me").alias("actor"), F.when(k % 23 == 0, "").otherwise("old").alias("reason"), F.when(some, 100).alias("new_check"), F.when(some & (k % 4 != 0), "test").alias("new_kind"), F.when(some, F.when(k % 3 == 0, "c2").otherwise("new")).alias("new_text"))))
