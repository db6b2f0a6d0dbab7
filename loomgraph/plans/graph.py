"""Graph queries over the foreign keys of the sample tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators import coordinates, names, nesting
from loomgraph.operators import graph as G
from loomgraph.operators.cypher import cypher
from loomgraph.plans.registry import query
from loomgraph.sources import masks, package, tables
from loomgraph.sources.shared import shared_path, written
from loomgraph.sources.tables import table
from loomgraph.streaming.adjacency import Adjacency

EDGES = """edges AS (
  SELECT 'PLACED' AS kind, 'Customer' AS src_label, o_custkey AS src, 'Order' AS dst_label, o_orderkey AS dst, 'o/' || o_orderkey AS uid FROM orders
  UNION ALL SELECT 'CONTAINS', 'Order', l_orderkey, 'Part', l_partkey, l_orderkey || '/' || l_linenumber FROM lineitem
  UNION ALL SELECT 'IN_NATION', 'Customer', c_custkey, 'Nation', CAST(c_nationkey AS BIGINT), 'c/' || c_custkey FROM customer
  UNION ALL SELECT 'IN_REGION', 'Nation', CAST(n_nationkey AS BIGINT), 'Region', CAST(n_regionkey AS BIGINT), 'n/' || n_nationkey FROM nation
)"""
NODES = """nodes AS (
  SELECT 'Customer' AS label, c_custkey AS node FROM customer UNION ALL SELECT 'Order', o_orderkey FROM orders
  UNION ALL SELECT 'Part', p_partkey FROM part UNION ALL SELECT 'Nation', CAST(n_nationkey AS BIGINT) FROM nation UNION ALL SELECT 'Region', CAST(r_regionkey AS BIGINT) FROM region
)"""


def edges(s: SparkSession, d: str) -> DataFrame:
    def of(df, kind, a, src, b, dst, *uid):
        return df.select(F.lit(kind).alias("kind"), F.lit(a).alias("src_label"), F.col(src).cast("long").alias("src"), F.lit(b).alias("dst_label"), F.col(dst).cast("long").alias("dst"), F.concat(*uid).alias("uid"))

    return reduce(
        DataFrame.unionAll,
        [
            of(table(s, d, "orders"), "PLACED", "Customer", "o_custkey", "Order", "o_orderkey", F.lit("o/"), F.col("o_orderkey").cast("string")),
            of(table(s, d, "lineitem"), "CONTAINS", "Order", "l_orderkey", "Part", "l_partkey", F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")),
            of(table(s, d, "customer"), "IN_NATION", "Customer", "c_custkey", "Nation", "c_nationkey", F.lit("c/"), F.col("c_custkey").cast("string")),
            of(table(s, d, "nation"), "IN_REGION", "Nation", "n_nationkey", "Region", "n_regionkey", F.lit("n/"), F.col("n_nationkey").cast("string")),
        ],
    )


def nodes(s: SparkSession, d: str) -> DataFrame:
    keys = {"Customer": ("customer", "c_custkey"), "Order": ("orders", "o_orderkey"), "Part": ("part", "p_partkey"), "Nation": ("nation", "n_nationkey"), "Region": ("region", "r_regionkey")}
    return reduce(DataFrame.unionAll, [table(s, d, t).select(F.lit(label).alias("label"), F.col(k).cast("long").alias("node")) for label, (t, k) in keys.items()])


def page_sql(where: str) -> str:
    return f"""WITH {EDGES}, p AS (SELECT *, row_number() OVER (ORDER BY uid) AS rank, count(*) OVER () AS n FROM edges WHERE {where})
SELECT kind, src_label, src, dst_label, dst, uid, n > 20 AS has_more FROM p WHERE rank <= 20"""


@query("g3_neighborhood_out", page_sql("kind = 'PLACED' AND src = 7 AND uid > ''"))
def _(s, d):
    return G.neighborhood(edges(s, d), "Customer", 7, "PLACED", "Order", "out", limit=20)


@query("g4_neighborhood_in", page_sql("kind = 'CONTAINS' AND dst = 5 AND uid > '1'"))
def _(s, d):
    return G.neighborhood(edges(s, d), "Part", 5, "CONTAINS", "Order", "in", after="1", limit=20)


@query("g5_neighborhood_both", page_sql("kind = 'IN_REGION' AND ((src_label = 'Region' AND src = 1) OR (dst_label = 'Region' AND dst = 1))"))
def _(s, d):
    return G.neighborhood(edges(s, d), "Region", 1, "IN_REGION", "Nation", "both", limit=20)


@query("g2_sample", f"""WITH {EDGES}, {NODES}, e AS (SELECT * FROM edges ORDER BY kind, uid LIMIT 1000), n AS (SELECT * FROM nodes ORDER BY label, node LIMIT 300)
SELECT label, node FROM n UNION SELECT src_label, src FROM e UNION SELECT dst_label, dst FROM e""")
def _(s, d):
    return G.sample(edges(s, d), nodes(s, d), 300, 1000)


@query("g6_query_fingerprint", "SELECT p_partkey, sha256(concat_ws('|', 'Part', CAST(p_partkey AS VARCHAR), 'CONTAINS', 'Order', 'in')) AS fingerprint FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.sha2(F.concat_ws("|", F.lit("Part"), F.col("p_partkey").cast("string"), F.lit("CONTAINS"), F.lit("Order"), F.lit("in")), 256).alias("fingerprint"))


@query("g7_schema_counts", f"WITH {EDGES} SELECT kind, src_label, dst_label, count(*) AS n FROM edges GROUP BY ALL")
def _(s, d):
    return G.schema_counts(edges(s, d))


@query("g8_reachability", f"""WITH {EDGES}, a AS (SELECT DISTINCT src AS origin, dst_label AS label, dst AS node, 1 AS depth FROM edges WHERE src_label = 'Customer'),
b AS (SELECT DISTINCT origin, e.dst_label AS label, e.dst AS node, 2 AS depth FROM a JOIN edges e ON e.src_label = a.label AND e.src = a.node)
SELECT origin, label, node, min(depth) AS depth FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL""")
def _(s, d):
    return G.reachable(edges(s, d), nodes(s, d).where("label = 'Customer'").select(F.col("node").alias("origin"), "label", "node"), 2)


@query("g9_one_hop", f"WITH {EDGES} SELECT DISTINCT c_custkey, p_name FROM edges a JOIN edges b ON a.kind = 'PLACED' AND b.kind = 'CONTAINS' AND a.dst = b.src JOIN customer ON c_custkey = a.src JOIN part ON p_partkey = b.dst WHERE c_mktsegment = 'BUILDING'")
def _(s, d):
    e = edges(s, d)
    placed, contains = e.where("kind = 'PLACED'").select("src", F.col("dst").alias("o")), e.where("kind = 'CONTAINS'").select(F.col("src").alias("o"), F.col("dst").alias("p"))
    who = table(s, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return who.join(placed, F.col("c_custkey") == F.col("src")).join(contains, "o").join(table(s, d, "part").select("p_partkey", "p_name"), F.col("p") == F.col("p_partkey")).select("c_custkey", "p_name").distinct()


@query("g10_top_degrees", f"WITH {EDGES} SELECT src_label, src, count(*) AS degree FROM edges GROUP BY ALL ORDER BY degree DESC, src_label, src LIMIT 25")
def _(s, d):
    return G.top_degrees(edges(s, d), 25)


@query("g11_integrity", f"""WITH {EDGES}, {NODES} SELECT (SELECT count(*) FROM (SELECT uid, kind FROM edges GROUP BY ALL HAVING count(*) > 1)) AS repeated_uids,
(SELECT count(*) FROM edges WHERE coalesce(uid, '') = '') AS empty_uids, (SELECT count(*) FROM edges e WHERE NOT EXISTS (SELECT 1 FROM nodes WHERE label = dst_label AND node = dst)) AS lost_ends""")
def _(s, d):
    return G.integrity(edges(s, d), nodes(s, d))


def _ask(s, d, text, **params):
    keys = {"Customer": ("customer", "c_custkey"), "Order": ("orders", "o_orderkey"), "Part": ("part", "p_partkey"), "Nation": ("nation", "n_nationkey"), "Region": ("region", "r_regionkey")}
    own = {label: table(s, d, t).withColumns({"id": F.col(k).cast("long"), "name": F.col("o_orderpriority" if t == "orders" else f"{k[0]}_name")}) for label, (t, k) in keys.items()}
    return cypher(text, own, edges(s, d), written, **params)


NAMED = """named AS (SELECT 'Customer' AS label, c_custkey AS node, c_name AS name FROM customer UNION ALL SELECT 'Order', o_orderkey, o_orderpriority FROM orders
  UNION ALL SELECT 'Part', p_partkey, p_name FROM part UNION ALL SELECT 'Nation', n_nationkey, n_name FROM nation UNION ALL SELECT 'Region', r_regionkey, r_name FROM region)"""


@query("g1_cypher", "SELECT DISTINCT c_name AS name, o_orderpriority AS o_orderpriority FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 1000 AND o_orderpriority LIKE '%H'")
def _(s, d):
    return _ask(s, d, "MATCH (c:Customer {c_mktsegment: $seg})-[:PLACED]->(o:Order) WHERE o.o_totalprice > 1000 AND o.o_orderpriority ENDS WITH 'H' RETURN DISTINCT c.c_name AS name, o.o_orderpriority", seg="BUILDING")


@query("g1_lookup", "SELECT p_name FROM part WHERE p_name LIKE '%1' ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def _(s, d):
    """By the end of a name, in an order that isn't returned."""
    return _ask(s, d, "MATCH (f:Part) WHERE f.p_name ENDS WITH '1' RETURN f.p_name ORDER BY f.p_retailprice DESC, f.id LIMIT 10")


@query("g1_definition", "SELECT p_partkey AS id, p_name, p_size, p_brand FROM part WHERE (p_brand = 'Brand#11' OR p_size IN (1, 2, 3)) AND NOT p_type LIKE 'S%' AND p_name IS NOT NULL")
def _(s, d):
    return _ask(s, d, "MATCH (f:Part) WHERE (f.p_brand = 'Brand#11' OR f.p_size IN [1, 2, 3]) AND NOT f.p_type STARTS WITH 'S' AND f.p_name IS NOT NULL RETURN f.id, f.p_name, f.p_size, f.p_brand")


@query("g1_callers", f"WITH {EDGES}, {NAMED} SELECT DISTINCT label, name FROM edges JOIN named ON label = src_label AND node = src WHERE kind = 'CONTAINS' AND dst IN (SELECT p_partkey FROM part WHERE p_size > 40)")
def _(s, d):
    """Whatever has an edge to the nodes asked for; the callers have no label in the pattern."""
    return _ask(s, d, "MATCH (caller)-[:CONTAINS]->(f:Part) WHERE f.p_size > 40 RETURN DISTINCT label(caller) AS label, caller.name")


@query("g1_callees", f"WITH {EDGES}, {NAMED} SELECT DISTINCT label, node AS id, name FROM edges JOIN named ON label = dst_label AND node = dst JOIN customer ON src_label = 'Customer' AND src = c_custkey WHERE c_mktsegment = 'BUILDING'")
def _(s, d):
    return _ask(s, d, "MATCH (c:Customer {c_mktsegment: 'BUILDING'})-->(callee) RETURN DISTINCT label(callee) AS label, callee.id, callee.name")


@query("g1_impact", f"""WITH {EDGES}, {NAMED}, one AS (SELECT DISTINCT src_label AS l, src AS v FROM edges JOIN part ON dst_label = 'Part' AND dst = p_partkey WHERE p_size > 45),
two AS (SELECT * FROM one UNION SELECT e.src_label, e.src FROM one JOIN edges e ON e.dst_label = l AND e.dst = v)
SELECT DISTINCT label, name FROM two JOIN named ON label = l AND node = v""")
def _(s, d):
    """What may be touched within two hops; walked back from the nodes asked for."""
    return _ask(s, d, "MATCH (dependent)-[*1..2]->(f:Part) WHERE f.p_size > 45 RETURN DISTINCT label(dependent) AS label, dependent.name")


@query("g1_candidates", f"WITH {EDGES} SELECT DISTINCT o_orderkey AS id FROM edges JOIN orders ON src_label = 'Order' AND src = o_orderkey JOIN part ON dst_label = 'Part' AND dst = p_partkey WHERE p_size > 45 AND o_orderpriority LIKE '%URGENT'")
def _(s, d):
    return _ask(s, d, "MATCH (caller:Order)-[:CONTAINS]->(f:Part) WHERE f.p_size > 45 AND caller.o_orderpriority ENDS WITH 'URGENT' RETURN DISTINCT caller.id")


@query("g1_aggregates", "SELECT n_name, count(*) AS orders, count(DISTINCT c_custkey) AS customers, max(o_totalprice) AS most FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY n_name ORDER BY orders DESC, n_name LIMIT 10")
def _(s, d):
    return _ask(s, d, "MATCH (o:Order)<-[:PLACED]-(c:Customer)-[:IN_NATION]->(n:Nation) RETURN n.n_name, count(*) AS orders, count(DISTINCT c.id) AS customers, max(o.o_totalprice) AS most ORDER BY orders DESC, n.n_name LIMIT 10")


@query("g1_siblings", "SELECT count(*) AS pairs FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey WHERE a.c_custkey < b.c_custkey")
def _(s, d):
    """Two patterns that share a node, and a condition on two others."""
    return _ask(s, d, "MATCH (a:Customer)-[:IN_NATION]->(n:Nation), (b:Customer)-[:IN_NATION]->(n) WHERE a.id < b.id RETURN count(*) AS pairs")


@query("p12_cypher_paths", f"WITH {EDGES}, x AS (SELECT src, dst, dst_label FROM edges WHERE src_label = 'Customer' UNION ALL SELECT a.src, b.dst, b.dst_label FROM edges a JOIN edges b ON a.src_label = 'Customer' AND a.dst_label = b.src_label AND a.dst = b.src) SELECT DISTINCT c_custkey AS id, r_name FROM x JOIN customer ON c_custkey = src JOIN region ON dst_label = 'Region' AND dst = r_regionkey")
def _(s, d):
    return _ask(s, d, "MATCH (c:Customer)-[*1..2]->(r:Region) RETURN DISTINCT c.id, r.r_name")


@query("p12_walk_counts", f"WITH {EDGES} SELECT a.src AS id, count(*) AS walks FROM edges a JOIN edges b ON b.src_label = a.dst_label AND b.src = a.dst WHERE a.src_label = 'Customer' AND b.dst_label = 'Part' GROUP BY ALL")
def _(s, d):
    return _ask(s, d, "MATCH (c:Customer)-[*2..2]->(p:Part) RETURN c.id, count(*) AS walks")


@query("g14_resolve", """WITH r AS (SELECT DISTINCT p_partkey AS ref, p_brand AS name, p_type AS t FROM part), h AS (
SELECT r.ref, 2 AS depth, count(DISTINCT s.p_partkey) AS n, min(s.p_partkey) AS target FROM r JOIN part s ON s.p_brand = r.name AND s.p_type = r.t AND s.p_size % 2 = 0 GROUP BY r.ref
UNION ALL SELECT r.ref, 1, count(DISTINCT s.p_partkey), min(s.p_partkey) FROM r JOIN part s ON s.p_brand = r.name AND s.p_size % 2 = 1 GROUP BY r.ref),
b AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY depth DESC) AS k FROM h)
SELECT r.ref, r.name, CASE WHEN n = 1 THEN target END AS target, CASE WHEN n IS NULL THEN 'NotFound' WHEN n = 1 THEN 'Resolved' ELSE 'Ambiguous' END AS status FROM r LEFT JOIN b ON r.ref = b.ref AND k = 1""")
def _(s, d):
    part = table(s, d, "part").withColumn("inner", F.concat(F.lit("m/"), F.regexp_replace("p_type", "/", "_")))
    declared = part.select(F.col("p_brand").alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("inner")).otherwise("m").alias("scope"), F.col("p_partkey").alias("target"))
    return G.resolve(part.select(F.col("p_partkey").alias("ref"), F.col("p_brand").alias("name"), F.col("inner").alias("scope")), declared)


@query("g15_containment", "SELECT l_orderkey AS child_order, l_linenumber AS child, max(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS owner FROM lineitem")
def _(s, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rowsBetween(Window.unboundedPreceding, -1)
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("child_order"), F.col("l_linenumber").alias("child"), F.max("l_linenumber").over(w).alias("owner"))


SPANS = """spans AS (SELECT o_orderpriority AS file, o_orderkey AS uid, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS s, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + CAST(floor(o_totalprice / 1000) AS BIGINT) AS e, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 END AS weight FROM orders)"""


def _spans(s, d):
    """Orders as spans of so many days as their price in thousands, in five large files; those of a status weigh, the others declare."""
    day = F.unix_date(F.col("o_orderdate").cast("date")).cast("long")
    weight = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "P", 1)
    return table(s, d, "orders").select(F.col("o_orderpriority").alias("file"), F.col("o_orderkey").alias("uid"), day.alias("start"), (day + F.floor(F.col("o_totalprice") / 1000).cast("long")).alias("end"), weight.alias("weight"))


@query("g15_owners", f"""WITH {SPANS}, o AS (SELECT c.file, c.uid, max({{'s': o.s, 'less': -o.e, 'uid': o.uid}}) AS best FROM spans c JOIN spans o ON o.file = c.file AND o.e >= c.e AND (o.s < c.s OR (o.s = c.s AND (o.e > c.e OR (o.e = c.e AND o.uid < c.uid)))) GROUP BY ALL)
SELECT file, uid, best.uid AS owner FROM spans LEFT JOIN o USING (file, uid)""")
def _(s, d):
    return nesting.owners(_spans(s, d), F.lit(True), written).select("file", "uid", "owner")


@query("g18_nested_complexity", f"""WITH {SPANS}, o AS (SELECT c.file, c.uid, any_value(c.weight) AS weight, max({{'s': o.s, 'less': -o.e, 'uid': o.uid}}) AS best FROM spans c JOIN spans o ON o.weight IS NULL AND o.file = c.file AND o.e >= c.e AND (o.s < c.s OR (o.s = c.s AND (o.e > c.e OR (o.e = c.e AND o.uid < c.uid)))) WHERE c.weight IS NOT NULL GROUP BY c.file, c.uid),
n AS (SELECT file, best.uid AS uid, sum(weight) AS n FROM o GROUP BY ALL) SELECT file, uid, CAST(1 + coalesce(n, 0) AS BIGINT) AS complexity FROM spans LEFT JOIN n USING (file, uid) WHERE weight IS NULL""")
def _(s, d):
    return nesting.complexity(_spans(s, d), written)


@query("g16_edge_dedup", f"WITH {EDGES} SELECT DISTINCT kind, src, dst FROM edges")
def _(s, d):
    return edges(s, d).dropDuplicates(["kind", "src", "dst"]).select("kind", "src", "dst")


@query("g17_exports", "SELECT p_partkey, regexp_matches(p_name, '^[A-Z]') AS capital, NOT starts_with(p_name, '_') AS no_prefix, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R') AS stated FROM part")
def _(s, d):
    part, stated = table(s, d, "part"), table(s, d, "lineitem").where("l_returnflag = 'R'").select("l_partkey").distinct()
    return part.join(stated, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.col("p_name").rlike("^[A-Z]").alias("capital"), (~F.col("p_name").startswith("_")).alias("no_prefix"), F.col("l_partkey").isNotNull().alias("stated"))


@query("g18_complexity", "SELECT l_orderkey AS declaration, CAST(1 + sum(CASE WHEN l_returnflag = 'R' THEN 2 WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS complexity FROM lineitem GROUP BY ALL")
def _(s, d):
    weight = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    return table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("declaration")).agg((1 + F.sum(weight)).alias("complexity"))


@query("g19_line_window", r"SELECT doc_id, 1 + length(substr(text, 1, length(text) // 2)) - length(replace(substr(text, 1, length(text) // 2), chr(10), '')) AS start_line, 1 + length(text) - length(replace(text, chr(10), '')) AS end_line FROM documents WHERE text <> ''")
def _(s, d):
    nl = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    docs = table(s, d, "documents").where("text <> ''")
    return docs.select("doc_id", (1 + nl(F.col("text").substr(F.lit(1), F.floor(F.length("text") / 2).cast("int")))).cast("long").alias("start_line"), (1 + nl(F.col("text"))).cast("long").alias("end_line"))


@query("g20_symbols", f"WITH {EDGES} SELECT kind || ' ' || src || ' ' || dst AS symbol, count(*) AS n_references FROM edges WHERE kind <> 'IN_REGION' GROUP BY ALL")
def _(s, d):
    return edges(s, d).where("kind <> 'IN_REGION'").groupBy(F.concat_ws(" ", "kind", F.col("src").cast("string"), F.col("dst").cast("string")).alias("symbol")).agg(F.count(F.lit(1)).alias("n_references"))


@query("g21_lookup_key", "SELECT o_orderkey, CASE WHEN n = 1 THEN t END AS target, CASE WHEN n IS NULL THEN 'NotFound' WHEN n = 1 THEN 'Resolved' ELSE 'Ambiguous' END AS status FROM orders LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n, min(c_custkey) AS t FROM customer WHERE c_acctbal > 5000 GROUP BY ALL) ON k = o_orderkey % 40")
def _(s, d):
    keys = table(s, d, "customer").where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("t"))
    return table(s, d, "orders").join(keys, F.col("o_orderkey") % 40 == F.col("k"), "left").select("o_orderkey", F.when(F.col("n") == 1, F.col("t")).alias("target"), F.when(F.col("n").isNull(), "NotFound").when(F.col("n") == 1, "Resolved").otherwise("Ambiguous").alias("status"))


@query("g22_qualified_names", "SELECT l_orderkey, l_linenumber, CASE WHEN n = 1 THEN m END AS target FROM lineitem LEFT JOIN (SELECT l_orderkey AS o, l_suppkey AS q, count(*) AS n, min(l_partkey) AS m FROM lineitem GROUP BY ALL) ON o = l_orderkey AND q = l_suppkey")
def _(s, d):
    li = table(s, d, "lineitem")
    owner = li.groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_partkey").alias("m"))
    return li.join(owner, ["l_orderkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", F.when(F.col("n") == 1, F.col("m")).alias("target"))


@query("g22_scoped_names", """WITH k AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_custkey) AS t FROM customer WHERE c_acctbal > 7000 GROUP BY ALL)
SELECT o_orderkey AS ref, CASE WHEN n = 1 THEN t END AS target, CASE WHEN n IS NULL THEN 'NotFound' WHEN n = 1 THEN 'Resolved' ELSE 'Ambiguous' END AS status
FROM orders JOIN customer c ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN k ON k.c_nationkey = c.c_nationkey AND k.c_mktsegment = c.c_mktsegment AND o_orderkey % 4 < 3""")
def _(s, d):
    """Segments named by orders from within their nation: plain, by keyword, by the nation's name, and by the region's, which has no such member."""
    places = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name", F.concat_ws("/", "r_name", "n_name").alias("scope"))
    people = table(s, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    one = lambda df, name, scope, label, target: df.select(F.col(name).alias("name"), scope.alias("scope"), F.lit(label).alias("label"), F.col(target).cast("long").alias("target"))
    entities = one(people.where("c_acctbal > 7000"), "c_mktsegment", F.col("scope"), "Customer", "c_custkey").unionByName(one(places, "n_name", F.col("r_name"), "Nation", "n_nationkey")).unionByName(one(table(s, d, "region"), "r_name", F.lit(""), "Region", "r_regionkey"))
    k = F.col("o_orderkey") % 4
    refs = table(s, d, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("ref"), F.col("c_mktsegment").alias("name"), "scope", F.lit(None).cast("string").alias("own"), F.when(k == 1, "self").when(k == 2, F.col("n_name")).when(k == 3, F.col("r_name")).alias("qualifier"), F.array(F.lit("Nobody")).alias("labels"), F.lit("Customer").alias("fallback"))
    return names.qualified(refs, entities)


@query("g23_coordinates", "SELECT doc_id, octet_length(encode(substr(text, 1, length(text) // 2))) AS byte_offset, length(text) // 2 AS point_offset, octet_length(encode(text)) AS bytes FROM documents")
def _(s, d):
    half = F.floor(F.length("text") / 2)
    return table(s, d, "documents").select("doc_id", F.octet_length(F.col("text").substr(F.lit(1), half.cast("int"))).cast("long").alias("byte_offset"), half.alias("point_offset"), F.octet_length("text").cast("long").alias("bytes"))


@query("g23_projection", """WITH x AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents), y AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM x),
l AS (SELECT doc_id, i, length(line) AS c, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) - length(line) - 1 AS o FROM y)
SELECT doc_id, i * 4 AS id, 'Exact' AS state, o AS original_start, o + c + 1 AS original_end, 1 AS pieces FROM l UNION ALL SELECT doc_id, i * 4 + 1, 'Compound', NULL, o + 1, 2 FROM l
UNION ALL SELECT doc_id, i * 4 + 2, 'Exact', o, o, 0 FROM l UNION ALL SELECT doc_id, i * 4 + 3, CASE WHEN i > 1 THEN 'Exact' ELSE 'Unmappable' END, CASE WHEN i > 1 THEN o END, CASE WHEN i > 1 THEN o END, 0 FROM l""")
def _(s, d):
    """Quoted texts: two characters before each line are made up, the rest is the document's; ranges of the quoted text are found in the document."""
    parts = table(s, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line")).select("doc_id", F.col("i").cast("long").alias("i"), F.length("line").cast("long").alias("c"))
    earlier = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)  # the lines of one text, which is one row anyway
    own = written(parts.withColumn("o", F.coalesce(F.sum(F.col("c") + 1).over(earlier), F.lit(0))).withColumn("q", F.col("o") + 2 * F.col("i")))
    piece = lambda kind, a, b, o, e: F.struct(F.lit(kind).alias("kind"), a.alias("start"), b.alias("end"), o.cast("long").alias("original_start"), e.cast("long").alias("original_end"))
    q, o, n = F.col("q"), F.col("o"), F.col("c") + 1
    segments = own.select(F.col("doc_id").alias("file"), F.inline(F.array(piece("Synthetic", q, q + 2, F.lit(None), F.lit(None)), piece("Direct", q + 2, q + 2 + n, o, o + n))))
    ask = lambda k, a, b: F.struct((F.col("i") * 4 + 4 + k).alias("id"), a.alias("start"), b.alias("end"))
    asked = own.select(F.col("doc_id").alias("file"), F.inline(F.array(ask(0, q + 2, q + 2 + n), ask(1, q, q + 3), ask(2, q + 2, q + 2), ask(3, q, q))))
    return coordinates.project(segments, asked, written).withColumnRenamed("file", "doc_id")


@query("g12_entity_source", "SELECT doc_id, array_to_string(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10))[2:4], chr(10)) AS source FROM documents WHERE len(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10))) > 4")
def _(s, d):
    docs = table(s, d, "documents")
    spans = docs.where(F.size(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n", "\n"), "\n")) > 4).select(F.col("doc_id").alias("file"), F.lit(2).alias("start_line"), F.lit(4).alias("end_line"))
    return G.entity_source(spans, tables.lines(docs, "doc_id", "text").withColumnRenamed("doc_id", "file")).select(F.col("file").alias("doc_id"), "source")


@query("g24_canonical_names", "SELECT p_partkey, nfc_normalize(replace(p_name || ' ﬁne e\u0301', 'ﬁ', 'fi')) AS name FROM part")
def _(s, d):
    from loomgraph.functions.text import nfkc

    return table(s, d, "part").select("p_partkey", nfkc(F.concat("p_name", F.lit(" \ufb01ne e\u0301"))).alias("name"))


def _csr(s, d):
    e = table(s, d, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("target"), F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")).alias("uid"))
    return tables.csr_write(e, table(s, d, "customer").select(F.col("c_custkey").alias("row")))


@query("s7_csr_pointers", "SELECT c_custkey AS source, CAST(coalesce(sum(n) OVER (ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"begin\", CAST(sum(n) OVER (ORDER BY c_custkey) AS BIGINT) AS \"end\" FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)")
def _(s, d):
    return tables.csr_ranges(_csr(s, d)[0])


@query("k3_s8_csr_round_trip", "SELECT o_custkey AS source, o_orderkey AS target, 'o/' || o_orderkey AS uid FROM orders JOIN customer ON c_custkey = o_custkey")
def _(s, d):
    return tables.csr_edges(*_csr(s, d))


@query("g13_incident_csr", """WITH e AS (SELECT o_custkey AS source, o_orderkey AS target, 'o/' || o_orderkey AS uid FROM orders WHERE NOT (o_orderpriority = '1-URGENT' OR (o_orderpriority = '5-LOW' AND o_orderkey % 3 = 0)))
SELECT row_number() OVER (ORDER BY source, uid) - 1 AS position, source, target, uid FROM e""")
def _(s, d):
    """An adjacency of files (here priorities) after one lost a third of its edges, one all of them, and one came again."""
    e = table(s, d, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("target"), F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")).alias("uid"), F.col("o_orderpriority").alias("file"), F.lit(1).cast("long").alias("revision"))
    own = Adjacency(s, shared_path(s, "adjacency"), span=1 << 14)
    own.publish(e, e.select("file", "revision").distinct())
    again = e.where("file = '5-LOW' and target % 3 <> 0 or file = '2-HIGH'").withColumn("revision", F.when(F.col("file") == "5-LOW", 2).otherwise(1).cast("long"))
    own.publish(again, s.createDataFrame([("5-LOW", 2), ("2-HIGH", 1), ("1-URGENT", 2)], "file string, revision long"))
    return own.indices()


@query("s1_k1_package", "SELECT c_custkey AS source, o_orderkey AS target, 'o/' || o_orderkey AS uid FROM orders JOIN customer ON c_custkey = o_custkey")
def _(s, d):
    """Customers and orders as a package, sharded by segment and priority; its edges are read by the manifest, once no fault was found."""
    people, orders = table(s, d, "customer").select(F.col("c_mktsegment").alias("file"), "c_custkey", "c_name"), table(s, d, "orders").select(F.col("o_orderpriority").alias("file"), "o_orderkey", "o_totalprice")
    placed = table(s, d, "orders").join(people.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("target"), F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")).alias("uid"))
    root = shared_path(s, "package")
    own = package.write_package(s, root, {"Customer": (people, "c_custkey"), "Order": (orders, "o_orderkey")}, {"PLACED": ("Customer", "Order", placed)})
    if not own.faults().isEmpty():
        raise ValueError("the package is faulty")
    return own.edges("PLACED")


@query("s4_sparse_shards", "SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS p_brand, CASE WHEN p_partkey % 2 = 0 THEN row_number() OVER (PARTITION BY p_partkey % 2 ORDER BY p_partkey) - 1 ELSE 1000000 + row_number() OVER (PARTITION BY p_partkey % 2 ORDER BY p_partkey) - 1 END AS row FROM part")
def _(s, d):
    part = table(s, d, "part")
    return tables.node_shards([(part.where("p_partkey % 2 = 0").select("p_partkey", "p_name", "p_brand"), 0), (part.where("p_partkey % 2 = 1").select("p_partkey", "p_name"), 1_000_000)], "p_partkey").select("p_partkey", "p_name", "p_brand", F.col("row").cast("long"))


@query("s5_row_selection", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey < 50)")
def _(s, d):
    return table(s, d, "part").select("p_partkey", "p_name").join(table(s, d, "lineitem").where("l_orderkey < 50").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")


@query("s5_j2_masked_rows", """WITH p AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS row FROM part)
SELECT row, p_partkey, p_name FROM p WHERE row IN (SELECT l_partkey * 3 FROM lineitem WHERE l_quantity > 49)""")
def _(s, d):
    """Rows chosen by another table, by their places: a mask decides which shards and row groups are opened."""
    path = shared_path(s, "shards")
    masks.write_shards(table(s, d, "part").select("p_partkey", "p_name"), "p_partkey", path, 50_000)
    return masks.read_masked(s, path, table(s, d, "lineitem").where("l_quantity > 49").select((F.col("l_partkey") * 3).alias("row")))


@query("s9_pushed_scan", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R'")
def _(s, d):
    return table(s, d, "lineitem").where("l_quantity >= 49 and l_returnflag = 'R'").select("l_orderkey", "l_linenumber")


@query("s11_point_lookup", "SELECT page_id, url FROM pages WHERE page_id = 7")
def _(s, d):
    return table(s, d, "pages").where("page_id = 7").select("page_id", "url").limit(1)
