"""Property-graph operators over an edge table (kind, src_label, src, dst_label, dst, uid)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.sources.shared import tasks


def neighborhood(edges: DataFrame, label: str, key: int, kind: str, other: str, direction: str = "out", after: str = "", limit: int = 100) -> DataFrame:
    """A page of edges of one kind at one node by uid keyset: filters reach the scan, the page is a top-k without a full sort.

    has_more tells whether edges follow the page.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit is 1 to 100")
    out = (F.col("kind") == kind) & (F.col("src_label") == label) & (F.col("src") == key) & (F.col("dst_label") == other)
    back = (F.col("kind") == kind) & (F.col("dst_label") == label) & (F.col("dst") == key) & (F.col("src_label") == other)
    own = edges.where({"out": out, "in": back, "both": out | back}[direction] & (F.col("uid") > after)).orderBy("uid").limit(limit + 1)
    ranked = own.withColumn("rank", F.row_number().over(Window.orderBy("uid"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    return ranked.where(F.col("rank") <= limit).withColumn("has_more", F.col("n") > limit).drop("rank", "n")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src_label", "src").agg(F.count(F.lit(1)).alias("degree"))


def top_degrees(edges: DataFrame, k: int) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "src_label", "src").limit(k)


def schema_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind", "src_label", "dst_label").agg(F.count(F.lit(1)).alias("n"))


def reachable(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(origin, label, node, depth): distinct nodes within hops, the least depth first; start has (origin, label, node)."""
    step = edges.select(F.col("src_label").alias("label"), F.col("src").alias("node"), F.col("dst_label").alias("l2"), F.col("dst").alias("n2"))
    n, place = tasks(edges, 8), ["origin", "label", "node"]  # as many tasks as the input asks for: rows pack so well that fewer would be large
    step = step.repartition(n, "label", "node")
    front, seen = start.select(*place), None
    for d in range(1, hops + 1):
        front = front.repartition(n, "label", "node").join(step, ["label", "node"]).select("origin", F.col("l2").alias("label"), F.col("n2").alias("node")).repartition(n, *place).distinct()
        at = front.withColumn("depth", F.lit(d))
        seen = at if seen is None else seen.unionByName(at)
    return seen.repartition(n, *place).groupBy(*place).agg(F.min("depth").alias("depth"))


def sample(edges: DataFrame, nodes: DataFrame, n_nodes: int, n_edges: int) -> DataFrame:
    """(label, node): the first nodes, the ends of the first edges, once each; nulls are last, and of edges that tie those of the smallest ends go first."""
    last = lambda *names: [F.col(c).asc_nulls_last() for c in names]
    seeds = nodes.orderBy(*last("label", "node")).limit(n_nodes)
    first = edges.orderBy(*last("kind", "uid", "src", "dst")).limit(n_edges)
    ends = first.select(F.col("src_label").alias("label"), F.col("src").alias("node")).union(first.select("dst_label", "dst"))
    return seeds.select("label", "node").union(ends).distinct()


def integrity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row of counts that are all 0 in a sound graph: repeated uids, empty uids, ends without a node."""
    repeated = edges.groupBy("uid", "kind").count().where("count > 1").agg(F.count(F.lit(1)).alias("repeated_uids"))
    blank = edges.agg(F.count_if(F.coalesce("uid", F.lit("")) == "").alias("empty_uids"))
    lost = edges.join(nodes, (F.col("dst_label") == F.col("label")) & (F.col("dst") == F.col("node")), "left_anti").agg(F.count(F.lit(1)).alias("lost_ends"))
    return repeated.crossJoin(blank).crossJoin(lost)  # single rows


def resolve(references: DataFrame, declarations: DataFrame) -> DataFrame:
    """References (ref, name, scope) against declarations (name, scope, target): the innermost enclosing scope that has the name decides.

    scope is a path such as 'a/b'. Adds target and status: Resolved, Ambiguous or NotFound.
    """
    parts = F.split("scope", "/")
    outer = references.select("ref", "name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("scope")))).alias("s")).select("ref", "name", "s.depth", "s.scope")
    known = declarations.groupBy("name", "scope").agg(F.countDistinct("target").alias("n"), F.min("target").alias("target"))  # so that a join meets one row
    hits = outer.join(known, ["name", "scope"])
    best = hits.groupBy("ref").agg(F.max(F.struct("depth", "n", "target")).alias("b"))
    out = references.join(best, "ref", "left")
    return out.select("ref", "name", F.when(F.col("b.n") == 1, F.col("b.target")).alias("target"), F.when(F.col("b").isNull(), "NotFound").when(F.col("b.n") == 1, "Resolved").otherwise("Ambiguous").alias("status"))


def entity_source(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """(file, start_line, end_line, source): the lines of each span, from 1 and with both ends; a span without lines has none."""
    inside = spans.join(lines, "file").where(F.col("line_number").between(F.col("start_line"), F.col("end_line")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_number", "line"))), lambda x: x["line"]), "\n")
    return inside.groupBy("file", "start_line", "end_line").agg(text.alias("source"))
