"""A trie of conversation prefixes, built level by level.

At each depth the conversations that still share their node are grouped by (node, next
turn); a group is a node of the next level, named by its smallest conversation.  One that
is alone in its node leaves: the rest of its turns is a chain and needs no grouping, so
there are as many rounds as the longest shared prefix has turns, however long
conversations are.  Then, from the deepest level up, children are added to their parents:
leaves and savings of whole subtrees.

Turns travel as SHA-256 of role and text; texts are read once.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import stored, table
from loomgraph.operators.ordering import running

FAMILY, SHARED = 100, 6
#: So many values of conv_id at most make a part of a list of members.
_PART = 4096


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, key, size): the turns of each conversation numbered from 1, what tells them apart, and the code points of the text.

    In order of turn, null first; ties by role, then by key, so repeated rows
    are turns of their own.  A null role or text counts as empty; rows without
    conv_id belong to no conversation and are left out.  Numbers come from
    ranges of all rows, so a conversation of any length is split.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), key.alias("key"), F.length(text).cast("long").alias("size"), F.monotonically_increasing_id().alias("row"))
    rows = running(rows, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("key"), F.col("row")], {"place": F.lit(1).cast("long")}, stored)
    rows = stored(rows.select("conv_id", "place", "key", "size"))
    first = rows.groupBy("conv_id").agg(F.min("place").alias("first"))
    return rows.join(first, "conv_id").select("conv_id", (F.col("place") - F.col("first") + 1).alias("place"), "key", "size")


def rebuilt(conversations: DataFrame, family: int = FAMILY, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, key, size) and (conv_id, n): each conversation c begins with the first h turns of c - c % family, where h is CRC-32 of c as text modulo shared.

    After these (all if fewer, none if there is no such conversation) come its
    own turns after its first h; it may have none.
    """
    own = stored(turns(conversations))
    many = stored(own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own_n")))
    base = many.select(F.col("conv_id").alias("base"), F.col("own_n").alias("base_n"))
    convs = many.withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(family))).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared)
    convs = convs.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0).cast("long"))))
    convs = stored(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own_n") - F.col("h"), F.lit(0).cast("long"))).alias("n")))
    head = own.where(F.col("place") < shared).withColumnRenamed("conv_id", "base")
    head = convs.where("taken > 0").join(head, "base").where("place <= taken").select("conv_id", F.col("place").alias("depth"), "key", "size")
    rest = own.join(convs, "conv_id").where("place > h").select("conv_id", (F.col("taken") + F.col("place") - F.col("h")).alias("depth"), "key", "size")
    return head.unionByName(rest), convs.select("conv_id", "n")


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, conv_id, part, ids), sorted, to (depth, conv_id, ends_sha256): the parts of a list are hashed as they come."""
    at, sha = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([sha.hexdigest()])], ["depth", "conv_id", "ends_sha256"])

    for batch in batches:
        done: list[pa.RecordBatch] = []
        for depth, conv, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
            if (depth, conv) != at:
                if at is not None:
                    done.append(row())
                at, sha = (depth, conv), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.as_py().encode())
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if at is not None:
        yield row()


def trie(steps: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    steps has (conv_id, depth from 1 without gaps, key, size), lengths (conv_id,
    n) all conversations, turnless ones too.  Conversations that agree in their
    first d keys share a node.  saved_tokens sums (n_convs - 1) * size over a
    subtree; ends_sha256 is of the ids, ascending and joined by commas, of the
    members that end there.  The root has depth 0 and no parent.  Without
    conversations there are no rows.

    A node that a third of all conversations share is sums by key, and the ids
    of its members that end there are joined in parts of at most 4096 each.
    """
    steps = stored(steps.repartitionByRange("depth", "conv_id").sortWithinPartitions("depth", "conv_id"))
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n")).first()
    live = stored(lengths.select("conv_id", F.lit(root["conv_id"]).cast("long").alias("node"), "n"))
    levels: list[DataFrame] = []
    ends = [live.where("n = 0").select(F.lit(0).cast("long").alias("depth"), "node", "conv_id")]
    while root["n"] > 1:
        depth = len(levels) + 1
        now = steps.where(F.col("depth") == depth).join(live, "conv_id")
        groups = now.groupBy("node", "key").agg(F.min("conv_id").alias("child"), F.count(F.lit(1)).alias("n_convs"), F.max("size").alias("size"), F.max("n").alias("n"))
        groups = stored(groups)
        if groups.isEmpty():
            break
        levels.append(groups)
        shared = groups.where("n_convs > 1").select("node", "key", F.col("child").alias("to"))
        live = stored(now.join(shared, ["node", "key"]).select("conv_id", F.col("to").alias("node"), "n"))
        ends.append(live.where(F.col("n") == depth).select(F.lit(depth).cast("long").alias("depth"), "node", "conv_id"))
        if live.isEmpty():
            break
    # One conversation in all is a chain from the root.
    heads = [g.where("n_convs = 1").select(F.col("child").alias("conv_id"), F.lit(d).cast("long").alias("head"), "n") for d, g in enumerate(levels, 1)]
    if root["n"] == 1:
        heads = [lengths.select("conv_id", F.lit(0).cast("long").alias("head"), "n")]
    none, no = F.lit(None).cast("string"), lambda v: F.lit(v).cast("long")
    nodes, below = [], None
    for depth in range(len(levels), -1, -1):
        if depth:
            own = levels[depth - 1].select(F.col("child").alias("conv_id"), F.col("node").alias("parent_conv_id"), "n_convs", "n", ((F.col("n_convs") - 1) * F.col("size")).alias("own"))
        else:
            own = lengths.groupBy().agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n").alias("n")).where("n_convs > 0").select("conv_id", no(None).alias("parent_conv_id"), "n_convs", "n", no(0).alias("own"))
        if below is not None:
            own = own.join(below, "conv_id", "left")
        else:
            own = own.select("*", *[no(None).alias(c) for c in ("children", "leaves", "saved")])
        alone = (F.col("n_convs") == 1) & (F.col("n") > depth)  # its only child begins the chain
        own = stored(own.select("conv_id", no(depth).alias("depth"), "parent_conv_id", "n_convs", F.when(alone, no(1)).otherwise(F.coalesce("children", no(0))).alias("n_children"), F.coalesce("leaves", no(1)).alias("n_leaves"), (F.col("own") + F.coalesce("saved", no(0))).alias("saved_tokens"), F.when((F.col("n_convs") == 1) & (F.col("n") == depth), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(none).alias("single")))
        nodes.append(own)
        below = own.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    if heads:
        chain = steps.join(functools.reduce(DataFrame.unionByName, heads), "conv_id").where("depth > head")
        last = F.col("depth") == F.col("n")
        nodes.append(chain.select("conv_id", F.col("depth").cast("long"), F.col("conv_id").alias("parent_conv_id"), no(1).alias("n_convs"), F.when(last, no(0)).otherwise(no(1)).alias("n_children"), no(1).alias("n_leaves"), no(0).alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(none).alias("single")))
    parts = functools.reduce(DataFrame.unionByName, ends).groupBy("depth", "node", F.floor(F.col("conv_id") / _PART).alias("part")).agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string"))).alias("ids"))
    hashes = parts.select("depth", F.col("node").alias("conv_id"), "part", "ids").repartition("depth", "conv_id").sortWithinPartitions("depth", "conv_id", "part").mapInArrow(_hashes, "depth long, conv_id long, ends_sha256 string")
    out = functools.reduce(DataFrame.unionByName, nodes).join(hashes, ["depth", "conv_id"], "left")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", "single", empty).alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(table(spark, sf_dir, "conversations")))


#: DuckDB has no CRC-32; here it is worked out bit by bit over the digits.
ORACLE = """
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
many AS (SELECT conv_id, count(*) AS own_n FROM own GROUP BY conv_id),
bits AS (
  SELECT conv_id, own_n, [4294967295::BIGINT] || flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [256::BIGINT + ascii(x), 0, 0, 0, 0, 0, 0, 0, 0])) AS todo
  FROM many),
crc AS (
  SELECT conv_id, own_n, conv_id - conv_id % 100 AS base,
         xor(list_reduce(todo, lambda a, x: CASE WHEN x >= 256 THEN xor(a, x - 256) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) % 6 AS h
  FROM bits),
convs AS (
  SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.own_n, 0)) AS taken
  FROM crc c LEFT JOIN many b ON b.conv_id = c.base),
turns AS (
  SELECT c.conv_id, o.place AS depth, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.place <= c.taken
  UNION ALL
  SELECT c.conv_id, c.taken + o.place - c.h, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.place > c.h),
prefixes AS (
  SELECT conv_id, depth, length(text) AS size,
         sha256(string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS prefix
  FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
lengths AS (SELECT conv_id, max(depth) AS n FROM prefixes GROUP BY conv_id),
nodes AS (
  SELECT p.depth, p.prefix, min(p.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(p.size) AS own,
         coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (l.n = p.depth), '') AS ends
  FROM prefixes p JOIN lengths l USING (conv_id) GROUP BY p.depth, p.prefix),
parents AS (
  SELECT n.*, q.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN prefixes u ON u.conv_id = n.conv_id AND u.depth = n.depth - 1
  LEFT JOIN nodes q ON q.depth = u.depth AND q.prefix = u.prefix),
children AS (SELECT depth - 1 AS depth, parent_conv_id AS conv_id, count(*) AS n_children FROM parents WHERE depth > 0 GROUP BY ALL),
subtree AS (
  SELECT u.depth, u.prefix, sum(n.own) AS saved_tokens, count(*) FILTER (c.n_children IS NULL) AS n_leaves
  FROM nodes n JOIN prefixes u ON u.conv_id = n.conv_id AND u.depth <= n.depth
  LEFT JOIN children c ON c.depth = n.depth AND c.conv_id = n.conv_id
  GROUP BY u.depth, u.prefix)
SELECT p.conv_id, p.depth::BIGINT AS depth, p.parent_conv_id, p.n_convs, coalesce(c.n_children, 0)::BIGINT AS n_children, s.n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, sha256(p.ends) AS ends_sha256
FROM parents p JOIN subtree s USING (depth, prefix) LEFT JOIN children c ON c.depth = p.depth AND c.conv_id = p.conv_id
"""
