"""Scans: tables, node shards with missing columns, compressed adjacency, text lines, manifests; and their sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomgraph.operators.ordering import numbered, running
from loomgraph.sources.shared import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_shards(shards: list[tuple[DataFrame, int]], key: str) -> DataFrame:
    """Shards (frame, row_base) as one node table with column row; a column that a shard lacks is NULL in its rows.

    Rows of a shard are numbered by key, so the address does not depend on how it was read.
    """
    out = None
    for df, base in shards:
        one = numbered(df, [F.col(key)], "row", written).withColumn("row", F.col("row") + base)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def csr_ranges(indptr: DataFrame) -> DataFrame:
    """(row, ptr) to (source, begin, end): the adjacency range of each source."""
    placed = written(numbered(indptr, [F.col("row")], "place", written))
    after = placed.select((F.col("place") - 1).alias("place"), F.col("ptr").alias("end"))
    return placed.join(after, "place").select(F.col("row").alias("source"), F.col("ptr").alias("begin"), "end")


def csr_edges(indptr: DataFrame, indices: DataFrame) -> DataFrame:
    """Expands pointers and (position, target, uid) to (source, target, uid)."""
    spread = csr_ranges(indptr).where("end > begin").select("source", F.explode(F.sequence(F.col("begin"), F.col("end") - 1)).alias("position"))
    return spread.join(indices, "position").select("source", "target", "uid")


def csr_write(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, target, uid) and the rows of all sources to (indptr, indices), sorted by source and uid."""
    counts = nodes.select("row").join(edges.groupBy(F.col("source").alias("row")).agg(F.count(F.lit(1)).alias("n")), "row", "left")
    indptr = written(running(counts, [F.col("row")], {"ptr": F.coalesce("n", F.lit(0))}, written).select("row", "ptr"))
    total = counts.agg((F.max("row") + 1).alias("row"), F.sum(F.coalesce("n", F.lit(0))).alias("ptr"))
    # In this order the place of an edge in the whole is its position, so a source of any degree is split.
    known = edges.join(nodes.select(F.col("row").alias("source")), "source", "left_semi")
    indices = numbered(known, [F.col("source"), F.col("uid"), F.col("target")], "position", written).select("position", "target", "uid")
    return indptr.unionByName(total), indices


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_number from 1, line): a text of n line breaks has n + 1 lines, but no empty last one."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n", "\n"), "\n")
    return docs.select(key, F.posexplode(parts).alias("i", "line"), F.size(parts).alias("n")).where("not (line = '' and i = n - 1)").select(key, (F.col("i") + 1).alias("line_number"), "line")


def empty(spark: SparkSession, schema: StructType, path: str) -> None:
    """An empty shard that keeps its schema."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def manifest(text: str) -> dict:
    """Reads and validates a graph manifest; ValueError says what is wrong."""
    m = json.loads(text)
    if m.get("version") != 3:
        raise ValueError("version must be 3")
    labels = [t["label"] for t in m["nodes"]]
    if len(set(labels)) != len(labels):
        raise ValueError("labels must be unique")
    files = [s["file"] for t in m["nodes"] for s in t["shards"]]
    if len(set(files)) != len(files):
        raise ValueError("files must be unique")
    for t in m["nodes"]:
        kinds = {c["name"]: c["type"] for c in t["columns"]}
        if not set(kinds.values()) <= {"STRING", "INT64", "BOOL"}:
            raise ValueError(f"{t['label']}: columns are STRING, INT64 or BOOL")
        if t["primary_key"] not in kinds:
            raise ValueError(f"{t['label']}: no such primary key")
        end = 0
        for s in sorted(t["shards"], key=lambda s: s["row_base"]):
            if s["row_base"] < end:
                raise ValueError(f"{t['label']}: shards overlap")
            end = s["row_base"] + s["rows"]
        if sum(s["rows"] for s in t["shards"]) != t["rows"]:
            raise ValueError(f"{t['label']}: rows do not add up")
    for e in m["edges"]:
        if e["from"] not in labels or e["to"] not in labels:
            raise ValueError(f"{e['kind']}: unknown end")
    return m
