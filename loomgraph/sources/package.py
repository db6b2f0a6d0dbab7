"""Graph packages: node shards by file, edges by row, and a manifest that is written last."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomgraph.operators.ordering import numbered
from loomgraph.sources.shared import written

VERSION = 3  # fixed value: the version of manifests


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_package(spark: SparkSession, root: str, nodes: dict[str, tuple[DataFrame, str]], edges: dict[str, tuple[str, str, DataFrame]]) -> Package:
    """Writes nodes {label: (frame with a column file, key)} and edges {kind: (from, to, (source, target, uid) by key)} below a new folder.

    A label's rows are numbered by file and key, so the rows of a file follow each other; a file may be of any size.  Keys should be
    distinct and not null within a label; edges whose ends aren't there are refused.  A label without rows has an empty shard
    with its columns.  What has no manifest is no package: a writer that breaks off leaves none.
    """
    path, fs = _path(spark, f"{root}/manifest.json")
    if fs.exists(path):
        raise ValueError(f"{root} holds a package")
    about: dict = {"version": VERSION, "nodes": {}, "edges": {}}
    rows_of, shards = {}, None
    for label, (df, key) in nodes.items():
        if "row" in df.columns:
            raise ValueError(f"{label}: row is the package's own column")
        one = written(numbered(df, [F.col("file"), F.col(key)], "row", written))
        kept = one.repartitionByRange("file", "row").sortWithinPartitions("file", "row")
        kept.write.partitionBy("file").parquet(f"{root}/nodes/{label}")
        own = one.groupBy("file").agg(F.min("row").alias("row_base"), F.count(F.lit(1)).alias("rows")).select(F.lit(label).alias("label"), "file", "row_base", "rows")
        shards = own if shards is None else shards.unionByName(own)
        schema = StructType([f for f in one.schema if f.name != "file"])
        total = one.count()
        if not total:
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{root}/nodes/{label}/file=__HIVE_DEFAULT_PARTITION__")
        rows_of[label] = one.select(F.col(key).alias("_key"), "row")
        about["nodes"][label] = {"primary_key": key, "rows": total, "schema": json.loads(one.schema.json())}
    for kind, (start, end, df) in edges.items():
        by = lambda label, name: rows_of[label].select(F.col("_key").alias(name), F.col("row").alias(f"{name}_row"))
        one = written(df.select("source", "target", "uid").join(by(start, "source"), "source", "left").join(by(end, "target"), "target", "left").select(F.col("source_row").alias("source"), F.col("target_row").alias("target"), "uid"))
        lost = one.where("source is null or target is null").count()
        if lost:
            raise ValueError(f"{kind}: {lost} edges have an end that is not there")
        one.repartitionByRange("source", "uid").sortWithinPartitions("source", "uid").write.parquet(f"{root}/edges/{kind}")
        about["edges"][kind] = {"from": start, "to": end, "rows": one.count()}
    if shards is not None:
        shards.repartitionByRange("label", "file").sortWithinPartitions("label", "row_base").write.parquet(f"{root}/shards")
    about["node_total"] = sum(n["rows"] for n in about["nodes"].values())
    about["edge_total"] = sum(e["rows"] for e in about["edges"].values())
    draft, _ = _path(spark, f"{root}/.manifest.json")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(about, sort_keys=True).encode()))
    out.close()
    if not fs.rename(draft, path):
        raise ValueError(f"{root} holds a package")
    return Package(spark, root)


class Package:
    """A package by its manifest; ValueError says what is wrong with that."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        path, fs = _path(spark, f"{root}/manifest.json")
        if not fs.exists(path):
            raise ValueError(f"{root} holds no package")
        about = json.loads("\n".join(r[0] for r in spark.read.text(f"{root}/manifest.json", wholetext=True).collect()))  # one row: labels and kinds
        self.about = checked(about)

    def shards(self) -> DataFrame:
        """(label, file, row_base, rows)."""
        schema = "label string, file string, row_base long, rows long"
        return self.spark.read.schema(schema).parquet(f"{self.root}/shards") if self.about["nodes"] else self.spark.createDataFrame([], schema)

    def nodes(self, label: str, files: Iterable[str] | None = None) -> DataFrame:
        """The rows of a label, of some files only if these are named: then no other file is opened."""
        schema = StructType.fromJson(self.about["nodes"][label]["schema"])
        df = self.spark.read.schema(schema).parquet(f"{self.root}/nodes/{label}").where("row is not null").select(schema.names)
        return df if files is None else df.where(F.col("file").isin(*files))

    def edges(self, kind: str) -> DataFrame:
        """(source, target, uid), ends as keys."""
        e = self.about["edges"][kind]
        end = lambda label, name: self.nodes(label).select(F.col(self.about["nodes"][label]["primary_key"]).alias(f"_{name}"), F.col("row").alias(name))
        rows = self.rows(kind).join(end(e["from"], "source"), "source").join(end(e["to"], "target"), "target")
        return rows.select(F.col("_source").alias("source"), F.col("_target").alias("target"), "uid")

    def rows(self, kind: str) -> DataFrame:
        """(source, target, uid), ends as rows."""
        return self.spark.read.schema("source long, target long, uid string").parquet(f"{self.root}/edges/{kind}")

    def faults(self) -> DataFrame:
        """(part, fault): where what is stored isn't what manifest and shards say; none if the package is whole."""
        out = self.spark.createDataFrame([], "part string, fault string")
        say = lambda df, part, fault: df.select(F.lit(part).alias("part") if isinstance(part, str) else part.alias("part"), F.lit(fault).alias("fault"))
        for label, n in self.about["nodes"].items():
            own = self.shards().where(F.col("label") == label)
            held = self.nodes(label).groupBy("file").agg(F.min("row").alias("low"), F.max("row").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("row").alias("s"))
            met = own.join(held, own["file"].eqNullSafe(held["file"]), "full")
            # As many rows as said, from row_base on, and each once by their sum.
            right = (F.col("low") == F.col("row_base")) & (F.col("n") == F.col("rows")) & (F.col("high") == F.col("row_base") + F.col("rows") - 1) & (F.col("s") == F.col("n") * (F.col("low") + F.col("high")) / 2)
            out = out.unionByName(say(met.where(~F.coalesce(right, F.lit(False))), F.concat(F.lit(f"{label}/"), F.coalesce(own["file"], held["file"], F.lit(""))), "the rows of the shard differ"))
            out = out.unionByName(say(own.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), F.coalesce(F.max(F.col("row_base") + F.col("rows")), F.lit(0)).alias("top")).where((F.col("n") != n["rows"]) | (F.col("top") != n["rows"])), label, "shards do not add up"))
            again = self.nodes(label).groupBy(n["primary_key"]).agg(F.count(F.lit(1)).alias("_n")).where(F.col(n["primary_key"]).isNull() | (F.col("_n") > 1))
            out = out.unionByName(say(again.agg(F.count(F.lit(1)).alias("_n")).where("_n > 0"), label, "keys are null or repeated"))
        for kind, e in self.about["edges"].items():
            tops = [self.about["nodes"][e[x]]["rows"] for x in ("from", "to")]
            inside = F.col("source").between(0, tops[0] - 1) & F.col("target").between(0, tops[1] - 1)
            seen = self.rows(kind).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(inside, F.lit(False))).alias("lost"))
            out = out.unionByName(say(seen.where(F.col("n") != e["rows"]), kind, "edges do not add up")).unionByName(say(seen.where("lost > 0"), kind, "ends are not there"))
        return out


def checked(about: dict) -> dict:
    """The manifest, if its totals, labels and keys fit together."""
    if about.get("version") != VERSION:
        raise ValueError(f"version must be {VERSION}")
    for label, n in about["nodes"].items():
        names = [f["name"] for f in n["schema"]["fields"]]
        if n["primary_key"] not in names or not {"file", "row"} <= set(names):
            raise ValueError(f"{label}: primary key, file and row must be columns")
    for kind, e in about["edges"].items():
        if e["from"] not in about["nodes"] or e["to"] not in about["nodes"]:
            raise ValueError(f"{kind}: unknown end")
    for part in ("node", "edge"):
        rows = [x["rows"] for x in about[f"{part}s"].values()]
        if min(rows, default=0) < 0 or sum(rows) != about[f"{part}_total"]:
            raise ValueError(f"{part}_total does not add up")
    return about
