"""Compressed adjacency that follows its files: a delta rewrites the ranges of sources that have an edge of it.

Sources are cut into ranges of ``span`` rows, and a range holds its edges with places of its own, from 0 in order of
source and uid.  The position of an edge in the whole adjacency is its range's base, the number of edges in all ranges
before, and its place; so a delta that changes one range moves the others by their bases only, and their files stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.ordering import numbered, running
from loomgraph.sources.shared import written
from loomgraph.streaming.buckets import Buckets


class _Ranges(Buckets):
    """Buckets that are ranges of sources."""

    def _bucket(self) -> Column:
        return F.floor(F.col(self.key) / self.buckets).cast("int")


class Adjacency:
    """The edges of published files, below a folder that driver and executors share; one writer at a time."""

    def __init__(self, spark: SparkSession, root: str, span: int = 1 << 20, files: int = 1) -> None:
        self.edges = _Ranges(spark, f"{root}/edges", "source", "revision", "source long, place long, target long, uid string, file string, revision long", span, files, "uid")
        self.files = Buckets(spark, f"{root}/files", "file", "revision", "file string, revision long, range int")

    def publish(self, edges: DataFrame, files: DataFrame) -> int:
        """Replaces the edges (source, target, uid, file, revision) of files (file, revision); the number of ranges written.

        A file without edges is taken out.  A delta that is late or was taken before changes nothing.  Edges of files
        that are not named, or of another revision, are left out.  The edges go first, then what ranges a file has: if
        that is lost, the delta is still new when it is sent again, and gives the same edges.
        """
        known = self.files.read().groupBy("file").agg(F.max("revision").alias("_have"))
        news = files.groupBy("file").agg(F.max("revision").alias("revision"))
        fresh = written(news.join(known, "file", "left").where(F.col("_have").isNull() | (F.col("revision") > F.col("_have"))).select("file", "revision"))
        new = written(edges.select("source", "target", "uid", "file", "revision").join(fresh, ["file", "revision"], "left_semi").withColumn("bucket", self.edges._bucket()))
        before = self.files.read().join(fresh, "file", "left_semi").where("range is not null").select(F.col("range").alias("bucket"))
        touched = self.edges._touched(before.union(new.select("bucket")))  # a row for each range at most
        if touched:
            kept = self.edges._stored(touched).where("source is not null").join(fresh, "file", "left_anti").drop("place")
            merged = numbered(kept.unionByName(new), [F.col("bucket"), F.col("source"), F.col("uid"), F.col("target")], "place", written)
            merged = written(merged)
            first = merged.groupBy("bucket").agg(F.min("place").alias("_first"))
            placed = merged.join(first, "bucket").withColumn("place", F.col("place") - F.col("_first")).drop("_first")
            left = merged.sparkSession.createDataFrame([(b,) for b in touched], "bucket int").join(merged, "bucket", "left_anti")  # an empty range keeps one row of nulls
            self.edges._put(placed.unionByName(left, allowMissingColumns=True))
        self.files.replace(new.select("file", "revision", F.col("bucket").alias("range")).distinct(), fresh)
        return len(touched)

    def indices(self) -> DataFrame:
        """(position, source, target, uid), in order of source and uid."""
        rows = self.edges._stored().where("source is not null")
        counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
        bases = running(counts, [F.col("bucket")], {"base": F.col("n")}, written).select("bucket", "base")
        return rows.join(bases, "bucket").select((F.col("base") + F.col("place")).alias("position"), "source", "target", "uid")

    def pointers(self, nodes: DataFrame) -> DataFrame:
        """(row, ptr) of nodes (row): where the edges of each begin."""
        degree = self.edges._stored().where("source is not null").groupBy(F.col("source").alias("row")).agg(F.count(F.lit(1)).alias("n"))
        return running(nodes.select("row").join(degree, "row", "left"), [F.col("row")], {"ptr": F.coalesce("n", F.lit(0).cast("long"))}, written).select("row", "ptr")
