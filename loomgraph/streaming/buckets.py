"""Keyed state in a fixed number of hash buckets: a batch is joined with the buckets that it touches, and only these are written.

The rows of a bucket are the folder ``rows/bucket=<b>``, replaced by dynamic partition overwrite.  What replaces it is
first written to ``staged/<id>``, and the file ``pending/<id>`` says that it is whole; a run that ends in between is
carried out when the state is opened again, so neither old nor new rows are lost.  One writer at a time, as a stream has.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from loomgraph.sources.shared import written


class Buckets:
    """State of one row for each key, or (with replace) of all rows of each path, below a folder that driver and executors share.

    The number of buckets belongs to the layout: the state must be opened with that it was made with.  It bounds what
    a batch of one key costs (one bucket); a bucket's rows go to ``files`` tasks and files, by ``spread`` (else the key).
    """

    def __init__(self, spark: SparkSession, root: str, key: str, revision: str, schema: StructType | str, buckets: int = 64, files: int = 1, spread: str | None = None) -> None:
        self.spark, self.root, self.key, self.revision, self.buckets, self.files, self.spread = spark, root, key, revision, buckets, files, spread or key
        kind = spark.createDataFrame([], schema).schema
        if key not in kind.names or revision not in kind.names or "bucket" in kind.names:
            raise ValueError("the schema must have key and revision, and no column bucket")
        self.columns, self.schema = kind.names, StructType([*kind.fields, StructField("bucket", IntegerType())])
        self._path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        self._fs = self._path("rows").getFileSystem(spark._jsc.hadoopConfiguration())
        layout = f"{key} {revision} {buckets}"
        self._fs.mkdirs(self._path("layout"))
        found = [x.getPath().getName() for x in self._fs.listStatus(self._path("layout"))]
        if not found:
            self._fs.mkdirs(self._path(f"layout/{layout}"))
        elif found != [layout]:
            raise ValueError(f"the state has the layout (key, revision, buckets) {found[0]}, not {layout}")
        self._fs.mkdirs(self._path("rows"))
        self._fs.mkdirs(self._path("pending"))
        for x in self._fs.listStatus(self._path("pending")):
            self._apply(x.getPath().getName())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _stored(self, of: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(f"{self.root}/rows")
        return rows if of is None else rows.where(F.col("bucket").isin(of))

    def read(self) -> DataFrame:
        return self._stored().select(self.columns)

    def _apply(self, name: str) -> None:
        """Puts staged buckets in place; doing so again changes nothing."""
        staged = self.spark.read.schema(self.schema).parquet(f"{self.root}/staged/{name}")
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.root}/rows")
        self._fs.delete(self._path(f"pending/{name}"), False)
        self._fs.delete(self._path(f"staged/{name}"), True)

    def _put(self, merged: DataFrame) -> None:
        name = uuid.uuid4().hex
        spread = F.pmod(F.xxhash64(self.spread, F.lit("file")), F.lit(self.files))
        merged.select(*self.columns, "bucket").repartition("bucket", spread).write.parquet(f"{self.root}/staged/{name}")
        self._fs.create(self._path(f"pending/{name}"), True).close()
        self._apply(name)

    def _touched(self, fresh: DataFrame) -> list[int]:
        return [r[0] for r in fresh.select("bucket").distinct().collect()]  # as many as there are buckets at most

    def newest(self, batch: DataFrame) -> DataFrame:
        """Of the rows of a key that with the greatest revision, of these the smallest values; a key with very many rows is aggregated where they lie."""
        rest = [c for c in self.columns if c not in (self.key, self.revision)]
        by = batch.where(F.col(self.key).isNotNull() & F.col(self.revision).isNotNull()).groupBy(self.key, self.revision).agg(F.min(F.struct(F.lit(0).alias("_"), *rest)).alias("_row"))
        top = by.groupBy(self.key).agg(F.max(F.struct(self.revision, "_row")).alias("_top"))
        return top.select(self.key, F.col(f"_top.{self.revision}").alias(self.revision), *[F.col(f"_top._row.{c}").alias(c) for c in rest]).select(self.columns)

    def upsert(self, batch: DataFrame) -> int:
        """Takes the newest row of each key of the batch unless the state has that revision or a later one; the number of buckets written.

        Rows without key or revision are left out.  A batch that brings nothing new writes nothing, so one that is
        sent twice changes nothing.
        """
        news = written(self.newest(batch.select(self.columns)).withColumn("bucket", self._bucket()))
        old = self._stored(self._touched(news))
        have = old.select("bucket", self.key, F.col(self.revision).alias("_have"))
        fresh = written(news.join(have, ["bucket", self.key], "left").where(F.col("_have").isNull() | (F.col(self.revision) > F.col("_have"))).drop("_have"))
        own = self._touched(fresh)
        if own:
            self.put(fresh, own, self._stored(own))
        return len(own)

    def put(self, fresh: DataFrame, own: list[int], stored: DataFrame) -> None:
        """Writes stored buckets anew with rows that are known to be newer, one for each key, with their bucket; own are these buckets."""
        kept = stored.where(F.col("bucket").isin(own)).join(fresh.select("bucket", self.key), ["bucket", self.key], "left_anti")
        self._put(kept.unionByName(fresh))

    def replace(self, rows: DataFrame, paths: DataFrame) -> int:
        """Replaces all rows of paths (key, revision) by rows, which have both columns too; the number of buckets written.

        A path whose revision the state has reached is left alone.  One without rows is deleted: it leaves one row with
        its key and revision and nulls, as the fence for later deltas.
        """
        own = written(paths.groupBy(self.key).agg(F.max(self.revision).alias(self.revision)).withColumn("bucket", self._bucket()))
        have = self._stored(self._touched(own)).groupBy("bucket", self.key).agg(F.max(self.revision).alias("_have"))
        fresh = written(own.join(have, ["bucket", self.key], "left").where(F.col("_have").isNull() | (F.col(self.revision) > F.col("_have"))).drop("_have"))
        touched = self._touched(fresh)
        if touched:
            new = rows.select(self.columns).withColumn("bucket", self._bucket()).join(fresh.select("bucket", self.key, self.revision), ["bucket", self.key, self.revision], "left_semi")
            new = written(new)
            marks = fresh.join(new.select("bucket", self.key), ["bucket", self.key], "left_anti")
            kept = self._stored(touched).join(fresh.select("bucket", self.key), ["bucket", self.key], "left_anti")
            self._put(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [kept, new, marks]))
        return len(touched)
