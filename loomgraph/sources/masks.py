"""Semi-masks: selected rows of a node table as bitmaps, which decide what is read of its shards.

A node table is a folder of shards, ``shard=<k>``, each sorted by row in its own numbers from 0; the manifest
``shards`` has (shard, row_base, rows).  A mask has one bitmap of 32,768 rows for each stretch of the whole table that
holds selected rows.  Rebased to its shards, it gives ranges of rows: shards without any are not opened, row groups
outside of all ranges are skipped by their statistics, and of what is read the bitmap says which rows stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.ordering import numbered
from loomgraph.sources.shared import written

#: Rows of one bitmap (a fixed value of Spark's bitmap functions), and so many ranges at most go into the filter of a scan.
STRETCH, RANGES = 32768, 256


def write_shards(nodes: DataFrame, key: str, path: str, rows: int, group_bytes: int = 8 << 20) -> None:
    """Nodes in order of key, ``rows`` to a shard; row groups of about group_bytes."""
    placed = written(numbered(nodes, [F.col(key)], "_place", written))
    out = placed.select(F.floor(F.col("_place") / rows).alias("shard"), (F.col("_place") % rows).alias("row"), *nodes.columns)
    out.repartition("shard").sortWithinPartitions("shard", "row").write.option("parquet.block.size", group_bytes).option("parquet.page.size.row.check.min", 100).option("parquet.block.size.row.check.min", 100).partitionBy("shard").parquet(f"{path}/data")
    placed.groupBy(F.floor(F.col("_place") / rows).alias("shard")).agg(F.min("_place").alias("row_base"), F.count(F.lit(1)).alias("rows")).write.parquet(f"{path}/shards")


def mask(selected: DataFrame) -> DataFrame:
    """(stretch, bits, low, high, n) of the rows (row, of the whole table) selected; repeated ones count once, null ones not at all."""
    row = F.col("row")
    return selected.where(row.isNotNull()).groupBy(F.floor(row / STRETCH).alias("stretch")).agg(F.bitmap_construct_agg((row % STRETCH).cast("long")).alias("bits"), F.min(row).alias("low"), F.max(row).alias("high")).withColumn("n", F.bitmap_count("bits"))


def holds(bits: Column, position: Column) -> Column:
    """Whether a bitmap has a position."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte.cast("long"), (position % 8).cast("int")) == 1


def _ranges(spark: SparkSession, path: str, own: DataFrame) -> list[tuple[int, int, int]]:
    """(shard, first, last) in the shard's numbers of stretches that hold rows; neighbours are joined over the smallest gaps until there are RANGES."""
    shards = spark.read.parquet(f"{path}/shards")
    met = own.join(shards, (F.col("low") < F.col("row_base") + F.col("rows")) & (F.col("high") >= F.col("row_base")))
    first, last = F.greatest(F.col("low") - F.col("row_base"), F.lit(0)), F.least(F.col("high") - F.col("row_base"), F.col("rows") - 1)
    met = met.select("shard", first.alias("first"), last.alias("last"))
    found: list[list[int]] = []
    for shard, a, b in met.orderBy("shard", "first").toLocalIterator():  # a row for each 32,768 rows of the table; held are RANGES
        found.append([shard, a, b])
        if len(found) > 2 * RANGES:
            found = _joined(found)
    return [tuple(x) for x in _joined(found)]


def _joined(found: list[list[int]]) -> list[list[int]]:
    """At most RANGES ranges: of one shard those with the smallest gaps become one; if there are more shards than that, neighbours' ranges stay as they are."""
    gaps = sorted((found[i + 1][1] - found[i][2], i) for i in range(len(found) - 1) if found[i][0] == found[i + 1][0])
    close = {i for _, i in gaps[: max(0, len(found) - RANGES)]}
    out: list[list[int]] = []
    for i, (shard, a, b) in enumerate(found):
        if i and i - 1 in close:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([shard, a, b])
    return out


def read_masked(spark: SparkSession, path: str, selected: DataFrame) -> DataFrame:
    """The nodes whose rows are selected (row), with all columns and row as it is in the whole table."""
    own = written(mask(selected))
    shards = spark.read.parquet(f"{path}/shards")
    data = spark.read.parquet(f"{path}/data")
    near = F.lit(False)
    for shard, a, b in _ranges(spark, path, own):
        near |= (F.col("shard") == shard) & F.col("row").between(a, b)
    rows = data.where(near).join(shards.select("shard", "row_base"), "shard").withColumn("row", F.col("row_base") + F.col("row")).drop("row_base")
    out = rows.withColumn("_s", F.floor(F.col("row") / STRETCH)).join(own.select(F.col("stretch").alias("_s"), "bits"), "_s")
    return out.where(holds(F.col("bits"), F.col("row") % STRETCH)).drop("_s", "bits", "shard")
