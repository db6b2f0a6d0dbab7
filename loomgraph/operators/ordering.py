"""Running sums and numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.sources.shared import tasks

#: So much of the stored input goes to one range, whatever the input's size, so that a task's sort stays small.
RANGE_MB = 2


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds, for each name in sums, the sum of its column (0 for null) over all rows before this one in the order.

    The rows are dealt by ranges of the order and written, so that a range has fixed rows; each range sums its own,
    and only one row of sums for each range is gathered.  Rows that tie in the order lie in one range, so ties should
    be few; their order is arbitrary.  No rows: no rows.
    """
    part, names, n_ranges = "_range", list(sums), tasks(df, RANGE_MB)
    ranged = written(df.repartitionByRange(n_ranges, *order).withColumn(part, F.spark_partition_id()))
    totals = ranged.groupBy(part).agg(*[F.sum(sums[n]).alias(n) for n in names])
    kinds = [(f.name, f.dataType) for f in totals.schema][1:]
    before, offsets = [0.0 if t.typeName() == "double" else 0 for _, t in kinds], []
    for row in sorted(totals.collect()):  # a row for each range
        offsets.append((row[0], *before))
        before = [a + (b or 0) for a, b in zip(before, row[1:], strict=True)]
    schema = f"{part} int, " + ", ".join(f"`_before_{n}` {t.simpleString()}" for n, t in kinds)
    starts = F.broadcast(df.sparkSession.createDataFrame(offsets, schema))
    earlier = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.repartition(n_ranges, part).join(starts, part)
    for n, t in kinds:
        out = out.withColumn(n, (F.col(f"_before_{n}") + F.coalesce(F.sum(sums[n]).over(earlier), F.lit(0))).cast(t))
    return out.drop(part, *[f"_before_{n}" for n in names])


def numbered(df: DataFrame, order: list[Column], name: str, written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds the place of each row in the order, from 0."""
    return running(df, order, {name: F.lit(1).cast("long")}, written)
