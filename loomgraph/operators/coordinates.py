"""Ranges of a prepared text traced back to the original, by as-of lookups instead of range joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.ordering import RANGE_MB, numbered
from loomgraph.sources.shared import tasks


def latest(points: DataFrame, group: str, order: list[str], value: Column, name: str, written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds, under name, the last value that isn't null of the rows up to this one in the order, within its group.

    The rows are dealt by ranges of group and order and written, so a group of any size is split; a range takes what it lacks
    at its start from the last value of an earlier range, of which there is one row each.  Null groups and orders are left out.
    """
    keys, n_ranges = [group, *order], tasks(points, RANGE_MB)
    ranged = written(points.withColumn(name, value).dropna(subset=keys).repartitionByRange(n_ranges, *keys).withColumn("_range", F.spark_partition_id()))
    last = ranged.where(F.col(name).isNotNull()).groupBy("_range").agg(F.max_by(F.struct(group, name), F.struct(*keys)).alias("v")).select(F.col("_range").alias("_from"), F.col(f"v.{group}").alias(group), F.col(f"v.{name}").alias("_v"))
    first = ranged.groupBy("_range").agg(F.min(group).alias(group))
    before = first.join(last, group).where("_from < _range").groupBy("_range", group).agg(F.max_by("_v", "_from").alias("_before"))
    upto = Window.partitionBy("_range", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.repartition(n_ranges, "_range").withColumn(name, F.last(name, ignorenulls=True).over(upto))
    return own.join(F.broadcast(before), ["_range", group], "left").withColumn(name, F.coalesce(name, "_before")).drop("_range", "_before")  # at most a row for each range


def project(segments: DataFrame, ranges: DataFrame, written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(file, id, state, original_start, original_end, pieces) for ranges (file, id, start, end) of prepared texts.

    Segments (file, start, end, kind, original_start, original_end) are the prepared text cut into parts without gaps,
    overlaps or empty parts: Direct ones were taken over as they are, an Atom stands as a whole for something else in the
    original, Synthetic ones were made up.  (file, id) should be distinct.

    A range that lies in one segment is Exact, with its place in the original (of an Atom, if it is the whole one; else Unmappable),
    or Synthetic.  One over several is Compound: pieces says how many, and its start and end are those of the first
    and last piece, null if these have none.  An empty range is Exact within a Direct segment; between two its candidates are
    the end of what was before and the start of what comes next: one is Exact, two that differ are Ambiguous (start and end
    are then the two, in that order), none is Unmappable; within an Atom or made-up text it is Unmappable.
    Ranges that leave the text, end before they start or have nulls are Invalid.
    """
    known = numbered(segments.dropna(subset=["file", "start"]), [F.col("file"), F.col("start")], "n", written)
    part = F.struct("n", "start", "end", "kind", "original_start", "original_end")
    turn = lambda x, k: F.struct(x.cast("long").alias("at"), F.lit(k).alias("turn"))
    ranges = written(ranges.select("file", "id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))
    asked = ranges.where("end >= start").select("file", "id", F.explode(F.array(turn(F.col("start"), 1), turn(F.col("end") - 1, 2))).alias("t")).select("file", "id", "t.at", "t.turn", F.lit(None).cast(known.select(part.alias("p")).schema["p"].dataType).alias("part"))
    marks = known.select("file", F.lit(None).cast(ranges.schema["id"].dataType).alias("id"), F.col("start").cast("long").alias("at"), F.lit(0).alias("turn"), part.alias("part"))
    found = latest(marks.unionByName(asked), "file", ["at", "turn"], F.col("part"), "seg", written).where("turn > 0 and at < seg.end")
    both = found.groupBy("file", "id").agg(F.any_value(F.when(F.col("turn") == 1, F.col("seg")), True).alias("a"), F.any_value(F.when(F.col("turn") == 2, F.col("seg")), True).alias("b"))
    all_ = ranges.join(both, ["file", "id"], "left")
    a, b, start, end, null = F.col("a"), F.col("b"), F.col("start"), F.col("end"), F.lit(None).cast("long")
    kind, same = a["kind"], a["n"] == b["n"]
    # A range that isn't empty: the first and the last piece's places.
    whole = lambda p, edge: F.when(p["kind"] == "Direct", edge).when((p["kind"] == "Atom") & (start <= p["start"]) & (end >= p["end"]), F.when(edge.isNotNull(), p["original_start"] if p is a else p["original_end"]))
    low = whole(a, a["original_start"] + start - a["start"])
    high = whole(b, b["original_start"] + end - b["start"])
    # An empty one: what is on its left (b, which holds the place before) and on its right (a).
    inside = same & (kind == "Direct")
    left, right = F.when(b["kind"] != "Synthetic", b["original_end"]), F.when(kind != "Synthetic", a["original_start"])
    point = F.when(inside, a["original_start"] + start - a["start"]).when(F.coalesce(same, F.lit(False)), null)
    one, two = F.when(F.coalesce(same, F.lit(False)), point).otherwise(F.coalesce(left, right)), F.when(F.coalesce(same, F.lit(False)), point).otherwise(F.coalesce(right, left))
    empty = start == end
    valid = F.coalesce(F.when(empty, a.isNotNull() | b.isNotNull()).otherwise((end > start) & a.isNotNull() & b.isNotNull()), F.lit(False))
    state = (
        F.when(~valid, "Invalid")
        .when(empty, F.when(one.isNull(), "Unmappable").when(one == two, "Exact").otherwise("Ambiguous"))
        .when(~same, "Compound")
        .when(kind == "Synthetic", "Synthetic")
        .when(low.isNull(), "Unmappable")
        .otherwise("Exact")
    )
    pieces = F.when(valid, F.when(empty, 0).otherwise(b["n"] - a["n"] + 1)).cast("long")
    return all_.select("file", "id", state.alias("state"), F.when(valid, F.when(empty, one).otherwise(low)).cast("long").alias("original_start"), F.when(valid, F.when(empty, two).otherwise(high)).cast("long").alias("original_end"), pieces.alias("pieces"))
