"""Nested spans of files: innermost owners and what is counted within them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ORDER = ["file", "start", "_less", "uid"]


def owners(spans: DataFrame, owns: Column, written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds owner, the uid of the innermost span that owns each one, to spans (file, uid, start, end, ...); null at the top.

    A span is owned by the latest one before it, in order of start, falling end and uid, for which ``owns`` is true and
    that doesn't end earlier.  So of equal spans the first owns the next, and spans that cross own what is within them.
    (file, uid) should be distinct.  Spans with a null in file, uid, start or end, or that end before they start, have no
    owner and own nothing; an empty span is owned like others.

    Spans are dealt by ranges of that order and written, so a file of any size is split; each range is read once with a stack
    of spans whose ends fall, which is no longer than nesting is deep.  What is left open at the end of a range goes to
    the later ranges that begin in the same file before it ends.
    """
    names = [c for c in spans.columns if c != "owner"]
    whole = F.col("file").isNotNull() & F.col("uid").isNotNull() & F.coalesce(F.col("end") >= F.col("start"), F.lit(False))
    marked = written(spans.withColumns({"_owns": F.coalesce(owns, F.lit(False)) & whole, "_whole": whole}))
    good = marked.where("_whole").select("file", "uid", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "_owns").withColumn("_less", -F.col("end"))
    ranged = written(good.repartitionByRange(*_ORDER).withColumn("_range", F.spark_partition_id()))
    kind = {f.name: f.dataType.simpleString() for f in ranged.schema}

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The spans still open after each range's last one."""
        stack: list[tuple] = []
        now, schema = None, None
        for b in batches:
            schema = b.schema
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (row[0], row[1]) != now:
                    if now and now[0] != row[0]:
                        yield from made(stack, schema)
                    stack, now = [], (row[0], row[1])
                while stack and stack[-1][4] < row[4]:
                    stack.pop()
                stack.append(row)
        if schema is not None:
            yield from made(stack, schema)

    def made(stack: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if stack:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*stack, strict=True), schema, strict=True)], schema=schema)

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(file, uid, owner) of each range's own spans; those carried into it come first."""
        stack: list[tuple] = []  # (uid, end)
        now = None
        for b in batches:
            out: list[tuple] = []
            for n, file, start, uid, end, own, carried in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (n, file) != now:
                    stack, now = [], (n, file)
                # What ended before this start owns nothing more; what ends before an owner ends owns nothing that the owner doesn't.
                while stack and (stack[-1][1] < start or own and stack[-1][1] < end):
                    stack.pop()
                if not carried:
                    k = len(stack) - 1
                    while k >= 0 and stack[k][1] < end:
                        k -= 1
                    out.append((file, uid, stack[k][0] if k >= 0 else None))
                if own:
                    stack.append((uid, end))
            schema = pa.schema([("file", b.schema.field(1).type), ("uid", b.schema.field(3).type), ("owner", b.schema.field(3).type)])
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(schema)], schema=schema)

    columns = ["_range", "file", "start", "uid", "end"]
    owning = ranged.where("_owns")
    opened = written(owning.select(columns).repartition("_range").sortWithinPartitions("_range", "file", "start", F.desc("end"), "uid").mapInArrow(left, ", ".join(f"`{c}` {kind[c]}" for c in columns)))
    first = ranged.groupBy("_range").agg(F.min(F.struct("file", "start")).alias("f")).select(F.col("_range").alias("to"), F.col("f.file").alias("file"), F.col("f.start").alias("begin"))
    carried = opened.join(first, "file").where("to > _range and end >= begin").select(F.col("to").alias("_range"), "file", "start", "uid", "end", F.lit(True).alias("_owns"), F.lit(True).alias("_carried"))
    both = ranged.select(*columns, "_owns", F.lit(False).alias("_carried")).unionByName(carried)
    found = both.repartition("_range").sortWithinPartitions("_range", "file", "start", F.desc("end"), "uid").mapInArrow(swept, f"file {kind['file']}, uid {kind['uid']}, owner {kind['uid']}")
    return marked.select(names).join(found, ["file", "uid"], "left").select(*names, "owner")


def complexity(spans: DataFrame, written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(file, uid, complexity): 1 and the weights of the decisions whose innermost declaration it is.

    Of spans (file, uid, start, end, weight) those with a null weight are declarations.  A declaration within another
    one counts for itself only.
    """
    inner = owners(spans.select("file", "uid", "start", "end", "weight"), F.col("weight").isNull(), written)
    sums = inner.where("weight is not null and owner is not null").groupBy("file", F.col("owner").alias("uid")).agg(F.sum("weight").alias("n"))
    return spans.where("weight is null").select("file", "uid").join(sums, ["file", "uid"], "left").select("file", "uid", (1 + F.coalesce("n", F.lit(0))).cast("long").alias("complexity"))
