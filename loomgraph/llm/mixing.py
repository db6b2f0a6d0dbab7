"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time t in [0, 1]: rates at knots
that are equally far apart, linear between them.  Its integral D(t), made to reach
the source's target at t = 1, is the cumulative token demand of the source.  The
documents of a source are laid end to end in a fixed pseudo-random order, pass
after pass; a copy that begins after c tokens trains at t = D^-1(c).  Range-sorting
all copies by t gives the training order, in which every prefix holds the sources
in the proportions of their schedules so far.

How many copies: all documents are taken floor(target / source size) times, and
the rest of the target is filled by one more copy of the first documents in that
order.  The order has buckets of about a thousand documents by hash; whole buckets
are taken until one does not fit, and in that one documents are taken from large
to small where they still fit.  So each source comes within the smallest document
left over in that bucket, and no text is cut.

Rows that repeat an id, a source and a size are one entry with a count until the
end, so a row that fills a third of the table is still one entry of a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import stored, table
from loomgraph.operators.ordering import numbered, running

WEIGHTS = (5, 2, 1)
#: Rates of the sources' schedules at t = 0 and t = 1, taken in turn like the weights: the heavy ones early, the light ones late.
SCHEDULES = ((1.6, 0.4), (1.0, 1.0), (0.4, 1.6))
#: So many buckets of a source are summed together, and then these sums.
_BUCKETS = 4096
#: An entry that stands for more rows than this is split before it is counted out.
_STRETCH = 1000


def word_count(text: Column) -> Column:
    r"""The number of ``[^\x20\x09-\x0D]+`` in a text; null: 0. Counts the ends of words, without making them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds target and turn (the source's place by code point, from 0) to (source, source_size): share of all sizes, dealt by weight and stopped at cap times a source's size.

    The excess is dealt again by weight until no source is above its cap: the
    largest level x for which the sum of min(cap * size, x * weight) is the
    whole.  Sources are dealt by ranges, so there may be any number of them.
    """
    null = F.col("source").isNull()
    w = running(sizes.select("source", "source_size"), [null, F.col("source")], {"turn": F.lit(1).cast("long")}, stored)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int")).cast("double")
    w = w.withColumn("weight", weight).withColumn("most", cap * F.col("source_size")).withColumn("at", F.col("most") / F.col("weight"))
    w = stored(running(w, [F.col("at"), null, F.col("source")], {"below": F.col("most"), "lighter": F.col("weight")}, stored))
    whole = w.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (share * F.lit(float(whole["size"] or 0)) - F.col("below")) / (F.lit(whole["weight"] or 1.0) - F.col("lighter"))
    first = w.withColumn("level", level).where("level <= at").agg(F.min(F.struct("at", null.alias("none"), "source", "level")).alias("f")).first()["f"]
    target = F.col("most") if first is None else F.least("most", F.lit(first["level"]) * F.col("weight"))
    return w.select("source", "source_size", target.alias("target"), "turn")


def _time(offset: Column, target: Column, turn: Column, schedules: tuple[tuple[float, ...], ...]) -> Column:
    """D^-1: the time by which a source has asked for offset tokens."""
    x, out = offset / target, F.lit(1.0)
    for k, rates in enumerate(schedules):
        h = 1 / (len(rates) - 1)
        areas = [(a + b) * h / 2 for a, b in zip(rates, rates[1:])]
        if min(rates) < 0 or sum(areas) <= 0:
            raise ValueError("rates must not be negative nor all 0")
        rates = [r / sum(areas) for r in rates]
        done, own = 1.0, F.lit(1.0)
        for i in range(len(rates) - 2, -1, -1):  # the last stretch that has begun by then
            a, b = rates[i], rates[i + 1]
            done -= (a + b) * h / 2
            y = F.greatest(x - done, F.lit(0.0))
            root = F.sqrt(F.greatest(a * a + 2 * (b - a) / h * y, F.lit(0.0)))
            here = F.when(a + root > 0, i * h + 2 * y / (a + root)).otherwise(i * h)
            own = here if i == len(rates) - 2 else F.when(x < done + (a + b) * h / 2, here).otherwise(own)
        out = F.when(turn % len(schedules) == k, own).otherwise(out)
    return F.least(F.lit(1.0), out)


def _counted(rows: DataFrame) -> DataFrame:
    """A row for each of the m rows that an entry stands for, numbered j from 0; one repeated very often is first dealt out in stretches."""
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n))
    few = rows.where(F.col("m") <= _STRETCH).withColumn("j", upto(F.col("m") - 1))
    many = rows.where(F.col("m") > _STRETCH).withColumn("stretch", upto(F.floor((F.col("m") - 1) / _STRETCH))).repartition("key", "stretch")
    start = F.col("stretch") * _STRETCH
    many = many.withColumn("i", upto(F.least(F.lit(_STRETCH).cast("long"), F.col("m") - start) - 1)).withColumn("j", start + F.col("i")).drop("i")
    return few.unionByName(many.drop("stretch"))


def _nth(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds the place of each row among those that agree in by, from 0: numbered by ranges of the whole, so rows that agree need not fit a task."""
    tie = "_tie"
    own = stored(numbered(rows.withColumn(tie, F.monotonically_increasing_id()), [*map(F.col, by), *order, F.col(tie)], name, stored).drop(tie))
    first = own.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min(name).alias("_first"))
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return own.join(first, same).withColumn(name, F.col(name) - F.col("_first")).drop("_first", *[f"_{c}" for c in by])


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, bucket_rows: int = 1000, schedules: tuple[tuple[float, ...], ...] = SCHEDULES) -> DataFrame:
    """One row for each row of docs: id_col, source, size, source_size, target, taken (words the mix takes), positions (times of its copies).

    schedules are dealt to the sources in turn, like the weights; each has two
    rates or more.  A null text has size 0 and is never taken, and so are empty
    ones; a null source is a source of its own, the last.  Rows that repeat an
    id, a source and a size share an entry and count each.  No rows: no rows.
    Of a very long text only the size is shuffled, and no window or list holds
    more than one bucket of entries.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = stored(rows.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("m")).withColumn("key", F.md5(F.concat_ws("|", F.col("id").isNull().cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("size").cast("string")))))
    sums = stored(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("n")))
    sums = targets(sums, weights, share, cap).join(sums.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    sums = stored(sums.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("n") / bucket_rows))).withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")))
    rows = rows.join(sums.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("bucket", F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % F.col("buckets"))
    per = rows.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("m")).alias("in_bucket"), F.first("rest").alias("rest"))
    per = stored(per.withColumn("block", F.floor(F.col("bucket") / _BUCKETS)))
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = per.groupBy("source", "block").agg(F.sum("in_bucket").alias("in_block"))
    blocks = blocks.select(F.col("source").alias("s"), F.col("block").alias("b"), F.coalesce(F.sum("in_block").over(ahead(Window.partitionBy("source").orderBy("block"))), F.lit(0)).alias("blocks_before"))
    within = F.coalesce(F.sum("in_bucket").over(ahead(Window.partitionBy("source", "block").orderBy("bucket"))), F.lit(0))
    per = per.withColumn("within", within).join(blocks, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).drop("s", "b")
    per = per.withColumn("before", F.col("blocks_before") + F.col("within")).withColumn("left", F.col("rest") - F.col("before"))
    per = stored(per.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before", F.when(F.col("left") >= F.col("in_bucket"), 1).when(F.col("left") <= 0, 0).alias("all"), "left"))
    rows = rows.join(per, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    # The one bucket of each source that fits in part: from large to small, as often as each still fits.
    part = rows.where("all is null").groupBy("source", "left").agg(F.sort_array(F.collect_list(F.struct("size", "key", "m")), asc=False).alias("docs"))
    fits = lambda a, x: F.when(x["size"] > 0, F.least(x["m"], F.floor(a["left"] / x["size"]).cast("long"))).otherwise(F.lit(0).cast("long"))
    fit = F.aggregate(
        "docs",
        F.struct(F.col("left").alias("left"), F.array().cast("array<struct<key:string,size:bigint,n:bigint>>").alias("took")),
        lambda a, x: F.when(fits(a, x) > 0, F.struct((a["left"] - x["size"] * fits(a, x)).alias("left"), F.concat(a["took"], F.array(F.struct(x["key"].alias("key"), x["size"].alias("size"), fits(a, x).alias("n")))).alias("took"))).otherwise(a),
    )
    part = part.select(F.col("source").alias("s"), F.explode(fit["took"]).alias("t")).select("s", F.col("t.key").alias("k"), F.col("t.size").alias("z"), F.col("t.n").alias("more"))
    rows = rows.join(part, F.col("source").eqNullSafe(F.col("s")) & (F.col("key") == F.col("k")) & (F.col("size") == F.col("z")) & F.col("all").isNull(), "left").drop("s", "k", "z")
    rows = rows.withColumn("extra", F.when(F.col("all").isNotNull(), F.col("all") * F.col("m")).otherwise(F.coalesce("more", F.lit(0))).cast("long"))
    # In a bucket those taken once more come first, so that the copies lie end to end.
    bucket = ahead(Window.partitionBy("source", "bucket").orderBy("key", "size"))
    taken, left_over = F.sum(F.col("size") * F.col("extra")), F.sum(F.col("size") * (F.col("m") - F.col("extra")))
    rows = rows.withColumn("taken_before", F.coalesce(taken.over(bucket), F.lit(0))).withColumn("others_before", F.coalesce(left_over.over(bucket), F.lit(0)) + taken.over(Window.partitionBy("source", "bucket")))
    rows = _counted(rows).withColumn("again", F.col("j") < F.col("extra"))
    rows = rows.withColumn("offset", F.col("before") + F.when(F.col("again"), F.col("taken_before") + F.col("j") * F.col("size")).otherwise(F.col("others_before") + (F.col("j") - F.col("extra")) * F.col("size")))
    copies = F.when(F.col("size") > 0, F.col("passes") + F.col("again").cast("long")).otherwise(F.lit(0)).cast("int")
    times = F.when(copies > 0, F.transform(F.sequence(F.lit(0), copies - 1), lambda k: _time(F.col("offset") + k * F.col("source_size"), F.col("target"), F.col("turn"), schedules))).otherwise(F.array().cast("array<double>"))
    return rows.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), times.alias("positions"))


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """plan() in training order: range-sorted by the time of a document's first copy, documents that the mix leaves out last."""
    out = plan(docs, **options).withColumn("first_position", F.element_at(F.col("positions"), F.when(F.size("positions") > 0, F.lit(1)).otherwise(F.lit(None).cast("int"))))
    id_col = options.get("id_col", "doc_id")
    order = [F.col("first_position").asc_nulls_last(), F.col(id_col)]
    return out.repartitionByRange(*order).sortWithinPartitions(*order)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mix with the columns of docs, a row for each copy, range-sorted by training time.

    Rows are told apart by id, text and source.  Those that agree in all three
    are taken in turn: the copies planned for them are dealt to them evenly.
    """
    names = [f"mix_{i}" for i in range(len(docs.columns) + 9)]
    key, time, nth, many, mine, key_source, place = [n for n in names if n not in docs.columns][:7]
    content = lambda x: F.struct(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(F.col(x)))
    keyed = docs.select(content(text_col).alias("key"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    own = plan(keyed, id_col="key", **options).where(F.size("positions") > 0)
    copies = own.select(F.col("key").alias(key), F.col("source").alias(key_source), F.explode("positions").alias(time))
    rows = docs.withColumn(mine, content(text_col))
    again = stored(keyed.groupBy("key", "source").agg(F.count(F.lit(1)).alias(many)).where(F.col(many) > 1).select(F.col("key").alias("again_key"), F.col("source").alias("again_source"), many))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    met = same(mine, key) & same(source_col, key_source)
    if again.isEmpty():
        out = rows.join(copies, met)
    else:
        of_rows, of_copies = (same(a, "again_key") & same(b, "again_source") for a, b in ((mine, source_col), (key, key_source)))
        keys = again.select("again_key", "again_source")
        rest = [F.col(c) for c in docs.columns if c not in (text_col, source_col)]
        some = _nth(rows.join(keys, of_rows, "left_semi"), [mine, source_col], rest, place)
        dealt = _nth(copies.join(again, of_copies).drop("again_key", "again_source"), [key, key_source], [F.col(time)], nth).withColumn(nth, F.col(nth) % F.col(many)).drop(many)
        out = rows.join(keys, of_rows, "left_anti").join(copies, met).unionByName(some.join(dealt, met & (F.col(place) == F.col(nth))).drop(place, nth))
    return out.drop(mine, key, key_source).repartitionByRange(time, id_col).sortWithinPartitions(time, id_col).drop(time)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_position", F.size("positions").alias("copies"))
