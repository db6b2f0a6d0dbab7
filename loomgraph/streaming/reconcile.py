"""Files of a source reconciled with what was published: unchanged ones write nothing, and absence must be said."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.shared import written
from loomgraph.streaming.buckets import Buckets

#: Columns that a corpus has beside those of its documents; origin is its key and revision its revision.
HEAD = "origin string, revision long, source string, state string, digest string, recipe string"
_OWN = ["source", "state", "digest", "recipe"]


def reconcile(corpus: Buckets, source: str, files: DataFrame, absent: DataFrame | None = None, full: bool = False) -> dict[str, int]:
    """Publishes files (origin, digest, recipe and the corpus's other columns) of a source; returns how many were added, changed, removed, and buckets written.

    A file whose digest and recipe are those published is left alone; if all are, nothing is written.  A delta removes only
    the origins that absent (origin) names; a full batch removes all of the source that it doesn't hold.  A removed origin
    keeps its head, as Removed and without content, and may come again.  An origin that is both a file and absent is a file;
    of several rows of an origin the smallest counts; null origins are left out; origins of other sources are refused.
    Heads are read without content, for a delta only in the buckets that it touches.  Files are joined with them once, and what that
    gives is put in place as it is: it has one row for each origin, a revision above that stored.
    """
    rest = [c for c in corpus.columns if c not in ("origin", "revision", *_OWN)]
    one = files.where("origin is not null").groupBy("origin").agg(F.min(F.struct("digest", "recipe", *rest)).alias("f")).select("origin", "f.*").withColumn("_named", F.lit(True))
    if absent is not None and not full:
        gone = absent.select("origin").where("origin is not null").distinct().withColumn("_gone", F.lit(True))
        one = one.join(gone, "origin", "full")
    one = written(one.withColumn("bucket", corpus._bucket()))
    stored = corpus._stored(None if full else corpus._touched(one))
    heads = stored.select("bucket", "origin", *[F.col(c).alias(f"_{c}") for c in ("revision", *_OWN)])
    met = one.join(heads, ["bucket", "origin"], "full" if full else "left")
    same = (F.col("_state") == "Active") & F.col("digest").eqNullSafe(F.col("_digest")) & F.col("recipe").eqNullSafe(F.col("_recipe"))
    live = (F.col("_state") == "Active") & (F.col("_source") == source)
    named = F.col("_named").isNotNull()
    kind = F.when(named & (F.col("_source") != source), "foreign").when(named & F.coalesce(same, F.lit(False)), None).when(named & (F.col("_state").isNull() | (F.col("_state") == "Removed")), "added").when(named, "changed").when(live, "removed")
    batch = met.withColumn("_kind", kind).where("_kind is not null").select("origin", (F.coalesce("_revision", F.lit(0)) + 1).alias("revision"), F.lit(source).alias("source"), F.when(named, "Active").otherwise("Removed").alias("state"), "digest", "recipe", *rest, "bucket", "_kind")
    batch = written(batch)
    counts = {r[0]: (r[1], set(r[2])) for r in batch.groupBy("_kind").agg(F.count(F.lit(1)), F.collect_set("bucket")).collect()}  # four rows at most, of as many buckets as there are
    if "foreign" in counts:
        raise ValueError("an origin belongs to another source")
    own = sorted(set().union(*[b for _, b in counts.values()]))
    if own:
        corpus.put(batch.drop("_kind"), own, stored)
    return {k: counts[k][0] if k in counts else 0 for k in ("added", "changed", "removed")} | {"buckets": len(own)}
