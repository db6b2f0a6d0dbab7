"""Record operators: pages by key, gates over dependencies, revision chains, leases, merges."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.sources.shared import tasks as dealt

PUBLIC = ("record_id", "session_id", "title", "status", "priority", "created_at", "updated_at")


#: So many rows are sent to all tasks.
_FEW = 100_000


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """A selection from a closed list; a private, unknown or repeated column is an error."""
    if not columns or len(set(columns)) != len(columns) or not set(columns) <= set(PUBLIC):
        raise ValueError("columns must be public and not repeat")
    return df.select(*columns)


def cursor(query: dict, generation: str, after: str) -> str:
    """An opaque cursor that holds for one query and generation only."""
    mark = hashlib.sha256(json.dumps([query, generation], sort_keys=True).encode()).hexdigest()[:16]
    return base64.urlsafe_b64encode(json.dumps({"after": after, "mark": mark}, sort_keys=True).encode()).decode().rstrip("=")


def after(query: dict, generation: str, value: str) -> str:
    try:
        found = json.loads(base64.urlsafe_b64decode(value + "=" * (-len(value) % 4)))
        if value == cursor(query, generation, found["after"]):
            return found["after"]
    except (ValueError, KeyError, TypeError):
        pass
    raise ValueError("the cursor is not one of this query and generation")


def keyset(df: DataFrame, key: str, last=None, size: int = 20, top_k: int = 0, consumed: int = 0) -> DataFrame:
    """The page after key last; top_k caps the pages together, 0 is unlimited."""
    if not 1 <= size <= 100:
        raise ValueError("a page has 1 to 100 rows")
    if top_k and consumed % size:
        raise ValueError("consumed must be whole pages")
    n = min(size, top_k - consumed) if top_k else size
    return (df if last is None else df.where(F.col(key) > last)).orderBy(F.col(key).asc_nulls_last()).limit(max(0, n))


def offset_page(df: DataFrame, order: list[Column], offset: int, size: int = 20) -> DataFrame:
    """Rows offset + 1 to offset + size with their place; only offset + size rows are gathered."""
    top = df.orderBy(*order).limit(offset + size)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).where(F.col("place") > offset)


def late(df: DataFrame, key: str, order: list[Column], k: int, narrow: list[str]) -> DataFrame:
    """Top k by narrow columns first, then the whole rows of these k alone."""
    keys = df.select(key, *narrow).orderBy(*order).limit(k).select(key)
    return df.join(F.broadcast(keys), key)  # k rows


def checks_pass(checks: Column, flagged: Column) -> Column:
    live = F.filter(checks, lambda c: c["status"] != "superseded")
    both = F.exists(live, lambda c: c["kind"] == "acceptance") & F.exists(live, lambda c: c["kind"] == "test")
    return ~flagged & both & F.forall(live, lambda c: (c["status"] == "passed") & (F.trim(F.coalesce(c["evidence"], F.lit(""))) != ""))


def gates(tasks: DataFrame, deps: DataFrame, written, order: str | None = None) -> DataFrame:
    """(id, completion, ready, valid): over the graph of prerequisites and parents.

    tasks: id, status, own (its checks pass), and if there are any parent and session. deps: id, needs. A task is valid if it is
    completed and its conditions hold: own, all it needs valid, and all its children valid, or cancelled with nothing
    below them open. A cancelled task has no prerequisites, and nothing that needs it holds. completion: not cancelled
    and the conditions hold; ready: open and all it needs valid.

    Only what fails travels: each round takes the tasks that failed in the last one to those that wait for them, and
    writes no more than these. A cycle is an error; where all edges lead upwards in the column order there is none, and
    only else it is searched for.
    """
    tasks = tasks if "parent" in tasks.columns else tasks.withColumn("parent", F.lit(None).cast(tasks.schema["id"].dataType))
    facts = written(tasks.select("id", "status", "own", "parent", *[order] * (order is not None)))
    of = lambda name: facts.select(F.col("id").alias(name), F.col("status").alias("status_" + name), *([] if order is None else [F.col(order).alias("order_" + name)]))
    need = deps.join(of("id"), "id").where("status_id <> 'cancelled'").join(of("needs"), "needs")
    need = written(need)
    child = facts.where("parent is not null").select("id", F.col("parent").alias("needs")).join(of("id"), "id").join(of("needs"), "needs")
    edges = need.where("status_needs <> 'cancelled'").select(F.col("needs").alias("a"), F.col("id").alias("b"), *[F.col("order_needs").alias("low"), F.col("order_id").alias("high")] * (order is not None))
    edges = edges.unionByName(child.select(F.col("id").alias("a"), F.col("needs").alias("b"), *[F.col("order_id").alias("low"), F.col("order_needs").alias("high")] * (order is not None)))
    if order is None or not edges.where("not low < high").isEmpty():
        if not acyclic(edges.select(F.col("b").alias("id"), F.col("a").alias("needs")), written).isEmpty():
            raise ValueError("tasks wait for each other in a circle")
    # Rows (id, kind): bad, its conditions fail; invalid, it does not count for those that need it; unmet, nor for its parent.
    lost = need.where("status_needs = 'cancelled'").select("id").distinct().withColumn("lost", F.lit(True))
    start = facts.join(lost, "id", "left").select("id", "status", (~F.col("own") | F.coalesce("lost", F.lit(False))).alias("bad"))
    kinds = lambda x: F.filter(F.array(*[F.when(c, k) for c, k in x]), lambda k: k.isNotNull())
    invalid = F.col("bad") | (F.col("status") != "completed")
    front = written(start.select("id", F.explode(kinds([(F.col("bad"), "bad"), (invalid, "invalid"), (invalid & (F.col("status") != "cancelled"), "unmet")])).alias("kind")))
    need, child = need.select("id", "needs", F.col("status_id").alias("status")), written(child.select("id", "needs", F.col("status_needs").alias("status")))
    failed = front
    while True:
        a = front.where("kind = 'invalid'").select(F.col("id").alias("needs")).join(need, "needs").select("id", "status")
        b = front.where("kind = 'unmet'").join(child, "id").select(F.col("needs").alias("id"), "status")
        c = F.col("status")
        hit = a.select("id", kinds([(F.lit(True), "bad"), (c == "completed", "invalid"), (c == "completed", "unmet")]).alias("kinds")).unionAll(b.select("id", kinds([(F.lit(True), "bad"), (c == "completed", "invalid"), (c.isin("completed", "cancelled"), "unmet")]).alias("kinds")))
        hit = written(hit.select("id", F.explode("kinds").alias("kind")).distinct())
        # What failed before is many rows and is not moved for a few: those of them that are hit again are found where they lie.
        again = failed.join(F.broadcast(hit), ["id", "kind"], "left_semi") if hit.count() <= _FEW else failed
        front = written(hit.join(again, ["id", "kind"], "left_anti"))
        if front.isEmpty():
            break
        failed = failed.unionByName(front)
    state = failed.groupBy("id").agg(F.max(F.col("kind") == "bad").alias("bad"), F.max(F.col("kind") == "invalid").alias("invalid"))
    state = written(facts.join(state, "id", "left").select("id", "status", F.coalesce("bad", F.lit(False)).alias("bad"), F.coalesce("invalid", F.lit(False)).alias("invalid")))
    waits = need.join(state.where("invalid").select(F.col("id").alias("needs")), "needs", "left_semi").select("id").distinct().withColumn("waits", F.lit(True))
    out = state.join(waits, "id", "left")
    return out.select("id", ((F.col("status") != "cancelled") & ~F.col("bad")).alias("completion"), ((F.col("status") == "open") & F.col("waits").isNull()).alias("ready"), (~F.col("invalid")).alias("valid"))


def closable(gated: DataFrame, tasks: DataFrame) -> DataFrame:
    """(session, closable): all its tasks are cancelled or valid. gated: id, valid; tasks: id, session, status."""
    both = tasks.select("id", "session", "status").join(gated.select("id", "valid"), "id")
    return both.groupBy("session").agg(F.bool_and((F.col("status") == "cancelled") | F.col("valid")).alias("closable"))


def validate(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """(id, problem): repeated ids; dependencies on itself, on nothing, or twice; parents that are itself, nothing or of another session."""
    # Both are read several times, by one key or another: in tasks of a fixed share of the input, as these rows pack very well.
    n = dealt(tasks, 4)
    by_id, by_need = tasks.repartition(n, "id"), deps.repartition(n, "needs")
    repeated = by_id.groupBy("id").count().where("count > 1").select("id", F.lit("repeated id").alias("problem"))
    self_ = deps.where("id = needs").select("id", F.lit("needs itself").alias("problem"))
    lost = by_need.join(by_id.select(F.col("id").alias("needs")), "needs", "left_anti").select("id", F.lit("unknown dependency").alias("problem"))
    twice = deps.repartition(n, "id", "needs").groupBy("id", "needs").count().where("count > 1").select("id", F.lit("repeated dependency").alias("problem"))
    out = repeated.unionAll(self_).unionAll(lost).unionAll(twice)
    if "parent" in tasks.columns:
        up = tasks.where("parent is not null").select("id", "parent", "session").repartition(n, "parent").join(by_id.select(F.col("id").alias("parent"), F.col("session").alias("own")), "parent", "left")
        problem = F.when(F.col("id") == F.col("parent"), "is its own parent").when(F.col("own").isNull(), "unknown parent").when(F.col("own") != F.col("session"), "parent of another session")
        out = out.unionAll(up.select("id", problem.alias("problem")).where("problem is not null"))
    return out.repartition(n, "id", "problem").distinct()


def guarded(df: DataFrame, rows: int) -> DataFrame:
    """df if it has at most so many rows, else an error: nothing is cut off silently."""
    few = df.limit(rows + 1)
    if few.count() > rows:
        raise ValueError(f"more than {rows} rows")
    return few


def acyclic(deps: DataFrame, written) -> DataFrame:
    """The edges that lie on or behind cycles: what is left once tasks without open dependencies are taken away, round by round."""
    left, n = written(deps), -1
    while True:
        left = written(left.join(left.select(F.col("id").alias("needs")), "needs", "left_semi").select("id", "needs"))
        now = left.count()
        if now in (0, n):
            return left
        n = now


def chain(revisions: DataFrame, key: str, revision: str, value: str, deleted: Column) -> DataFrame:
    """Revisions with their predecessor's value and whether the chain is sound there: numbers go up by one, nothing follows a deletion."""
    w = Window.partitionBy(key).orderBy(revision)
    sound = (F.coalesce(F.lag(revision).over(w), F.lit(-1)) + 1 == F.col(revision)) & ~F.coalesce(F.lag(deleted).over(w), F.lit(False))
    return revisions.select(key, revision, F.lag(value).over(w).alias("before"), F.col(value).alias("after"), sound.alias("sound"))


def top_per_section(df: DataFrame, section: str, order: list[Column], k: int = 20) -> DataFrame:
    """The first k rows of each section with their place, and the section's total; each task sends only k rows of a section."""
    total = df.groupBy(section).agg(F.count(F.lit(1)).alias("total"))
    top = df.withColumn("place", F.row_number().over(Window.partitionBy(section).orderBy(*order))).where(F.col("place") <= k)
    return top.join(total, section).withColumn("has_more", F.col("total") > k)


def mutate(heads: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, outcome, revision): changes (id, expected, kind, value) against heads (id, revision, value, tombstone).

    A change applies if its expected revision is the head's, the head is alive and the value differs.
    """
    j = changes.join(heads.withColumnRenamed("value", "was"), "id", "left")
    outcome = (
        F.when(F.col("revision").isNull(), "unknown")
        .when(F.col("tombstone"), "deleted")
        .when(F.col("expected") != F.col("revision"), "conflict")
        .when((F.col("kind") == "update") & F.col("value").eqNullSafe(F.col("was")), "no change")
        .otherwise("applied")
    )
    return j.select("id", outcome.alias("outcome"), F.when(outcome == "applied", F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"))
