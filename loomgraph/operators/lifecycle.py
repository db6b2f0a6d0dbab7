"""Life of records as batches of changes against their heads: mutations, folds, claims, revisions of specifications and checks.

Every operator returns one row for each change, (id, seq, outcome, after): after is the head once the change has been applied, null
where it is refused. `settled` puts the heads together again. (id, seq) tells changes apart. A change names the revision that it
expects, so of several changes to one head in a batch that could be applied the one of smallest seq is, and the others conflict.
A null id is unknown. Within the expressions `was` is the head and `new` the change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

was, new = (lambda c: F.col(f"was.{c}")), (lambda c: F.col(f"new.{c}"))


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def decide(heads: DataFrame, changes: DataFrame, refusals: list[tuple[Column, str]], effects: dict[str, Column]) -> DataFrame:
    """(id, seq, outcome, after): the first refusal that holds, else the head with effects and its revision raised by one."""
    j = changes.select("id", F.struct(*changes.columns).alias("new")).join(heads.select("id", F.struct(*heads.columns).alias("was")), "id", "left")
    outcome = F.when(F.col("was").isNull(), "unknown").when(~new("expected").eqNullSafe(was("revision")), "conflict")
    for condition, name in refusals:
        outcome = outcome.when(condition, name)
    j = j.withColumn("outcome", outcome.otherwise("applied"))
    first = j.where("outcome = 'applied'").groupBy("id").agg(F.min("new.seq").alias("first"))
    j = j.join(first, "id", "left").withColumn("outcome", F.when((F.col("outcome") == "applied") & (new("seq") != F.col("first")), "conflict").otherwise(F.col("outcome")))
    effects = {"revision": was("revision") + 1} | effects
    after = F.struct(*[effects.get(f.name, was(f.name)).cast(f.dataType).alias(f.name) for f in heads.schema.toNullable()])
    return j.select("id", new("seq").alias("seq"), "outcome", F.when(F.col("outcome") == "applied", after).alias("after"))


def settled(heads: DataFrame, decided: DataFrame) -> DataFrame:
    """The heads after the changes; heads without an applied change as they were."""
    done = decided.where("after is not null")
    return heads.join(done.select("id"), "id", "left_anti").unionByName(done.select("after.*"))


MUTATIONS = ("update", "delete", "automatic delete", "promote", "demote")


def mutations(heads: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes (id, seq, kind, expected, at, title, body, class, mandatory, important, refs; null leaves a value) to memories.

    heads: id, revision, alive, title, body, class, mandatory, important, refs, generation, updated_at. A change that changes
    nothing, one of a deleted memory, an automatic deletion of an important or mandatory one and a clock that goes back are
    refused. A deletion clears the references; whenever they change, or a memory is deleted, generation goes up.
    """
    kind, update = new("kind"), new("kind") == "update"
    fields = ("title", "body", "class", "mandatory", "important", "refs")
    same = F.lit(True)
    for f in fields:
        same = same & F.coalesce(new(f).eqNullSafe(was(f)) | new(f).isNull(), F.lit(False))
    deletion = kind.isin("delete", "automatic delete")
    moved = deletion | (update & new("refs").isNotNull() & ~new("refs").eqNullSafe(was("refs")))
    effects = {f: F.when(update, F.coalesce(new(f), was(f))).otherwise(was(f)) for f in fields}
    effects["important"] = F.when(kind == "promote", True).when(kind == "demote", False).otherwise(effects["important"])
    effects["refs"] = F.when(deletion, F.slice(was("refs"), 1, 0)).otherwise(effects["refs"])
    effects |= {"alive": ~deletion, "generation": was("generation") + F.when(moved, 1).otherwise(0), "updated_at": new("at")}
    refusals = [
        (~was("alive"), "deleted"),
        (kind.isNull() | ~kind.isin(*MUTATIONS), "invalid"),
        (update & same, "no change"),
        ((kind == "automatic delete") & (was("important") | was("mandatory")), "protected"),
        (kind.isin("promote", "demote") & (was("important") == (kind == "promote")), "no change"),
        (new("at").isNull() | (new("at") < was("updated_at")), "backward clock"),
    ]
    return decide(heads, changes, refusals, effects)


def fold(heads: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold, id, outcome, after): memories folded into one survivor; heads as in `mutations`, folds (fold, id, expected, survives, at).

    The survivor takes the merged attributes (mandatory and important if any is, the highest class); the others are deleted. A
    fold is applied whole or not at all: every memory must be alive, at the expected revision and not ahead of the clock, in
    no other fold, and just one of two or more survives. Only counts and merged attributes of a fold are gathered.
    """
    j = folds.select("id", F.struct(*folds.columns).alias("new")).join(heads.select("id", F.struct(*heads.columns).alias("was")), "id", "left")
    often = folds.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit(True).alias("often"))
    sound = F.coalesce(F.col("was").isNotNull() & was("alive") & new("expected").eqNullSafe(was("revision")) & (new("at") >= was("updated_at")), F.lit(False))
    j = j.join(often, "id", "left").select("id", "new", "was", new("fold").alias("fold"), (sound & F.col("often").isNull()).alias("sound"))
    state = j.groupBy("fold").agg(
        F.bool_and("sound").alias("all_sound"), F.count_if(new("survives")).alias("survivors"), F.count(F.lit(1)).alias("n"),
        *[F.max(was(c)).alias(c) for c in ("class", "mandatory", "important")],
    )
    j = j.join(state.select("fold", F.struct("*").alias("state")), "fold")
    outcome = F.when((F.col("state.survivors") != 1) | (F.col("state.n") < 2), "invalid").when(~F.col("state.all_sound"), "conflict").otherwise("applied")
    lives = new("survives")
    effects = {c: F.when(lives, F.col(f"state.{c}")).otherwise(was(c)) for c in ("class", "mandatory", "important")}
    effects |= {"alive": lives, "refs": F.when(lives, was("refs")).otherwise(F.slice(was("refs"), 1, 0)), "generation": was("generation") + F.when(lives, 0).otherwise(1)}
    effects |= {"updated_at": new("at"), "revision": was("revision") + 1}
    after = F.struct(*[effects.get(f.name, was(f.name)).cast(f.dataType).alias(f.name) for f in heads.schema.toNullable()])
    return j.select("fold", "id", outcome.alias("outcome"), F.when(outcome == "applied", after).alias("after"))


def claims(heads: DataFrame, requests: DataFrame) -> DataFrame:
    """Claims, heartbeats and releases (id, seq, kind, actor, epoch, expected, at, lease_ms) of tasks.

    heads: id, revision, status, owner, epoch, claimed_at, heartbeat_at, expires_at. A lease lives while expires_at is
    after the request's clock. A claim needs a task that is neither closed nor held and begins a new epoch; a heartbeat
    needs the living lease of its own actor and epoch and renews it; a release needs these too, but not that the lease
    still lives, and keeps the epoch, so that a late heartbeat of the old owner is refused.
    """
    kind, at = new("kind"), new("at")
    live = was("owner").isNotNull() & F.coalesce(was("expires_at") > at, F.lit(False))
    mine = was("owner").eqNullSafe(new("actor")) & was("epoch").eqNullSafe(new("epoch")) & was("owner").isNotNull()
    claim, release = kind == "claim", kind == "release"
    refusals = [
        (kind.isNull() | ~kind.isin("claim", "heartbeat", "release") | blank(new("actor")) | at.isNull(), "invalid"),
        (~release & ~F.coalesce(new("lease_ms") > 0, F.lit(False)), "invalid"),
        (claim & was("status").isin("completed", "cancelled"), "closed"),
        (claim & live, "held"),
        (~claim & ~mine, "fenced"),
        ((kind == "heartbeat") & ~live, "expired"),
        (~claim & (at < was("heartbeat_at")), "backward clock"),
    ]
    effects = {
        "owner": F.when(~release, new("actor")),
        "epoch": was("epoch") + F.when(claim, 1).otherwise(0),
        "claimed_at": F.when(claim, at).when(~release, was("claimed_at")),
        "heartbeat_at": F.when(~release, at),
        "expires_at": F.when(~release, at + new("lease_ms")),
    }
    return decide(heads, requests, refusals, effects)


def check(status: Column, evidence: Column, of: Column) -> Column:
    """A check (id, kind, text, status, evidence) with another status and evidence."""
    return F.struct(of["id"].alias("id"), of["kind"].alias("kind"), of["text"].alias("text"), status.alias("status"), evidence.alias("evidence"))


def revise(specs: DataFrame, commands: DataFrame) -> DataFrame:
    """Revisions (id, seq, expected, title, description, type, priority, actor, reason; null keeps a value) of specifications.

    specs: id, revision, title, description, type, priority, checks (array of id, kind, text, status, evidence). Texts are
    trimmed. If title, description or type really changes, all checks but superseded ones are pending again. A priority
    beyond 0 to 4, a blank actor, reason or title, and a revision that changes nothing are refused.
    """
    text = {c: F.coalesce(F.trim(new(c)), was(c)) for c in ("title", "description", "type")}
    reset = F.lit(False)
    for c, value in text.items():
        reset = reset | ~value.eqNullSafe(was(c))
    priority = F.coalesce(new("priority"), was("priority"))
    pending = F.transform(was("checks"), lambda c: F.when(c["status"] == "superseded", c).otherwise(check(F.lit("pending"), F.lit(None).cast("string"), c)))
    refusals = [
        (blank(new("actor")) | blank(new("reason")) | blank(text["title"]) | ~priority.between(0, 4), "invalid"),
        (~reset & priority.eqNullSafe(was("priority")), "no change"),
    ]
    return decide(specs, commands, refusals, text | {"priority": priority, "checks": F.when(reset, pending).otherwise(was("checks"))})


def target(name: str = "check") -> list[tuple[Column, str]]:
    """Refusals of a command on a check that does not exist or is superseded."""
    found = F.filter(was("checks"), lambda c: c["id"] == new(name))
    return [(F.coalesce(F.size(found), F.lit(0)) < 1, "unknown check"), (F.exists(found, lambda c: c["status"] == "superseded"), "superseded check")]


def verify(specs: DataFrame, commands: DataFrame) -> DataFrame:
    """Results (id, seq, expected, check, passed, evidence, actor) of active checks; repeated results are allowed."""
    status = F.when(new("passed"), "passed").otherwise("failed")
    checks = F.transform(was("checks"), lambda c: F.when(c["id"] == new("check"), check(status, F.trim(new("evidence")), c)).otherwise(c))
    refusals = [(blank(new("actor")) | blank(new("evidence")) | new("passed").isNull(), "invalid"), *target()]
    return decide(specs, commands, refusals, {"checks": checks})


def supersede(specs: DataFrame, commands: DataFrame) -> DataFrame:
    """Supersessions (id, seq, expected, check, actor, reason, new_check, new_kind, new_text; new_check null: no replacement) of active checks.

    A replacement is pending and of the old check's kind unless it names one; its id, and its kind and text together, must be
    new. An acceptance and a test must stay active.
    """
    old = F.filter(was("checks"), lambda c: c["id"] == new("check"))
    kind, text, some = F.coalesce(new("new_kind"), F.get(old, F.lit(0))["kind"]), F.trim(new("new_text")), new("new_check").isNotNull()
    twice = some & F.exists(was("checks"), lambda c: (c["id"] == new("new_check")) | ((c["kind"] == kind) & (c["text"] == text)))
    rest = F.filter(was("checks"), lambda c: (c["id"] != new("check")) & (c["status"] != "superseded"))
    has = lambda k: F.exists(rest, lambda c: c["kind"] == k) | (some & (kind == k))
    refusals = [
        (blank(new("actor")) | blank(new("reason")) | (some & (blank(new("new_text")) | ~kind.isin("acceptance", "test"))), "invalid"),
        *target(),
        (twice, "repeated check"),
        (~(has("acceptance") & has("test")), "missing kind"),
    ]
    gone = F.transform(was("checks"), lambda c: F.when(c["id"] == new("check"), check(F.lit("superseded"), c["evidence"], c)).otherwise(c))
    added = F.struct(new("new_check").alias("id"), kind.alias("kind"), text.alias("text"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("evidence"))
    return decide(specs, commands, refusals, {"checks": F.when(some, F.concat(gone, F.array(added))).otherwise(gone)})
