"""Qualified names resolved through scopes, by joins on (name, scope)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _inside(scope: Column, name: Column) -> Column:
    return F.when(scope == "", name).otherwise(F.concat_ws("/", scope, name))


def _fits() -> Column:
    return (F.size("labels") == 0) | F.array_contains("labels", F.col("label"))


def _innermost(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(ref, option, scope, n, target): what the innermost scope from path outwards declares under the name with a label asked for."""
    parts = F.split("path", "/")
    scopes = F.when(F.col("path") == "", F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("scope")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.when(k == 0, "").otherwise(F.array_join(F.slice(parts, 1, k), "/")).alias("scope")))
    )
    met = asked.select("ref", "option", "name", "labels", F.inline(scopes)).join(known, ["name", "scope"]).where(_fits())
    each = met.groupBy("ref", "option", "depth", "scope").agg(F.sum("n").alias("n"), F.min("target").alias("target"))
    best = each.groupBy("ref", "option").agg(F.max(F.struct("depth", "scope", "n", "target")).alias("b"))
    return best.select("ref", "option", "b.scope", "b.n", "b.target")


def qualified(references: DataFrame, entities: DataFrame, keywords: tuple[str, ...] = ("self", "this")) -> DataFrame:
    """(ref, target, status) for references (ref, name, scope, own, qualifier, labels, fallback) among entities (name, scope, label, target).

    Scopes are names with / between them, '' is the outermost; names hold none.  scope is where the referring entity is
    declared and own its own scope, null if it has none.  Without qualifier, or with one of the keywords, a name is looked for in own,
    then from scope outwards; the first scope that declares it with one of the labels (none: any) decides.  Any other
    qualifier must itself be found, from scope outwards and with any label, as exactly one entity, whose members are looked
    at.  If nothing is found for the labels, the same is tried for the fallback label, unless it is null or blank.
    One target is Resolved, several are Ambiguous (no target), none is NotFound.  ref should be distinct; an entity has one label.  A null name is NotFound; a
    null scope is the outermost.  Equal entities are counted once for each name, scope and label before the joins, so a name that is declared often meets a reference once.
    """
    known = entities.select("name", F.coalesce("scope", F.lit("")).alias("scope"), "label", "target").groupBy("name", "scope", "label").agg(F.countDistinct("target").alias("n"), F.min("target").alias("target"))
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    options = F.array_compact(F.array(F.struct(F.lit(1).alias("option"), labels.alias("labels")), F.when(F.trim("fallback") != "", F.struct(F.lit(2).alias("option"), F.array("fallback").alias("labels")))))
    scope = F.coalesce("scope", F.lit(""))
    plain = F.col("qualifier").isNull() | F.col("qualifier").isin(*keywords)
    asked = references.withColumn("_plain", plain).select("ref", "name", "_plain", "qualifier", scope.alias("scope"), F.when(F.col("_plain"), F.coalesce("own", scope)).otherwise(scope).alias("path"), F.inline(options))
    direct = _innermost(asked.where("_plain"), known).select("ref", "option", "n", "target")
    outer = references.where(~plain).select("ref", F.lit(0).alias("option"), F.col("qualifier").alias("name"), F.array().cast("array<string>").alias("labels"), scope.alias("path"), "qualifier")
    owner = _innermost(outer, known).where("n = 1").select("ref", F.col("scope").alias("_scope"))
    members = asked.where("not _plain").drop("scope").join(owner, "ref").withColumn("scope", _inside(F.col("_scope"), F.col("qualifier")))
    within = members.join(known, ["name", "scope"]).where(_fits()).groupBy("ref", "option").agg(F.sum("n").alias("n"), F.min("target").alias("target"))
    found = direct.unionByName(within).groupBy("ref").agg(F.min(F.struct("option", "n", "target")).alias("b"))
    n = F.col("b.n")
    return references.select("ref").join(found, "ref", "left").select("ref", F.when(n == 1, F.col("b.target")).alias("target"), F.when(n.isNull(), "NotFound").when(n == 1, "Resolved").otherwise("Ambiguous").alias("status"))
