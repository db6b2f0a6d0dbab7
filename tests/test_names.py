"""Qualified names against a plain search through scopes."""

import random

from loomgraph.operators.names import qualified

REFS = "ref long, name string, scope string, own string, qualifier string, labels array<string>, fallback string"
ENTITIES = "name string, scope string, label string, target long"


def plain(ref, entities):
    _, name, scope, own, qualifier, labels, fallback = ref
    scope = scope or ""

    def at(name, where, labels):
        return {t for n, s, label, t in entities if n == name and (s or "") == where and (not labels or label in labels)}

    def lexical(name, path, labels):
        while True:
            if got := at(name, path, labels):
                return got, path
            if not path:
                return set(), None
            path = path.rpartition("/")[0]

    for wanted in [labels or [], *([[fallback]] if (fallback or "").strip() else [])]:
        if qualifier in (None, "self", "this"):
            got = lexical(name, own if own is not None else scope, wanted)[0]
        else:
            owners, where = lexical(qualifier, scope, [])
            got = at(name, f"{where}/{qualifier}" if where else qualifier, wanted) if len(owners) == 1 else set()
        if got:
            return (got.pop(), "Resolved") if len(got) == 1 else (None, "Ambiguous")
    return None, "NotFound"


def test_random_scopes(spark):
    rng = random.Random(5)
    paths = ["", "a", "b", "a/b", "a/b/c", "b/a", "c"]
    entities = [(rng.choice("abcd"), rng.choice([*paths, None]), rng.choice("XY"), k) for k in range(45)]
    entities += entities[:5]  # repeated rows are one entity
    refs = []
    for k in range(600):
        scope, name = rng.choice([*paths, None]), rng.choice(["a", "b", "c", "d", "e", None])
        own = rng.choice([None, f"{scope}/{rng.choice('abc')}" if scope else rng.choice("abc")])
        refs.append((k, name, scope, own, rng.choice([None, "self", "a", "b", "c", "zz"]), rng.choice([None, [], ["X"], ["X", "Y"], ["Z"]]), rng.choice([None, " ", "Y"])))
    got = {r["ref"]: (r["target"], r["status"]) for r in qualified(spark.createDataFrame(refs, REFS), spark.createDataFrame(entities, ENTITIES)).collect()}
    want = {r[0]: plain(r, entities) for r in refs}
    assert {k: (refs[k], got[k], want[k]) for k in want if got[k] != want[k]} == {}
    assert {w[1] for w in want.values()} == {"Resolved", "Ambiguous", "NotFound"}


def test_no_rows(spark):
    refs, none = spark.createDataFrame([(1, "a", "", None, None, None, None)], REFS), spark.createDataFrame([], ENTITIES)
    assert [tuple(r) for r in qualified(refs, none).collect()] == [(1, None, "NotFound")]
    assert qualified(refs.limit(0), none).count() == 0
