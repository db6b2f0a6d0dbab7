"""Communities by levels against a plain sequential Louvain, by modularity."""

import random
from collections import defaultdict

import pytest

from loomgraph.operators import links
from loomgraph.sources.shared import written


def modularity(pairs, label):
    m, inside, volume = len(pairs), 0, defaultdict(int)
    for a, b in pairs:
        inside += label[a] == label[b]
        volume[label[a]] += 1
        volume[label[b]] += 1
    return inside / m - sum((v / (2 * m)) ** 2 for v in volume.values())


def plain_louvain(pairs):
    """Nodes one after the other to the neighbouring community of the largest gain, then communities as nodes."""
    weight = defaultdict(lambda: defaultdict(float))
    for a, b in pairs:
        weight[a][b] += 1
        weight[b][a] += 1
    degree = {a: sum(x.values()) for a, x in weight.items()}
    member, total = {a: a for a in weight}, 2 * len(pairs)
    while True:
        label, volume, moved, any_ = {a: a for a in weight}, dict(degree), True, False
        while moved:
            moved = False
            for a in sorted(weight):
                to = defaultdict(float)
                for b, w in weight[a].items():
                    if b != a:
                        to[label[b]] += w
                own = label[a]
                volume[own] -= degree[a]
                best = max(sorted(to), key=lambda c: to[c] - degree[a] * volume[c] / total, default=own)
                if to[best] - degree[a] * volume[best] / total > to[own] - degree[a] * volume[own] / total + 1e-12:
                    label[a], moved, any_ = best, True, True
                volume[label[a]] += degree[a]
        if not any_:
            return member
        member = {s: label[c] for s, c in member.items()}
        merged, sums = defaultdict(lambda: defaultdict(float)), defaultdict(float)
        for a, x in weight.items():
            sums[label[a]] += degree[a]
            for b, w in x.items():
                merged[label[a]][label[b]] += w
        weight, degree = merged, dict(sums)


def generated(kind):
    rng = random.Random(kind)
    if kind == "cliques":  # on a ring, joined by single links
        pairs = {(6 * c + i, 6 * c + j) for c in range(10) for i in range(6) for j in range(i + 1, 6)}
        return pairs | {tuple(sorted((6 * c + 5, 6 * ((c + 1) % 10)))) for c in range(10)}
    if kind == "planted":
        return {(i, j) for i in range(90) for j in range(i + 1, 90) if rng.random() < (0.3 if i % 5 == j % 5 else 0.02)}
    return {(i, i + 1) for i in range(59)} | {tuple(sorted(rng.sample(range(60), 2))) for _ in range(12)}  # a chain with some short cuts


@pytest.mark.parametrize("kind", ["cliques", "planted", "chain"])
def test_modularity_of_levels(spark, kind):
    pairs = sorted(generated(kind))
    e = spark.createDataFrame([(b, a) if a % 2 else (a, b) for a, b in pairs] + [(a, a) for a in range(3)] + [(0, 10_000)], "source long, target long")
    pages = spark.createDataFrame([(i,) for i in range(100)], "slug long")
    found = written(links.communities(e, pages, written))
    label = dict(found.collect())
    assert set(label) == {x for p in pairs for x in p} and all(label[label[x]] == label[x] <= x for x in label)
    got, plain = modularity(pairs, label), modularity(pairs, plain_louvain(pairs))
    assert got >= plain - (0.02 if kind == "chain" else 1e-9), (got, plain)
    sizes = defaultdict(int)
    for c in label.values():
        sizes[c] += 1
    order = sorted(sizes, key=lambda c: (-sizes[c], c))
    assert {(r["community"], r["size"], r["place"]) for r in links.by_size(found, written).collect()} == {(c, sizes[c], n) for n, c in enumerate(order, 1)}
    degree = defaultdict(int)
    for p in pairs:
        for x in p:
            degree[x] += 1
    want = {c: min((x for x in label if label[x] == c), key=lambda x: (-degree[x], x)) for c in sizes}
    assert dict(links.representatives(e, found).collect()) == want


def test_two_triangles_and_nothing(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (11, 12), (12, 13), (11, 13)], "source long, target long")
    pages = spark.createDataFrame([(i,) for i in (1, 2, 3, 11, 12, 13, 20)], "slug long")
    found = links.communities(e, pages, written)
    assert dict(found.collect()) == {i: 1 if i < 10 else 11 for i in (1, 2, 3, 11, 12, 13)}
    assert {r["cohesion"] for r in links.cohesion(e, found).collect()} == {1.0}
    assert links.communities(e.limit(0), pages, written).collect() == []
