"""Document-link analytics: pages (slug), links (source, target)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.ordering import numbered


def link_graph(raw: DataFrame) -> DataFrame:
    """Distinct links without empty targets and self links; dangling ones stay."""
    return raw.where("target is not null and source <> target").select("source", "target").distinct()


def broken(links: DataFrame, pages: DataFrame) -> DataFrame:
    return links.join(pages, F.col("target") == F.col("slug"), "left_anti")


def orphans(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages without any link in or out."""
    return pages.join(links, F.col("slug") == F.col("source"), "left_anti").join(links, F.col("slug") == F.col("target"), "left_anti")


def stats(links: DataFrame, pages: DataFrame) -> DataFrame:
    one = lambda df, name, x=None: df.agg((F.count(F.lit(1)) if x is None else F.countDistinct(x)).alias(name))
    inbound = links.join(pages, F.col("target") == F.col("slug"), "left_semi")
    return one(pages, "pages").crossJoin(one(links, "links")).crossJoin(one(inbound, "inbound_pages", "target")).crossJoin(one(orphans(links, pages), "orphans")).crossJoin(one(broken(links, pages), "broken_edges"))  # single rows


def _met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that is never a broadcast: there are some in each of many rounds, and all of a broadcast goes through the driver."""
    return left.hint("merge").join(right.hint("merge"), on, how)


#: Members of one list of twins, about.
_LIST = 1000

#: Rows that one task makes of pairs of lists, about, and pairs that it takes at most.
_ROWS, _PAIRS = 32_000_000, 250_000


def _twins(both: DataFrame, pages: DataFrame, written) -> DataFrame:
    """(slug, rep, members): nodes of (slug, next) with exactly the same neighbours, all of them pages or none, share a representative, one of them.

    Sets of neighbours are met by hashes; then each is compared with that of its representative, and what differs stands for itself.
    """
    known = pages.select("slug").distinct().withColumn("page", F.lit(True))
    sets = both.groupBy("slug").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("next")).alias("h"), F.bit_xor(F.xxhash64("next", F.lit(1))).alias("g"))
    alike = written(sets.join(known, "slug", "left").withColumn("page", F.coalesce("page", F.lit(False))))
    firsts = alike.groupBy("page", "n", "h", "g").agg(F.min("slug").alias("rep"), F.count(F.lit(1)).alias("members"))
    twin = written(alike.join(firsts, ["page", "n", "h", "g"]).select("slug", "rep", "members"))
    # Both sets have n neighbours, so one that lies within the other is equal to it.
    other = both.join(twin.where("slug <> rep"), "slug").join(both.select(F.col("slug").alias("rep"), "next"), ["rep", "next"], "left_anti").select("slug").distinct().withColumn("alone", F.lit(True))
    alone = F.col("alone").isNotNull()
    return written(twin.join(other, "slug", "left").select("slug", F.when(alone, F.col("slug")).otherwise(F.col("rep")).alias("rep"), F.when(alone, 1).otherwise(F.col("members")).alias("members")))


def khop(links: DataFrame, pages: DataFrame, starts: DataFrame, depth: int, written) -> DataFrame:
    """(origin, slug, depth): neighbours in either direction; dangling ones are returned but lead nowhere.

    Twins have the same distances to all others, and are two apart themselves.  So only their representatives walk, and
    the pairs found are multiplied by lists of their members at the end, which moves lists and no pairs of members.
    """
    both = links.select(F.col("source").alias("slug"), F.col("target").alias("next")).union(links.select("target", "source")).where("slug <> next")
    both = written(both.distinct())
    twin = _twins(both, pages, written)
    reps = twin.where("slug = rep").select("slug")
    few = written(both.join(reps, "slug", "left_semi").join(reps.toDF("next"), "next", "left_semi").join(pages, "slug", "left_semi").select("slug", "next"))
    begun = twin.join(starts, "slug", "left_semi")
    front = begun.select(F.col("rep").alias("origin"), F.col("rep").alias("slug")).distinct()
    seen = None
    for k in range(1, depth + 1):  # the start itself is not seen: coming back to it tells how far its twins are
        step = front.join(few, "slug").select("origin", F.col("next").alias("slug")).distinct()
        front = written(step if seen is None else step.join(seen, ["origin", "slug"], "left_anti"))
        found = front.withColumn("depth", F.lit(k))
        seen = found if seen is None else seen.unionByName(found)
    # Representatives of so many are a hundredth of all nodes at most; the others have one list.
    large = F.broadcast(twin.where((F.col("members") > _LIST // 10) & (F.col("slug") == F.col("rep"))).select("rep", "members"))
    n_lists = F.ceil(F.coalesce("members", F.lit(1)) / _LIST).cast("int")
    every = lambda of, c: of.join(large.toDF(c, "members"), c, "left").withColumn(f"{c}_list", F.explode(F.sequence(F.lit(0), n_lists - 1))).withColumn("rows", F.col("rows") * F.coalesce("members", F.lit(1)) / n_lists).drop("members")
    pairs = every(every(seen.withColumn("rows", F.lit(1.0)), "origin"), "slug")
    # Few bytes become many rows, so the tasks of the last join follow the rows, not the bytes.
    n_pairs, rows = pairs.agg(F.count(F.lit(1)), F.sum("rows")).first()
    n = max(links.sparkSession.sparkContext.defaultParallelism, -(-n_pairs // _PAIRS), math.ceil((rows or 0) / _ROWS))
    dealt = lambda of, c: of.select(F.col("rep").alias(c), F.pmod(F.xxhash64("slug"), n_lists).cast("int").alias(f"{c}_list"), F.col("slug").alias("member"))
    lists = lambda of, c: of.groupBy(c, f"{c}_list").agg(F.collect_list("member").alias(f"{c}s"))
    pairs = _met(pairs, lists(dealt(begun, "origin"), "origin"), ["origin", "origin_list"]).select("origins", "slug", "slug_list", "depth")
    pairs = _met(pairs.repartition(n, "slug", "slug_list"), lists(dealt(twin, "slug").repartition(n, "slug", "slug_list"), "slug"), ["slug", "slug_list"])
    # Two plain explodes are compiled into one loop, which holds all rows of a pair of lists before it passes one on; the lambda keeps them apart, so it is one list.
    one = pairs.select(F.explode(F.transform("origins", lambda x: x)).alias("origin"), "slugs", "depth")
    return one.select("origin", F.explode("slugs").alias("slug"), "depth").where("origin <> slug")


def stale(links: DataFrame, causes: DataFrame, written) -> DataFrame:
    """(slug, cause, root): pages with a cause of their own, and those that reach one by links, with the smallest such page.

    Rounds go on until none adds a page or lowers a root; each is written by ``written`` to cut its lineage.
    """
    state = written(causes.select("slug", F.col("slug").alias("root")))
    marks = None
    while True:
        step = links.join(state, F.col("target") == F.col("slug")).select(F.col("source").alias("slug"), "root")
        state = written(state.unionByName(step).groupBy("slug").agg(F.min("root").alias("root")))
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("slug", "root").cast("decimal(38,0)"))).first()
        if now == marks:
            break
        marks = now
    # A page with a cause of its own tells that; the others name their smallest root.
    return state.join(causes, "slug", "left").select("slug", F.coalesce("cause", F.lit("Dependency")).alias("cause"), F.when(F.col("cause").isNull(), F.col("root")).alias("root"))


#: So many rounds of moves without a better modularity end a level.
_PATIENCE = 4


def _settled(edges: DataFrame, label: DataFrame, total: float, written) -> tuple[DataFrame, float]:
    """(a, k, c) and its modularity: from (a, k, c), the best labelling met while nodes move.

    In each round those nodes that a hash of node and round picks, about half, move to the community of their
    neighbours with the largest gain (ties: the smallest label), so neighbours seldom swap.  Rounds go on until no node,
    picked or not, would gain, or the modularity has not risen for some rounds.
    """
    inner = total - (edges.agg(F.sum("w")).first()[0] or 0.0)  # links within what has become one node
    best, top, since, i = label, None, 0, 0
    while True:
        volume = label.groupBy("c").agg(F.sum("k").alias("v"))
        near = _met(edges, label.select(F.col("a").alias("b"), "c"), "b").groupBy("a", "c").agg(F.sum("w").alias("w"))
        own = _met(label, volume, "c").select("a", "k", F.col("c").alias("now"), (-F.col("k") * (F.col("v") - F.col("k")) / total).alias("alone"))
        home = F.col("c") == F.col("now")
        scored = _met(_met(near, volume, "c"), own, "a").withColumn("gain", F.col("w") - F.col("k") * (F.col("v") - F.when(home, F.col("k")).otherwise(0)) / total)
        choice = scored.groupBy("a").agg(F.max(F.struct("gain", (-F.col("c")).alias("less"))).alias("g"), F.max(F.when(home, F.col("gain"))).alias("linked"), F.first("alone").alias("alone"), F.sum(F.when(home, F.col("w"))).alias("inside"))
        gains = F.coalesce(F.col("g.gain") > F.coalesce("linked", "alone") + 1e-12, F.lit(False))
        seen = written(_met(label, choice, "a", "left").select("a", "k", "c", gains.alias("gains"), (-F.col("g.less")).alias("into"), F.coalesce("inside", F.lit(0.0)).alias("inside")))
        by = seen.groupBy("c").agg(F.sum("k").alias("v"), F.sum("inside").alias("x"), F.count_if("gains").alias("n"))
        x, y, n = by.agg(F.sum("x"), F.sum((F.col("v") / total) * (F.col("v") / total)), F.sum("n")).first()
        found = ((x or 0.0) + inner) / total - (y or 0.0)
        if top is None or found > top + 1e-12:
            best, top, since = seen.select("a", "k", "c"), found, 0
        else:
            since += 1
        if not n or since >= _PATIENCE:
            return best, top
        picked = F.pmod(F.xxhash64("a", F.lit(i)), F.lit(2)) == 0
        label, i = seen.select("a", "k", F.when(F.col("gains") & picked, F.col("into")).otherwise(F.col("c")).alias("c")), i + 1


def communities(links: DataFrame, pages: DataFrame, written) -> DataFrame:
    """(slug, community): Louvain's levels on the undirected simple graph of known pages; pages without links are left out.

    On each level nodes move until they settle; then each community becomes one node, with the weights of the links
    between communities and the sum of its members' degrees (links inside stay in that sum), until no two nodes join.
    Then pages move again from the communities found, and so on while the modularity rises.  A community is called by
    its smallest slug.  The result does not depend on how rows are dealt out.
    """
    known = _met(_met(links, pages, F.col("source") == F.col("slug"), "left_semi"), pages, F.col("target") == F.col("slug"), "left_semi")
    pairs = known.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    all_edges = written(pairs.union(pairs.select("b", "a")).toDF("a", "b").withColumn("w", F.lit(1.0)))
    all_nodes = written(all_edges.groupBy("a").agg(F.sum("w").alias("k")))
    total = all_nodes.agg(F.sum("k")).first()[0] or 1.0
    kept, last = all_nodes.select(F.col("a").alias("slug"), F.col("a").alias("c")), None
    while True:
        edges, member, top = all_edges, all_nodes.select(F.col("a").alias("slug"), F.col("a").alias("c")), None
        start = written(_met(all_nodes, kept.select(F.col("slug").alias("a"), "c"), "a"))
        while True:
            label, found = _settled(edges, start, total, written)
            if top is not None and found <= top + 1e-12:
                break
            top = found
            to = label.select("a", F.col("c").alias("into"))
            member = written(_met(member, to, F.col("c") == F.col("a")).select("slug", F.col("into").alias("c")))
            merged = _met(_met(edges, to, "a").select(F.col("into").alias("a"), "b", "w"), to.toDF("b", "to"), "b").where("a <> to")
            edges = written(merged.groupBy("a", F.col("to").alias("b")).agg(F.sum("w").alias("w")))
            start = written(label.groupBy(F.col("c").alias("a")).agg(F.sum("k").alias("k")).withColumn("c", F.col("a")))
        if last is not None and top <= last + 1e-9:
            break
        kept, last = member, top
    names = kept.groupBy("c").agg(F.min("slug").alias("community"))
    return _met(kept, names, "c").select("slug", "community")


def by_size(member: DataFrame, written) -> DataFrame:
    """(community, size, place): the communities from large to small, equals by name, numbered from 1."""
    sizes = member.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    return numbered(sizes, [F.desc("size"), F.col("community")], "place", written).withColumn("place", F.col("place") + 1)


def representatives(links: DataFrame, member: DataFrame) -> DataFrame:
    """(community, representative): the member with the most links to known pages in either direction, of equals the smallest slug."""
    pairs = links.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    inner = pairs.join(member.select(F.col("slug").alias("a")), "a", "left_semi").join(member.select(F.col("slug").alias("b")), "b", "left_semi")
    degree = inner.select(F.explode(F.array("a", "b")).alias("slug")).groupBy("slug").agg(F.count(F.lit(1)).alias("degree"))
    known = member.join(degree, "slug", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return known.groupBy("community").agg(F.max(F.struct("degree", (-F.col("slug")).alias("less"))).alias("m")).select("community", (-F.col("m.less")).alias("representative"))


def cohesion(links: DataFrame, member: DataFrame) -> DataFrame:
    """(community, size, cohesion): internal pairs over all possible ones, two decimals."""
    pairs = links.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    inside = pairs.join(member.select(F.col("slug").alias("a"), "community"), "a").join(member.select(F.col("slug").alias("b"), F.col("community").alias("c2")), "b").where("community = c2").groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    size = member.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    return size.join(inside, "community", "left").select("community", "size", F.when(F.col("size") > 1, F.round(2 * F.coalesce("n", F.lit(0)) / (F.col("size") * (F.col("size") - 1)), 2)).alias("cohesion"))


def expired(updated: Column, after: Column, now: Column) -> Column:
    return F.coalesce(updated + after <= now, F.lit(False))
