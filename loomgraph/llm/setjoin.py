"""Exact n-gram Jaccard self-join by set-relation skipping, as components of linked documents.

Index.  A document's set is ordered by (document frequency, hash), so two sets
that link share a token among the first n - ceil(0.8 n) + 1 of each.  Document
frequencies come from one packed shuffle: tokens are dealt by hash range, four
bytes each, tokens that occur in several documents of a block of texts once with
their count, and only tokens found in two documents or more are answered.  A
document with too many tokens of its own is thereby done: it links with nothing.

Skipping by position.  Posting lists fall into blocks by size (steps of 1/0.8).
A block only meets the block of the next larger sizes, and an entry whose
position leaves too few tokens for any of these skips it.

Deriving answers.  The most central set of a list, its pivot, is compared with
all others of the list; that gives exact overlaps.  Sets that link with the pivot
need no comparison with each other, as they are of one component.  For two other
sets x and y of the list, overlap(x, y) <= min(o_x, o_y) + min(n_x - o_x, n_y - o_y),
with o_x and o_y the overlaps with the pivot that were computed: most answers
answers follow from the pivot's, and the few pairs left over are compared as well.

Counting links.  All links lie within components, whose sets are dealt into chunks;
each pair of chunks is one group, in which a pivot's overlaps settle most pairs
likewise (overlap(x, y) >= o_x + o_y - n_pivot) and the others are compared.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import hashing
from loomgraph.llm.common import arrow_map, dropped, release, stored, table
from loomgraph.llm.components import components

#: Links need 100 * intersection >= PERCENT * union.
PERCENT, WIDTH = 80, 5
#: A part of the token space has about so many tokens.
PART_TOKENS = 2_000_000
#: A chunk of a component has about so many tokens and sets at most.
CHUNK_TOKENS, CHUNK_SETS = 500_000, 1_000
#: A component with enough sets has so many chunks at least, of so many sets or more, that its pairs are dealt to several tasks.
SPREAD, SPREAD_SETS = 8, 100


def need(n: int, percent: int) -> int:
    """The least overlap that a set of n has with any set it links with."""
    return -(-percent * n // 100)


def signature(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums over a set."""
    with np.errstate(over="ignore"):
        a = hashing.mix(s + np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)
        b = hashing.mix(s ^ np.uint64(0x9FB21C651E98DF25)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _fragments(parts: int, width: int):
    """Reads (id, text). For each block of texts: one row about its documents (part -1), and one for each part of the token space that it has tokens in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = (TaskContext.get().partitionId() << 33) - 1
        for batch in batches:
            for first, last, data, ends in hashing.chunks(batch.column(1)):
                for lo in range(0, last - first, 60_000):  # owners are 16-bit
                    hi = min(last - first, lo + 60_000)
                    chunk += 1
                    sets = hashing.shingle_sets(data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo], width)
                    sizes = [len(s) for s in sets]
                    tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                    owner = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
                    order = np.argsort(tokens, kind="stable")
                    tokens, owner = tokens[order], owner[order]
                    begin = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, np.int64)
                    count = np.diff(np.append(begin, len(tokens)))
                    many = np.repeat(count > 1, count)
                    marks = [signature(s) for s in sets]
                    own = struct.pack("<I", int((count > 1).sum())) + count[count > 1].astype("<u2").tobytes() + owner[many].astype("<u2").tobytes()
                    rows_part, rows_data = [-1], [own]
                    t, c, o = tokens[begin], count, owner[begin]
                    place = ((t >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                    cuts = np.searchsorted(place, np.arange(parts + 1, dtype=np.uint64))
                    low = (t & np.uint64(0xFFFFFFFF)).astype("<u4")
                    for p in np.flatnonzero(np.diff(cuts)).tolist():
                        a, b = cuts[p], cuts[p + 1]
                        single = c[a:b] == 1
                        rows_part.append(p)
                        rows_data.append(struct.pack("<I", int(single.sum())) + low[a:b][single].tobytes() + low[a:b][~single].tobytes() + o[a:b][single].astype("<u2").tobytes() + c[a:b][~single].astype("<u2").tobytes())
                    k = len(rows_part)
                    blank = [None] * (k - 1)
                    ids = batch.column(0).slice(first + lo, hi - lo)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([chunk] * k, pa.int64()), pa.array(rows_part, pa.int32()), pa.array(rows_data, pa.binary()), pa.array([ids.to_pylist(), *blank], pa.list_(ids.type)), pa.array([sizes, *blank], pa.list_(pa.int32())), pa.array([[x for x, _ in marks], *blank], pa.list_(pa.int64())), pa.array([[x for _, x in marks], *blank], pa.list_(pa.int64()))],
                        ["chunk", "part", "data", "ids", "sizes", "s1", "s2"],
                    )

    return run


def _answer(group: pa.Table) -> pa.Table:
    """One part of the token space: for each block its tokens of two documents or more, with their document frequencies."""
    chunks, part = group.column("chunk").to_pylist(), group.column("part")[0].as_py()
    lows, counts, owners, shape = [], [], [], []
    for value in group.column("data"):
        raw = value.as_py()
        k = struct.unpack_from("<I", raw)[0]
        n = (len(raw) - 4) // 6
        lows.append(np.frombuffer(raw, "<u4", n, 4))
        rest = np.frombuffer(raw, "<u2", n, 4 + 4 * n)
        counts.append(np.concatenate((np.ones(k, np.uint16), rest[k:])))
        owners.append(rest[:k])
        shape.append((k, n))
    low = np.concatenate(lows)
    order = np.argsort(low, kind="stable")
    sorted_ = low[order]
    begin = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
    total = np.add.reduceat(np.concatenate(counts).astype(np.int64)[order], begin)
    df = np.empty(len(low), np.int64)
    df[order] = np.repeat(total, np.diff(np.append(begin, len(low))))
    out, at = [], 0
    for (k, n), own in zip(shape, owners, strict=True):
        d, x = np.minimum(df[at : at + n], 0xFFFFFFFF), low[at : at + n]
        hit = np.flatnonzero(d[:k] > 1)
        out.append(struct.pack("<I", len(hit)) + x[hit].tobytes() + d[hit].astype("<u4").tobytes() + x[k:].tobytes() + d[k:].astype("<u4").tobytes() + own[hit].tobytes())
        at += n
    del low, order, sorted_, df, counts
    release()
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "part": pa.array([part] * len(out), pa.int32()), "answer": pa.array(out, pa.binary())})


def _assemble(percent: int, id_type: pa.DataType):
    """All rows of one block of texts: for each document its size, signature, and if it may link its index tokens."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("part").to_pylist(), group.column("answer").to_pylist(), range(group.num_rows), strict=True))
        about = group.slice(rows[0][2], 1).to_pylist()[0]
        raw = about["answer"]
        n_many = struct.unpack_from("<I", raw)[0]
        per = np.frombuffer(raw, "<u2", n_many, 4).astype(np.int64)
        owners_many = np.frombuffer(raw, "<u2", int(per.sum()), 4 + 2 * n_many)
        own, tok, df, tok_m, df_m = [], [], [], [], []
        for part, raw, _ in rows[1:]:
            k = struct.unpack_from("<I", raw)[0]
            m = (len(raw) - 4 - 10 * k) // 8
            high = np.int64(part) << np.int64(32)
            tok.append(np.frombuffer(raw, "<u4", k, 4).astype(np.int64) | high)
            df.append(np.frombuffer(raw, "<u4", k, 4 + 4 * k))
            tok_m.append(np.frombuffer(raw, "<u4", m, 4 + 8 * k).astype(np.int64) | high)
            df_m.append(np.frombuffer(raw, "<u4", m, 4 + 8 * k + 4 * m))
            own.append(np.frombuffer(raw, "<u2", k, 4 + 8 * k + 8 * m))
        sizes = np.array(about["sizes"], np.int64)
        if tok:
            own_all = np.concatenate([*own, owners_many]).astype(np.int64)
            tok_all = np.concatenate([*tok, np.repeat(np.concatenate(tok_m), per)])
            df_all = np.concatenate([*df, np.repeat(np.concatenate(df_m), per)]).astype(np.int64)
        else:
            own_all = tok_all = df_all = np.zeros(0, np.int64)
        shared = np.bincount(own_all, minlength=len(sizes))
        least = -(-percent * sizes // 100)
        alive = (sizes > 0) & (shared >= least)
        keep = alive[own_all]
        own_all, tok_all, df_all = own_all[keep], tok_all[keep], df_all[keep]
        order = np.lexsort((tok_all, df_all, own_all))
        own_all, tok_all = own_all[order], tok_all[order]
        cuts = np.searchsorted(own_all, np.arange(len(sizes) + 1))
        alone = sizes - shared
        tokens = [tok_all[cuts[i] : cuts[i] + int(sizes[i] - least[i] + 1 - alone[i])].tolist() if alive[i] else None for i in range(len(sizes))]
        return pa.table({"id": pa.array(about["ids"], id_type), "n": pa.array(sizes, pa.int64()), "s1": pa.array(about["s1"], pa.int64()), "s2": pa.array(about["s2"], pa.int64()), "alone": pa.array(alone, pa.int64()), "tokens": pa.array(tokens, pa.list_(pa.int64()))})

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, ends in hashing.chunks(batch.column(1)):
                sets = hashing.shingle_sets(data, ends, width)
                marks = [signature(s) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array([x for x, _ in marks], pa.int64()), pa.array([x for _, x in marks], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["rep", "s1", "s2", "tokens"])

    return run


def _least_overlap(percent: int, m: Column, n: Column) -> Column:
    """The least overlap of linked sets of m and n: 100 o >= p (m + n - o)."""
    return F.ceil(percent * (m + n) / F.lit(100.0 + percent) - 1e-9)


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds o, the exact overlap of the sets a and b."""
    one = sets.select(F.col("rep").alias("b"), F.col("tokens").alias("y"))
    two = sets.select(F.col("rep").alias("a"), F.col("tokens").alias("x"))
    joined = pairs.join(one, "b").join(two, "a")
    return joined.select("a", "b", "na", "nb", F.size(F.array_intersect("x", "y")).cast("long").alias("o"))


def link_counts(tokens: np.ndarray, ends: np.ndarray, side: np.ndarray, within: bool, percent: int) -> np.ndarray:
    """How many of the others each set links with, or how many of those of another side; set i is tokens[ends[i]:ends[i + 1]]."""
    order = np.argsort(np.diff(ends), kind="stable")
    n, side = np.diff(ends)[order], side[order]
    stops = np.cumsum(n)
    _, known = np.unique(tokens, return_inverse=True)
    known = np.concatenate([known[ends[i] : ends[i + 1]] for i in order])
    own = np.split(known, stops[:-1])
    mark = np.zeros(int(known.max()) + 1, bool)
    pivot = len(n) // 2
    mark[own[pivot]] = True
    o = np.add.reduceat(mark[known], stops - n, dtype=np.int64)
    mark[own[pivot]] = False
    counts = np.zeros(len(n), np.int64)
    last = np.searchsorted(n * percent, 100 * n, "right")  # larger sets have no link with this one
    for x in range(len(n)):
        y = np.arange(x + 1, last[x])
        if not within:
            y = y[side[y] != side[x]]
        least = -(-percent * (n[x] + n[y]) // (100 + percent))
        sure = o[x] + o[y] - n[pivot] >= least
        open_ = ~sure & (np.minimum(o[x], o[y]) + np.minimum(n[x] - o[x], n[y] - o[y]) >= least)
        hit = y[sure]
        y, least = y[open_], least[open_]
        if len(y):
            mark[own[x]] = True
            shared = np.add.reduceat(mark[np.concatenate([own[i] for i in y])], np.cumsum(n[y]) - n[y], dtype=np.int64)
            mark[own[x]] = False
            hit = np.concatenate((hit, y[shared >= least]))
        counts[x] += len(hit)
        counts[hit] += 1
    out = np.empty(len(n), np.int64)
    out[order] = counts
    return out


def _count_links(percent: int):
    """Some pairs of chunks: for each set of one how many sets it links with there."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        keys = [group.column(c).to_numpy() for c in ("label", "lo", "hi")]
        chunk = group.column("chunk").to_numpy()
        lists = group.column("tokens").chunk(0)
        values, cuts = lists.values.to_numpy(), lists.offsets.to_numpy()
        order = np.lexsort(keys[::-1])
        new = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        counts = np.zeros(len(order), np.int64)
        for rows in np.split(order, np.flatnonzero(new) + 1):
            if len(rows) > 1:
                own = [values[cuts[i] : cuts[i + 1]] for i in rows]
                counts[rows] = link_counts(np.concatenate(own), np.cumsum([0, *map(len, own)]), chunk[rows], keys[1][rows[0]] == keys[2][rows[0]], percent)
        out = pa.table({"rep": group.column("rep"), "n_links": pa.array(counts)})
        release()
        return out

    return run


def _degrees(label: DataFrame, sets: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(rep, n_links) for the nodes of label: with how many sets of its component each set links."""
    id_type = label.schema["node"].dataType.simpleString()
    member = sets.select("rep", F.size("tokens").alias("n")).join(label.withColumnRenamed("node", "rep"), "rep")
    member = stored(member)
    k = F.count(F.lit(1))
    spread = F.least(k / SPREAD_SETS, F.lit(float(SPREAD)))
    chunks = F.ceil(F.greatest(F.sum("n") / CHUNK_TOKENS, k / CHUNK_SETS, spread)).cast("int")
    member = member.join(member.groupBy("label").agg(chunks.alias("q")), "label")
    member = stored(member.select("rep", F.xxhash64("label").alias("label"), "q", F.pmod(F.xxhash64("rep"), "q").cast("int").alias("chunk")))
    pairs = sets.join(member.hint("merge"), "rep").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    pairs = pairs.withColumn("lo", F.least("chunk", "with")).withColumn("hi", F.greatest("chunk", "with"))
    group = F.when(F.col("q") == 1, F.pmod("label", F.lit(buckets))).otherwise(F.xxhash64("label", "lo", "hi"))
    pairs = pairs.select(group.alias("g"), "label", "lo", "hi", "chunk", "rep", "tokens")
    found = pairs.groupBy("g").applyInArrow(_count_links(percent), f"rep {id_type}, n_links long")
    return found.groupBy("rep").agg(F.sum("n_links").alias("n_links"))


def linked_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = WIDTH, part_tokens: int = PART_TOKENS, count_links: bool = True) -> DataFrame:
    """One row for each row of docs: id_col, n_shingles, component_id, and if count_links n_links (how many other sets this one links with).

    A-Z count as lower case; words are ``[^\\x20\\x09-\\x0D]+``.  The set of a
    text has the distinct shingles of ``width`` words, or the whole sequence of
    a shorter text; without words (or with a null text) it is empty, and such a
    row is alone.  component_id is the smallest id reachable by links.  Rows
    with equal sets are one class.  Rows that repeat an id are one node; a null
    id is a row like others, its component the smallest known id it reaches, or
    null.  An empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType
    id_type = kind.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, math.ceil(size / 6 / part_tokens))
    frag = stored(arrow_map(source, _fragments(parts, width), f"chunk long, part int, data binary, ids array<{id_type}>, sizes array<int>, s1 array<long>, s2 array<long>"))
    about = frag.where("part = -1").select("chunk", "part", F.col("data").alias("answer"), "ids", "sizes", "s1", "s2")
    answers = frag.where("part >= 0").select("chunk", "part", "data").groupBy("part").applyInArrow(_answer, "chunk long, part int, answer binary")
    from pyspark.sql.pandas.types import to_arrow_type

    docs_ = about.unionByName(answers, allowMissingColumns=True).groupBy("chunk").applyInArrow(_assemble(percent, to_arrow_type(kind)), f"id {id_type}, n long, s1 long, s2 long, alone long, tokens array<long>")
    docs_ = stored(docs_)
    dropped(frag)

    classes = docs_.where("tokens is not null").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.first("alone").alias("alone"), F.first("tokens").alias("tokens"))
    classes = stored(classes)
    band = F.floor(F.log("n") / math.log(100 / percent) + 1e-9).cast("int")
    entry = classes.where("rep is not null").select("rep", "n", "alone", band.alias("band"), F.posexplode("tokens").alias("i", "token")).withColumn("room", F.col("n") - F.col("alone") - F.col("i"))
    # A block of a list: the sets of one size step, and as guests those of the next that some set here can still reach from its position.
    home = entry.select("token", F.col("band").alias("block"), "rep", "n", "alone", "room", F.lit(True).alias("home"))
    guest = entry.select("token", (F.col("band") - 1).alias("block"), "rep", "n", "alone", "room", F.lit(False).alias("home"))
    far = home.groupBy("token", "block").agg(F.max("room").alias("most"))
    guest = guest.join(far, ["token", "block"]).where(F.col("most") * 100 >= percent * F.col("n")).drop("most")
    members = listed = stored(home.unionByName(guest))
    pivot = F.min(F.struct((F.col("alone") / F.col("n")).alias("by"), F.col("rep").alias("r"), F.col("n").alias("rn"), F.col("room").alias("rroom")))
    lists = stored(members.groupBy("token", "block").agg(F.count(F.lit(1)).alias("k"), pivot.alias("p")).where("k > 1").select("token", "block", "p.*").drop("by"))
    members = members.join(lists, ["token", "block"])
    fits = lambda m, n, room, other: (F.least(room, other) >= _least_overlap(percent, m, n)) & (100 * F.least(m, n) >= percent * F.greatest(m, n))
    star = members.where((F.col("rep") != F.col("r")) & fits(F.col("n"), F.col("rn"), F.col("room"), F.col("rroom")))
    turn = F.col("rep") < F.col("r")
    star = star.select(F.least("rep", "r").alias("a"), F.greatest("rep", "r").alias("b"), F.when(turn, F.col("n")).otherwise(F.col("rn")).alias("na"), F.when(turn, F.col("rn")).otherwise(F.col("n")).alias("nb")).distinct()
    names = classes.select(F.col("rep").alias("id"), "s1", "s2").where("id is not null")
    sets = arrow_map(source.join(names.select("id").distinct(), "id", "left_semi"), _sets(width), f"rep {id_type}, s1 long, s2 long, tokens array<long>")
    sets = stored(sets.join(names.withColumnRenamed("id", "rep"), ["rep", "s1", "s2"]).dropDuplicates(["rep"]).select("rep", "tokens"))
    known = stored(_overlaps(star, sets))
    linked = 100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o"))
    label = stored(components(known.where(linked).select("a", "b")))

    # What the pivots' answers leave open.
    m = members.join(label.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    m = m.join(label.select(F.col("node").alias("r"), F.col("label").alias("rlabel")), "r", "left").withColumn("rlabel", F.coalesce("rlabel", "r"))
    m = first_m = stored(m)
    dropped(listed, lists)
    several = m.groupBy("token", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum((F.col("label") != F.col("rlabel")).cast("int")).alias("others")).where("lo != hi").select("token", "block")
    several = stored(several)
    m = m.join(several, ["token", "block"])
    m = m.withColumn("a", F.least("rep", "r")).withColumn("b", F.greatest("rep", "r")).join(known.select("a", "b", "o"), ["a", "b"], "left").drop("a", "b")
    m = m.withColumn("o", F.when(F.col("rep") == F.col("r"), F.col("n")).otherwise(F.col("o"))).withColumn("inside", F.col("label") == F.col("rlabel"))
    m = second_m = stored(m.where("rep != r"))
    dropped(first_m, several)
    reach = m.groupBy("token", "block").agg(F.max(F.when(F.col("inside"), F.coalesce(F.col("n") - F.col("o"), F.col("n")))).alias("in_new"), F.max(F.when(~F.col("inside"), F.coalesce("o", "n"))).alias("out_o"))
    reach = stored(reach)
    m = m.join(reach, ["token", "block"])
    # x inside needs new tokens enough to make up what the others have less of the pivot.
    m = m.where(~F.col("inside") | F.col("o").isNull() | ((F.col("n") - F.col("o") + F.col("out_o")) * 100 >= percent * F.col("n")))
    m = stored(m.select("token", "block", "rep", "n", "room", "o", "label", "inside", "home"))
    dropped(second_m, reach)
    x = m.where(~F.col("inside")).alias("x")
    y = m.alias("y")
    c = lambda s, n: F.col(f"{s}.{n}")
    bound = F.coalesce(F.least(c("x", "o"), c("y", "o")) + F.least(c("x", "n") - c("x", "o"), c("y", "n") - c("y", "o")), F.least(c("x", "n"), c("y", "n")))
    open_ = x.join(
        y,
        (c("x", "token") == c("y", "token")) & (c("x", "block") == c("y", "block")) & (c("x", "label") != c("y", "label")) & (c("x", "home") | c("y", "home"))
        & (c("y", "inside") | (c("x", "rep") < c("y", "rep")))
        & fits(c("x", "n"), c("y", "n"), c("x", "room"), c("y", "room")) & (bound >= _least_overlap(percent, c("x", "n"), c("y", "n"))),
    )
    first = c("x", "rep") < c("y", "rep")
    open_ = open_.select(F.least(c("x", "rep"), c("y", "rep")).alias("a"), F.greatest(c("x", "rep"), c("y", "rep")).alias("b"), F.when(first, c("x", "n")).otherwise(c("y", "n")).alias("na"), F.when(first, c("y", "n")).otherwise(c("x", "n")).alias("nb")).distinct().join(known.select("a", "b"), ["a", "b"], "left_anti")
    open_ = stored(open_)
    more = stored(_overlaps(open_, sets))
    dropped(m, open_)
    links = known.unionByName(more).where(linked).select("a", "b")
    if not more.where(linked).isEmpty():
        label = stored(components(links))
    of = classes.select("n", "s1", "s2", "rep").join(label.select(F.col("node").alias("rep"), "label"), "rep", "left")
    if count_links:
        of = of.join(stored(_degrees(label, sets, percent, 4 * parts)), "rep", "left")
    else:
        of = of.withColumn("n_links", F.lit(None).cast("long"))
    of = stored(of.select("n", "s1", "s2", F.coalesce("label", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    dropped(known, more, sets, classes, label)
    out = docs_.select("id", "n", "s1", "s2").join(of, ["n", "s1", "s2"], "left")
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return out if count_links else out.drop("n_links")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Of each component the row with the smallest id, and all rows without words.

    Rows that repeat an id are told apart by their sets: of a component with
    several rows of its smallest id, one set stays with all its rows.  A component
    whose rows all lack an id keeps one of its sets.
    """
    own = linked_components(docs, id_col, text_col, count_links=False, **options)
    own = own.where((F.col("n_shingles") > 0) & ~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col)).distinct()
    return docs.join(stored(own), id_col, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(table(spark, sf_dir, "documents"))
