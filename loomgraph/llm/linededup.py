"""Line deduplication by winnowing over line hashes.

The non-blank lines of a text, trimmed, are hashed.  A run of lines counts if it has
``run`` lines or ``words`` words.  Windows are the shortest runs that count from each line
and up to each line: every line of a run that counts lies in a window within that run.
The line with the least hash in a window (of equals, the last) is a fingerprint.  So every
repeated window holds a fingerprint, at the same place wherever it occurs, and a text has
far fewer of them than windows.

Fingerprints are joined by their line's hash: each occurrence with the first of the
corpus.  From there the match is extended both ways, as far as the windows that chose the
fingerprint reach, and those within the match are later occurrences: they go.  A line that
is common by itself may meet its first occurrence in other company.  Then the windows that
are not part of the match are joined once more, by all their lines: each with the first one
like it that is open too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import hashing
from loomgraph.llm.common import dropped, stored, table

RUN, WORDS = 3, 50


def _shortest(at: np.ndarray, run: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the shortest run that counts from each line that has one; at has the words before each line."""
    n = len(at) - 1
    begin = np.arange(n)
    end = np.minimum(begin + run, np.searchsorted(at, at[:-1] + words, "left"))
    begin = begin[end <= n]
    return begin, end[: len(begin)]


def windows(h: np.ndarray, sizes: np.ndarray, run: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, place of the least hash) of the windows; line i has hash h[i] and sizes[i] words."""
    n = len(h)
    at = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    begin, end = _shortest(at, run, words)
    stop, start = (n - x for x in _shortest(at[-1] - at[::-1], run, words))
    spans = np.unique(np.concatenate((begin * (n + 1) + end, start * (n + 1) + stop)))
    begin, end = spans // (n + 1), spans % (n + 1)
    place = np.zeros(len(begin), np.int64)
    for size in range(1, run + 1):
        own = np.flatnonzero(end - begin == size)
        if len(own):
            w = np.lib.stride_tricks.sliding_window_view(h, size)[begin[own]]
            place[own] = begin[own] + size - 1 - w[:, ::-1].argmin(axis=1)
    return begin, end, place


def hash_line(line: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(line)


def _lines(run: int, words: int):
    """(id, text) to (id, lines, sizes, numbers, keys, places): the hashes, word counts and numbers of all lines; fingerprints and where they are."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, sizes, numbers, keys, places = [], [], [], [], []
            for text in batch.column(1):
                whole = (text.as_py() or "").encode("utf-8", "surrogatepass")
                trimmed = [x.strip(hashing.WHITESPACE) for x in whole.split(b"\n")]
                own = [i for i, x in enumerate(trimmed) if x]
                parts = [trimmed[i] for i in own]
                data = np.frombuffer(b"".join(parts), np.uint8)
                h = np.fromiter(map(hash_line, parts), np.uint64, len(parts))
                _, _, at = hashing.word_spans(data, np.cumsum([0, *map(len, parts)]))
                count = np.diff(at).astype(np.int32)
                chosen = np.unique(windows(h, count, run, words)[2])
                lines.append(h.view(np.int64))
                sizes.append(count)
                numbers.append(own)
                keys.append(h[chosen].view(np.int64))
                places.append(chosen.astype(np.int32))
            long_, int_ = pa.list_(pa.int64()), pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, long_), pa.array(sizes, int_), pa.array(numbers, int_), pa.array(keys, long_), pa.array(places, int_)], ["id", "lines", "sizes", "numbers", "keys", "places"])

    return go


def _slice(reach: int):
    """(id, wanted, lines, sizes) to a row for each wanted place: (id, at, low, lines, sizes), the lines from low on within reach of it."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, low, lines, sizes = [], [], [], [], []
            for i, (wanted, h, n) in enumerate(zip(batch.column(1), batch.column(2), batch.column(3), strict=True)):
                wanted, h, n = wanted.values.to_numpy(), h.values.to_numpy(), n.values.to_numpy()
                for p in wanted.tolist():
                    a = max(0, p - reach)
                    rows.append(i)
                    at.append(p)
                    low.append(a)
                    lines.append(h[a : p + reach + 1])
                    sizes.append(n[a : p + reach + 1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(at, pa.int32()), pa.array(low, pa.int32()), pa.array(lines, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))], ["id", "at", "low", "lines", "sizes"])

    return go


def extended(x: np.ndarray, at: int, y: np.ndarray, there: int) -> tuple[int, int]:
    """The longest equal run through x[at] and y[there], as a range of x."""
    back = min(at, there)
    differ = np.flatnonzero(x[at - back : at][::-1] != y[there - back : there][::-1])
    begin = at - (int(differ[0]) if len(differ) else back)
    ahead = min(len(x) - at, len(y) - there)
    differ = np.flatnonzero(x[at : at + ahead] != y[there : there + ahead])
    return begin, at + (int(differ[0]) if len(differ) else ahead)


def _extend(run: int, words: int):
    """(id, at, low, lines, sizes, first_at, first_low, first_lines, same) to (id, runs, open): what goes, and the windows that chose the place and are not part of the match.

    With same, both are of one text, and what goes begins after the first
    occurrence.  A window is open by its begin, end and 128 bits of its lines'
    hashes and the place chosen.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        span = pa.struct([("begin", pa.int32()), ("stop", pa.int32())])
        window = pa.struct([("begin", pa.int32()), ("stop", pa.int32()), ("key", pa.binary())])
        for batch in batches:
            runs, open_ = [], []
            c = [batch.column(k) for k in range(1, 9)]
            for p, low, h, n, q, first_low, other, same in zip(c[0].to_pylist(), c[1].to_pylist(), c[2], c[3], c[4].to_pylist(), c[5].to_pylist(), c[6], c[7].to_pylist(), strict=True):
                h, n, other = h.values.to_numpy(), n.values.to_numpy(), other.values.to_numpy()
                a, b = extended(h, p - low, other, q - first_low)
                gone, left = [], []
                for s, e, least in zip(*(x.tolist() for x in windows(h.view(np.uint64), n, run, words)), strict=True):
                    if least != p - low:
                        continue
                    if a <= s and e <= b:
                        begin = max(s + low, e + low - (p - q)) if same else s + low
                        gone.append({"begin": begin, "stop": e + low})
                    else:
                        left.append({"begin": s + low, "stop": e + low, "key": xxhash.xxh3_128_digest(h[s:e].tobytes() + bytes([least - s]))})
                runs.append(gone)
                open_.append(left)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.list_(span)), pa.array(open_, pa.list_(window))], ["id", "runs", "open"])

    return go


def _drop_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, removed, spans = [], [], []
        for text, numbers, runs in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            value = text.as_py()
            merged: list[list[int]] = []
            for r in sorted((r["begin"], r["stop"]) for r in runs or ()):
                if merged and r[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], r[1])
                else:
                    merged.append(list(r))
            gone = {numbers[i] for a, b in merged for i in range(a, b)}
            if gone:
                value = "\n".join(x for i, x in enumerate(value.split("\n")) if i not in gone)
            texts.append(value)
            removed.append(len(gone))
            spans.append([{"first": numbers[a], "last": numbers[b - 1]} for a, b in merged])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int32()), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))], ["id", "text", "lines_removed", "runs"])


def _matches(marks: DataFrame, lines: DataFrame, run: int, words: int) -> DataFrame:
    """Each mark (key, id, at) but the first of its key, extended from there: (id, runs, open)."""
    id_type = marks.schema["id"].dataType.simpleString()
    firsts = marks.groupBy("key").agg(F.min(F.struct("id", "at")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = stored(firsts.select("key", F.col("f.id").alias("first_id"), F.col("f.at").alias("first_at")))
    hits = marks.join(firsts, "key").where((F.col("id") != F.col("first_id")) | (F.col("at") > F.col("first_at")))
    hits = stored(hits.select("id", "at", "first_id", "first_at").distinct())
    wanted = hits.select("id", "at").union(hits.select("first_id", "first_at")).distinct().groupBy("id").agg(F.collect_list("at").alias("wanted"))
    texts = stored(wanted).join(lines.select("id", "lines", "sizes"), "id").dropDuplicates(["id"])
    # Stored, so that Spark can split the rows of a place that many match.
    slices = stored(texts.select("id", "wanted", "lines", "sizes").mapInArrow(_slice(run - 1), f"id {id_type}, at int, low int, lines array<long>, sizes array<int>"))
    dropped(firsts)
    other = slices.select(F.col("id").alias("first_id"), F.col("at").alias("first_at"), F.col("low").alias("first_low"), F.col("lines").alias("first_lines"))
    pairs = hits.join(other, ["first_id", "first_at"]).join(slices, ["id", "at"])
    pairs = pairs.select("id", "at", "low", "lines", "sizes", "first_at", "first_low", "first_lines", (F.col("id") == F.col("first_id")).alias("same"))
    out = stored(pairs.mapInArrow(_extend(run, words), f"id {id_type}, runs array<struct<begin:int,stop:int>>, open array<struct<begin:int,stop:int,key:binary>>"))
    dropped(hits, slices)
    return out


def _later(open_: DataFrame) -> DataFrame:
    """(id, begin, stop) of each open window (key, id, begin, stop) but the first of its key; of one that overlaps the first only what is beyond it."""
    firsts = stored(open_.groupBy("key").agg(F.min(F.struct("id", "begin", "stop")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "f"))
    later = open_.join(firsts, "key").where((F.col("id") != F.col("f.id")) | (F.col("begin") != F.col("f.begin")))
    begin = F.when(F.col("id") == F.col("f.id"), F.greatest("begin", F.col("f.stop"))).otherwise(F.col("begin"))
    return later.select("id", begin.alias("begin"), "stop")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, words: int = WORDS) -> DataFrame:
    """One row for each row of docs: id_col, text without later repeated runs, lines_removed, runs (first and last line number of each, from 0).

    Lines are compared trimmed of ``[\\x20\\x09-\\x0D]``, by their 64-bit hashes;
    blank ones are passed over and kept.  Text order is by id, then line.  A run
    of lines counts if it has at least ``run`` lines or ``words`` words.  A line
    goes if and only if it is part of a run that counts and occurs earlier.  Of a
    run that overlaps its own first occurrence in the same text only the lines
    beyond that go, so a line said six times over stays ``run`` times.

    A null text stays null, an empty one empty.  Rows that repeat an id and a
    text count once and each get the same result; rows of one id with other
    texts are texts of their own.  A null id comes before all others.  An empty
    table gives no rows; other columns are ignored.

    A fingerprint shared by a third of all texts joins each with the first one
    only, so matches are never more than fingerprints and the open windows of
    these.  A match takes 2 * run - 1 lines of either text, so the work is in
    proportion to the lines also in a very long text.
    """
    none = F.col(id_col).isNull()
    zero = F.coalesce(F.col(id_col), F.lit("" if docs.schema[id_col].dataType.simpleString() == "string" else 0).cast(docs.schema[id_col].dataType))
    source = docs.select(F.struct((~none).alias("known"), zero.alias("id"), F.xxhash64(text_col).alias("text")).alias("id"), F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    lines = stored(source.mapInArrow(_lines(run, words), f"id {id_type}, lines array<long>, sizes array<int>, numbers array<int>, keys array<long>, places array<int>"))
    marks = lines.select("id", F.explode(F.arrays_zip("keys", "places")).alias("m")).select(F.col("m.keys").alias("key"), "id", F.col("m.places").alias("at"))
    near = _matches(marks, lines, run, words)
    open_ = near.select("id", F.explode("open").alias("w")).select("id", "w.key", "w.begin", "w.stop")
    runs = near.select("id", F.explode("runs").alias("r")).select("id", "r.begin", "r.stop").unionByName(_later(open_)).distinct()
    runs = stored(runs.groupBy("id").agg(F.collect_list(F.struct("begin", "stop")).alias("runs")))
    dropped(near)
    numbers = lines.join(runs.select("id"), "id", "left_semi").select("id", "numbers").dropDuplicates(["id"]).join(runs, "id")
    numbers = stored(numbers)
    dropped(lines, runs)
    out = source.join(numbers.hint("merge"), "id", "left").select("id", "text", F.coalesce("numbers", F.array().cast("array<int>")).alias("numbers"), "runs")
    out = out.mapInArrow(_drop_runs, f"id {id_type}, text string, lines_removed int, runs array<struct<first:int,last:int>>")
    return out.select(F.when(F.col("id.known"), F.col("id.id")).alias(id_col), F.col("text").alias(text_col), "lines_removed", "runs")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))
