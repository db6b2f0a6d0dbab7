"""Packing all documents of a table into sequences: best-fit decreasing over the whole table, not over parts of it.

A document longer than a sequence is first cut into full windows and a rest.  Which
window a piece goes to then depends on lengths only, so the packing is worked out from
the number of pieces of each length, ``length`` numbers for a table of any size: pieces
go from long to short, and a segment tree indexed by remaining capacity finds the
tightest open windows.  Windows that hold the same are one entry of the tree, and so
many pieces of a length as they take are placed in one step.  Pieces are numbered from
long to short in a total order; a step holds a range of these numbers, so every piece
finds its window and its place there by a binary search.

Windows that best fit leaves with more than ``slack`` of padding are mended at the end:
the emptiest of them are given up and their pieces are cut to fill the others.  What is
left then, less than one sequence, is cut at powers of two, which take no padding.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import arrow_map, stored, table
from loomgraph.llm.packing import RoomTree
from loomgraph.operators.ordering import numbered

LENGTH, END_ID, SLACK = 2048, 1, 32
#: Fixed values of the public vocabulary: its one special token.
SPECIAL = {"<|endoftext|>": 50256}


@functools.lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    """The ids that the tokenizers library gives for this vocabulary, by a library that takes 40 % of its time; loaded once for each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)


def cut(docs: DataFrame, path: str, pattern: str, length: int = LENGTH, end_id: int = END_ID, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Full windows and rests: row (unique), id, start, length, ids_crc32, doc_tokens, ids (of full windows only with keep_ids)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoding, row = encoding(path, pattern), TaskContext.get().partitionId() << 36
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                of, rows, starts, sizes, sums, whole, ids = [], [], [], [], [], [], []
                for i, text in enumerate(part.column(1)):
                    value = text.as_py() or ""
                    found = own_encoding.encode(value, allowed_special="all") if any(x in value for x in SPECIAL) else own_encoding.encode_ordinary(value)
                    tokens = np.array([*found, end_id], "<u4")
                    for at in range(0, len(tokens), length):
                        own = tokens[at : at + length].tobytes()
                        of.append(i)
                        rows.append(row)
                        starts.append(at)
                        sizes.append(len(own) // 4)
                        sums.append(zlib.crc32(own))
                        whole.append(len(tokens))
                        ids.append(own if keep_ids or len(own) < 4 * length else None)
                        row += 1
                long_ = pa.int64()
                yield pa.RecordBatch.from_arrays([pa.array(rows, long_), part.column(0).take(pa.array(of, pa.int32())), pa.array(starts, long_), pa.array(sizes, long_), pa.array(sums, long_), pa.array(whole, long_), pa.array(ids, pa.binary())], ["row", "id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return arrow_map(docs.select(id_col, text_col), run, f"row long, id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


@dataclass
class Plan:
    """starts, first, per, offset, size: steps; the piece numbered starts[s] + k goes to window first[s] + k // per[s].

    given (first window, windows, tokens in each, place of the first in the line of tokens given up) and
    room (place in that line, first window, room of each, offset of the room): what is cut anew, and where it goes.
    """

    steps: np.ndarray
    given: np.ndarray
    room: np.ndarray
    windows: int


def plan(counts: list[int], length: int = LENGTH, slack: int = SLACK) -> Plan:
    """The packing of counts[n] pieces of n tokens each, for n from 1 to length.

    A window is filled by ever shorter pieces, of fewer than 2 * sqrt(length)
    lengths therefore, and each length leaves three entries more at most: so
    steps and entries are bounded by length alone.
    """
    tree, steps, number, windows = RoomTree(length), [], 0, 0
    for size in range(length, 0, -1):
        left = counts[size]
        while left:
            found = tree.best(size)
            if found is None:
                many = -(-left // (length // size))
                found = length, (windows, many)
                windows += many
            room, (first, many) = found
            per = room // size
            full = min(many, left // per)
            steps.append((number, first, per, length - room, size))
            if full and room > per * size:
                tree.put(room - per * size, (first, full))
            number += full * per
            left -= full * per
            if full < many and left:  # fewer than per: they go to one window
                if room > left * size:
                    tree.put(room - left * size, (first + full, 1))
                number += left
                left = 0
                full += 1
            if full < many:
                tree.put(room, (first + full, many - full))
    poor = sorted((room, *x) for room, xs in tree.bins.items() for x in xs if room > slack and (length - room) & (length - room - 1))
    tokens = sum((length - room) * many for room, _, many in poor)
    keep, given, rooms, line, place = tokens // length, [], [], 0, 0
    for room, first, many in poor:
        kept = min(keep, many)
        keep -= kept
        if kept:
            rooms.append((line, first, room, length - room))
            line += kept * room
        if kept < many:
            given.append((first + kept, many - kept, length - room, place))
            place += (many - kept) * (length - room)
    for bit in range(length.bit_length() - 1, -1, -1):
        if (place - line) >> bit:
            rooms.append((line, windows, 1 << bit, 0))
            line += 1 << bit
            windows += 1
    table = lambda x, n: np.array(x, np.int64).reshape(-1, n).T
    return Plan(table(steps, 5), table(sorted(given), 4), table(rooms, 4), windows)


def _place(p: Plan):
    """Adds sequence_id, offset and, for pieces that are cut anew, their place in the line (else null) to (number, ...)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, first, per, offset, size = p.steps
        for batch in batches:
            number = batch.column(0).to_numpy()
            s = np.searchsorted(starts, number, "right") - 1
            k = number - starts[s]
            window, at = first[s] + k // per[s], offset[s] + k % per[s] * size[s]
            line, mask = np.zeros(len(number), np.int64), np.ones(len(number), bool)
            if p.given.size:
                g_first, g_many, g_size, g_place = p.given
                g = np.maximum(np.searchsorted(g_first, window, "right") - 1, 0)
                mask = (window < g_first[g]) | (window >= g_first[g] + g_many[g])
                line = g_place[g] + (window - g_first[g]) * g_size[g] + at
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(window), pa.array(at), pa.array(line, pa.int64(), mask=mask)], [*batch.schema.names[1:], "sequence_id", "offset", "line"])

    return go


def _fill(p: Plan, keep_ids: bool):
    """Cuts (id, start, doc_tokens, line, ids) where the rooms end."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, first, room, offset = p.room
        for batch in batches:
            of, out = [], []
            for i, (start, line, ids) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                at, n = 0, len(ids) // 4
                while at < n:
                    g = int(np.searchsorted(place, line + at, "right")) - 1
                    k, used = divmod(line + at - int(place[g]), int(room[g]))
                    take = min(n - at, int(room[g]) - used)
                    own = ids[4 * at : 4 * (at + take)]
                    of.append(i)
                    out.append((start + at, take, zlib.crc32(own), int(first[g]) + k, int(offset[g]) + used, own if keep_ids else None))
                    at += take
            of, cols = pa.array(of, pa.int32()), list(zip(*out, strict=True)) or [[]] * 6
            long_ = pa.int64()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), pa.array(cols[0], long_), pa.array(cols[1], long_), pa.array(cols[2], long_), batch.column(2).take(of), pa.array(cols[3], long_), pa.array(cols[4], long_), pa.array(cols[5], pa.binary())], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return go


def packed(docs: DataFrame, path: str, pattern: str, length: int = LENGTH, end_id: int = END_ID, slack: int = SLACK, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset; with keep_ids also ids (little-endian unsigned 32-bit).

    Every token lies in one piece, and the pieces of a sequence follow each other
    from 0 without a gap.  Sequences are to be padded to ``length``, but those of
    a power of two of tokens are not; no other has more than ``slack`` of padding.
    Sequence ids are unique but not gapless: windows given up have none.

    A null or empty text is end_id alone.  Rows that repeat an id, or a null id,
    are documents of their own.  The packing depends on the rows only, not on how
    they are partitioned (rows equal in id and text may swap places).  An empty
    table gives no rows; other columns are ignored.  A task holds the ids of 256
    texts at most; only rests, with their ids, are written, and only those cut
    anew are shuffled with them.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    spark = docs.sparkSession
    pieces = stored(cut(docs, path, pattern, length, end_id, keep_ids, id_col, text_col))
    counts = [0] * (length + 1)
    for n, many in pieces.groupBy("length").count().collect():  # a row for each length
        counts[n] = many
    p = plan(counts, length, slack)
    id_type = docs.schema[id_col].dataType.simpleString()
    light = ["id", "start", "length", "ids_crc32", "doc_tokens", "row"]
    order = [F.col("length").desc(), F.col("id"), F.col("start"), F.col("ids_crc32"), F.col("row")]
    placed = numbered(pieces.select(light), order, "number", stored).select("number", *light)
    placed = placed.mapInArrow(_place(p), f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, row long, sequence_id long, offset long, line long")
    columns = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if keep_ids:
        placed = placed.join(pieces.select("row", "ids"), "row")
        columns.append("ids")
    out = placed.where("line is null").select(columns)
    if p.given.size:
        again = placed.where("line is not null")
        if not keep_ids:
            again = again.join(pieces.select("row", "ids"), "row")
        again = again.select("id", "start", "doc_tokens", "line", "ids").mapInArrow(_fill(p, keep_ids), f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
        out = out.unionByName(again.select(columns))
    return out.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.bpe import vocabulary

    return packed(table(spark, sf_dir, "documents"), *vocabulary())
