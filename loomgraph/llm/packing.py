"""Packed training sequences: best-fit-decreasing bins found by a segment tree, written as token-id matrices.

A document longer than a sequence is cut into pieces of a whole sequence and a
rest, losing nothing.  Pieces of one packing window (as many tokens as ``window``)
go from long to short into the open bin with the least room that still holds
them.  Rooms are whole numbers from 0 to the sequence length, so a segment tree
over rooms finds that bin in logarithmic time.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.bpe import vocabulary
from loomgraph.llm.common import table

LENGTH = 2048
WINDOW = 1 << 21


class RoomTree:
    """A multiset of bins by room; best(need) gives one with the least room of at least need."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: dict[int, list[int]] = {}

    def _add(self, room: int, by: int) -> None:
        at, count = room + self.size, self.count
        while at:
            count[at] += by
            at >>= 1

    def put(self, room: int, bin_: int) -> None:
        self.bins.setdefault(room, []).append(bin_)
        self._add(room, 1)

    def best(self, need: int) -> tuple[int, int] | None:
        """(room, bin), taken out; None if there is no such bin."""
        count, at = self.count, need + self.size
        while not count[at]:
            while at & 1:  # up while there is nothing to the right under this parent
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.size
        bin_ = self.bins[room].pop()
        self._add(room, -1)
        return room, bin_


@functools.lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str):
    """The vocabulary in the tiktoken library, loaded once for each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def best_fit_decreasing(lengths: list[int], most: int) -> list[list[int]]:
    """Bins of indices into lengths (1 to most each), the longest first; ties by index."""
    tree, bins = RoomTree(most), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.best(lengths[i])
        if found is None:
            bins.append([])
            found = most, len(bins) - 1
        room, own = found
        bins[own].append(i)
        if room > lengths[i]:
            tree.put(room - lengths[i], own)
    return bins


def pack(docs: DataFrame, path: str, pattern: str, length: int = LENGTH, end_id: int | None = 50256, pad_id: int = 50256, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of packed ids, length to a row; nothing is shuffled.

    Returns shard, row (together the key of a row), n_tokens, doc_ids (of each
    segment), doc_offsets (tokens of the document before the segment),
    cu_seqlens (cumulative segment lengths from 0), input_ids and position_ids
    (little-endian 32-bit binaries of length numbers; positions restart at 0
    with every segment, and padding has pad_id and position 0).

    Every token of every text occurs once.  After a text comes end_id, if given;
    so a null or empty text is end_id alone, and without end_id has no segment.
    Repeated rows are packed as often as they occur; null ids are kept; an empty
    table gives no rows; other columns are ignored.  A window closes within one
    task, so a task holds window tokens and its longest text at most.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, row = tokenizer(path, pattern).encode_ordinary, TaskContext.get().partitionId(), 0
        ends = np.array([] if end_id is None else [end_id], np.uint32)
        ids: list[np.ndarray] = []
        names: list = []
        offsets: list[int] = []
        held = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal row
            bins = best_fit_decreasing([len(x) for x in ids], length)
            for at in range(0, len(bins), 256):
                columns: list[list] = [[] for _ in range(6)]
                for members in bins[at : at + 256]:
                    sizes = [len(ids[i]) for i in members]
                    n = sum(sizes)
                    matrix, places = np.full(length, pad_id, "<u4"), np.zeros(length, "<u4")
                    matrix[:n] = np.concatenate([ids[i] for i in members])
                    places[:n] = np.concatenate([np.arange(s, dtype="<u4") for s in sizes])
                    for column, x in zip(columns, (n, [names[i] for i in members], [offsets[i] for i in members], [0, *np.cumsum(sizes).tolist()], matrix.tobytes(), places.tobytes()), strict=True):
                        column.append(x)
                k = len(columns[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * k, pa.int32()), pa.array(range(row, row + k), pa.int64()), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.list_(id_arrow)), pa.array(columns[2], pa.list_(pa.int64())), pa.array(columns[3], pa.list_(pa.int32())), pa.array(columns[4], pa.binary()), pa.array(columns[5], pa.binary())],
                    ["shard", "row", "n_tokens", "doc_ids", "doc_offsets", "cu_seqlens", "input_ids", "position_ids"],
                )
                row += k
            ids.clear(), names.clear(), offsets.clear()

        id_arrow = pa.int64()
        for batch in batches:
            id_arrow = batch.schema.field(0).type
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.concatenate((np.array(encode(text.as_py() or ""), np.uint32), ends))
                for at in range(0, len(tokens), length):
                    ids.append(tokens[at : at + length])
                    names.append(name)
                    offsets.append(at)
                held += len(tokens)
                if held >= window:
                    yield from close()
                    held = 0
        if ids:
            yield from close()

    return docs.select(id_col, text_col).mapInArrow(run, f"shard int, row long, n_tokens int, doc_ids array<{id_type}>, doc_offsets array<long>, cu_seqlens array<int>, input_ids binary, position_ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), *vocabulary())
