"""Exact deduplication by deterministic block naming.

The normalised text of a document is cut into blocks of a fixed number of bytes.
All blocks are dealt by content and sorted, and equal blocks get one integer
name.  Then adjacent names of a document are paired, and the pairs are named in
the same way, until each document has one name: after k rounds it stands for
2**k blocks.  Two documents are equal exactly if their numbers of rounds and
last names are; no hash takes part in that decision.

The input is read once, and what is read is stored: all that follows is derived
from the stored rows, so it does not matter if a later scan of the input would be
cut into other tasks.  Copies within one task are found where they are read, and
so are equal blocks and pairs: a block or pair is sent to be named once from each
batch of rows, however often it occurs, and its name comes back by the number that
it has in its batch.  So neither a text nor a block that fills a third of the corpus
makes a group of that size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import arrow_map, dropped, stored, table

WHITESPACE = b" \t\n\x0b\x0c\r"
#: A task remembers texts up to so many bytes in all; beyond that, copies are sent again, which changes no result.
_REMEMBERED = 48 << 20


def _read(block_bytes: int):
    """Reads (id, text). A row for each document (id, uid, points, text_sha256), one for each place of a block in a text new to the task (uid, idx, n, part) and one for each block (part, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        seen: dict[bytes, int] = {}
        held = row = parts = 0
        for whole in batches:
            for cut in range(0, len(whole), 2000):
                batch = whole.slice(cut, 2000)
                uids, points, shas = [], [], []
                places: list[tuple[int, int, int, int]] = []
                known: dict[bytes, int] = {}
                for value in batch.column(1):
                    text = value.as_py() or ""
                    norm = text.encode("utf-8", "surrogatepass").translate(None, WHITESPACE)
                    own = seen.get(norm)
                    if own is None:
                        own = base + row
                        if held < _REMEMBERED:
                            seen[norm] = own
                            held += len(norm)
                        n = max(1, -(-len(norm) // block_bytes))
                        for i in range(n):
                            block = norm[i * block_bytes : (i + 1) * block_bytes]
                            part = known.get(block)
                            if part is None:
                                known[block] = part = base + parts
                                parts += 1
                            places.append((own, i, n, part))
                    row += 1
                    uids.append(own)
                    points.append(len(text))
                    shas.append(hashlib.sha256(norm).hexdigest())
                d, p, k = len(uids), len(places), len(known)
                none = lambda m: [None] * m
                uid, idx, n, part = map(list, zip(*places, strict=True)) if places else ([], [], [], [])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([batch.column(0), pa.nulls(p + k, batch.column(0).type)]),
                        pa.array(uids + uid + none(k), pa.int64()),
                        pa.array(points + none(p + k), pa.int64()),
                        pa.array(shas + none(p + k), pa.string()),
                        pa.array(none(d) + idx + none(k), pa.int64()),
                        pa.array(none(d) + n + none(k), pa.int64()),
                        pa.array(none(d) + part + list(known.values()), pa.int64()),
                        pa.array(none(d + p) + list(known), pa.binary()),
                    ],
                    ["id", "uid", "points", "text_sha256", "idx", "n", "part", "block"],
                )

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, idx, n, a, b) with part, the number of the pair (a, b) in its batch, and whether the row is the first of that."""
    base, parts = TaskContext.get().partitionId() << 33, 0
    for batch in batches:
        known: dict[tuple, int] = {}
        part, first = [], []
        for pair in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            own = known.get(pair)
            first.append(own is None)
            if own is None:
                known[pair] = own = base + parts
                parts += 1
            part.append(own)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int64()), pa.array(first, pa.bool_())], ["uid", "idx", "n", "a", "b", "part", "first"])


def _named(df: DataFrame, keys: list[str]) -> DataFrame:
    """(part, keys) to (part, name): rows dealt by the keys and sorted by them, equal keys numbered alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, last = (TaskContext.get().partitionId() << 33) - 1, None
        for batch in batches:
            names = []
            for key in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if key != last:
                    name, last = name + 1, key
                names.append(name)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.int64())], ["part", "name"])

    return arrow_map(df.select("part", *keys).repartition(*keys).sortWithinPartitions(*keys), run, "part long, name long")


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(members, names): members has id, uid, points, text_sha256 for each row of docs; names has uid, round, name.

    docs is read once.  A task holds 2,000 texts and _REMEMBERED bytes of texts at
    most beside them; a text of n bytes is cut into n / block_bytes rows.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = stored(arrow_map(source, _read(block_bytes), f"id {docs.schema[id_col].dataType.simpleString()}, uid long, points long, text_sha256 string, idx long, n long, part long, block binary"))
    members = rows.where("points is not null").select("id", "uid", "points", "text_sha256")
    names = stored(_named(rows.where("block is not null"), ["block"]))
    level = stored(rows.where("idx is not null").select("uid", "idx", "n", "part").join(names, "part").select("uid", "idx", "n", "name"))
    dropped(names)
    done, most, k = [], level.agg(F.max("n")).first()[0] or 1, 0
    while True:
        done.append(level.where("n = 1").select("uid", F.lit(k).alias("round"), "name"))
        if most == 1:
            break
        odd = F.col("idx") % 2 == 1
        pairs = level.where("n > 1").groupBy("uid", F.floor(F.col("idx") / 2).alias("idx"), F.ceil(F.col("n") / 2).alias("n")).agg(F.coalesce(F.max(F.when(~odd, F.col("name"))), F.lit(-1)).alias("a"), F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("b"))
        pairs = stored(arrow_map(pairs, _numbered, "uid long, idx long, n long, a long, b long, part long, first boolean"))
        names = stored(_named(pairs.where("first"), ["a", "b"]))
        level = stored(pairs.select("uid", "idx", "n", "part").join(names, "part").select("uid", "idx", "n", "name"))
        dropped(pairs, names)
        most, k = -(-most // 2), k + 1
    names = done[0]
    for more in done[1:]:
        names = names.unionAll(more)
    return members, names


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096) -> DataFrame:
    """One row for each row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without the characters
    ``[\\x20\\x09-\\x0D]``; a null text counts as empty, and all empty texts are
    equal.  Of a group the row with the most code points in the original text
    stays, of those the one with the smallest id (a null id counts as larger
    than any).  Rows that repeat an id and a text are each counted, and as they
    can't be told apart all rows of the id that stays have kept = true.  An
    empty table gives no rows; other columns of docs are ignored.  A very long
    text is cut into blocks where it is read, and only these are sent.
    """
    members, names = identities(docs, id_col, text_col, block_bytes)
    best = F.min(F.struct((-F.col("points")).alias("less"), F.col("id").isNull().alias("none"), "id"))
    local = members.groupBy("uid").agg(F.count(F.lit(1)).alias("size"), best.alias("best"))
    local = stored(local.join(names, "uid"))
    groups = stored(local.groupBy("round", "name").agg(F.sum("size").alias("group_size"), F.min("best").alias("best")))
    own = local.select("uid", "round", "name").join(groups, ["round", "name"]).select("uid", "group_size", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("most"))
    out = members.join(stored(own), "uid")
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("most"))).alias("kept"), "text_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
