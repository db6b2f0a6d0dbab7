"""A corpus pipeline of five stages; each is written as Parquet and read again as the next one's documents.

quality   documents that the classifier scores under the threshold go
exact     of equal documents (white space aside) one stays
near      of linked documents (5-word shingles, Jaccard 0.8) the one with the smallest id stays
mixing    documents are repeated or left out to meet the sources' target weights, in training order
encoding  whole texts as byte-level BPE ids, tested by decoding them

Rows are told apart by id and text, so rows that repeat an id or lack one are documents of their own.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import blocknames, bpe, mixing, quality, setjoin
from loomgraph.llm.common import dropped, stored, table, tidy

#: Matches that the encoder remembers in each of two generations: fewer than by itself, as workers still hold memory of the stages before.
REMEMBER = 100_000


def _stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that keeps in the shared folder only what its result still reads."""

    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return tidy(spark, lambda: function(spark, docs, sf_dir))

    return run


def _new_names(docs: DataFrame, n: int) -> list[str]:
    return [x for x in (f"own_{i}" for i in range(n + len(docs.columns))) if x not in docs.columns][:n]


def _row_key() -> Column:
    """What tells rows apart: id (those without one last, null coming before true) and text; all fields may be null, as Arrow then has them."""
    return F.struct(F.when(F.col("doc_id").isNull(), True).alias("none"), F.col("doc_id").alias("id"), _text_key().alias("text"))


def _text_key() -> Column:
    return F.nullif(F.xxhash64("text"), F.lit(0))


def _without(docs: DataFrame, keys: DataFrame, how: str = "left_anti") -> DataFrame:
    """The rows of docs whose row key is not (or with left_semi: is) in keys (key)."""
    own_id, own_text = _new_names(docs, 2)
    keys = keys.select(F.col("key.id").alias(own_id), F.col("key.text").alias(own_text))
    return docs.join(keys, F.col("doc_id").eqNullSafe(F.col(own_id)) & _text_key().eqNullSafe(F.col(own_text)), how)


@_stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier, fitted to labels, does not reject.

    A null or empty text has the score of the output bias; without labels all
    rows stay.  Repeated rows are scored alike, and an empty table gives none.
    Texts are read whole; columns of any name are kept.
    """
    score, predicted = _new_names(docs, 2)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, score_col=score, predicted_col=predicted).where(F.col(predicted) == 1).select(docs.columns)


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows whose texts are equal without white space one: that with the most code points, then the smallest id (none counts as largest).

    A null text counts as empty, and of all empty ones one stays.  Of rows that
    agree in id and text, one stays, with the smallest values in the other
    columns.  An empty table gives none; columns of any name are kept, and long
    texts are cut into blocks where they are read.
    """
    found = stored(blocknames.exact_dedup(docs.select(_row_key().alias("key"), "text"), id_col="key").select("key", "kept"))
    gone = found.where("not kept").select("key").distinct()
    again = stored(found.where("kept").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    if again.isEmpty():
        return _without(docs, stored(gone))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    (one,) = _new_names(docs, 1)
    ones = _without(docs, again, "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("_"), *rest)).alias(one))
    ones = ones.select(*[F.col(c) if c in ("doc_id", "text") else F.col(one)[c].alias(c) for c in docs.columns])
    return _without(docs, stored(gone.union(again))).unionAll(ones)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest id (none counts as largest), then text hash; rows that repeat both stay together.

    Texts without words, null ones too, are linked with nothing and stay.  An
    empty table gives none; columns of any name are kept, and shingles are those
    of whole texts.
    """
    linked = setjoin.linked_components(docs.select(_row_key().alias("key"), "text"), id_col="key", count_links=False)
    gone = linked.where((F.col("n_shingles") > 0) & (F.col("key") != F.col("component_id"))).select("key").distinct()
    return _without(docs, stored(gone))


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, range-sorted by training time.

    Texts without words, null ones too, are never taken; null sources are one
    source.  Rows that repeat id, text and source share their copies evenly.  An
    empty table gives none; columns of any name are kept, and sizes are those
    of whole texts.
    """
    return mixing.mixed(docs).select(docs.columns)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; see bpe.bpe_round_trip for nulls, long texts and repeated rows."""
    out = bpe.bpe_round_trip(docs, *bpe.vocabulary(), remember=REMEMBER, forget=True)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality", keep_good), ("exact", drop_copies), ("near", drop_near_copies), ("mixing", mix), ("encoding", encode)]

#: A trained classifier and BPE have no SQL: tests/llm compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written before the next begins, and then those of the one before go."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
            if before is not None:
                dropped(before)
            before = docs
    return docs
