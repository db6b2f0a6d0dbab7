"""Language identification with averaged hashed subword embeddings and calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import embedbag
from loomgraph.llm.common import table

FEATURES = embedbag.Features(grams=(2, 4), lower=True)
#: At most so many labelled texts are learned from, those with the smallest hashes of their ids.
SAMPLE = 2000


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled_sample(known: DataFrame, texts: DataFrame, bound: int) -> tuple[list[str], list]:
    """(texts, labels) of at most bound ids, those with the smallest hashes: whole texts, the same in every run.

    known: id, label; texts: id, text, and label if it is the text that has one.
    Of the rows that repeat an id one counts: the smallest label, and the text
    with the smallest hash.  So never more than bound rows come to the driver.
    """
    picked = known.where("id is not null and label is not null").groupBy("id").agg(F.min("label").alias("label"))
    picked = picked.orderBy(F.xxhash64("id"), "id").limit(bound).collect()
    if not picked:
        return [], []
    small = known.sparkSession.createDataFrame([(r["id"],) for r in picked], known.select("id").schema)
    own = F.col("label") if "label" in texts.columns else F.lit(None)
    one = texts.join(F.broadcast(small), "id").groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text"), own.alias("label"))).alias("t"))  # small has at most bound ids
    found = {r["id"]: r["t"] for r in one.collect()}
    kept = [(found[r["id"]], r["label"]) for r in picked if r["id"] in found]
    return [t["text"] for t, _ in kept], [y if t["label"] is None else t["label"] for t, y in kept]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bound: int = SAMPLE, features: embedbag.Features = FEATURES) -> embedbag.Model:
    """Learns from the texts whose language is known and which have a letter."""
    known = docs.where(F.col(lang_col).isNotNull() & has_letter(F.col(text_col))).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("label"))
    return embedbag.train(*labelled_sample(known.select("id", "label"), known, bound), features, epochs=3)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: embedbag.Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, lang_pred, score (calibrated probability), accepted; nothing is shuffled.

    A text that is null, empty or without any letter has lang_pred 'und', score
    0 and accepted false, and so has every text if nothing was learned.  Otherwise lang_pred is the likeliest language, and
    accepted tells whether its probability reaches the calibrated threshold; a
    caller that wants rejection takes 'und' where it is false.  An empty table
    gives no rows; other columns are ignored.  A text is read whole, in arrays of
    a few dozen times its bytes.
    """
    names = model.classes or ["und"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.probabilities(batch.column(1)) if model.classes else np.zeros((len(batch), 1))
            best, letters = p.argmax(axis=1), batch.column(2).to_pylist()
            score = [float(x) if ok else 0.0 for x, ok in zip(p.max(axis=1), letters, strict=True)]
            columns = [batch.column(0), pa.array([names[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], pa.string()), pa.array(score, pa.float64()), pa.array([bool(ok and model.classes and x >= model.reject_below) for x, ok in zip(score, letters, strict=True)], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "lang_pred", "score", "accepted"])

    source = docs.select(id_col, text_col, has_letter(F.col(text_col)).alias("letters"))
    return source.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, accepted boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = fit(docs.where(~held_out))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")
