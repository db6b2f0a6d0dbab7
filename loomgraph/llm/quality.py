"""A quality classifier of supervised subword embeddings: hashed word and character n-grams, averaged, with a softmax."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import embedbag
from loomgraph.llm.common import arrow_map, table
from loomgraph.llm.langid import fold, labelled_sample

FEATURES = embedbag.Features(grams=(3, 4), lower=False, words=2)
#: At most so many labelled texts are learned from, those with the smallest hashes of their ids.
SAMPLE = 4000
#: A text is kept from this probability of label 1 on.
THRESHOLD = 0.3


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bound: int = SAMPLE, features: embedbag.Features = FEATURES) -> embedbag.Model:
    """Learns 0 and 1 from labels (id_col, label_col); rows with another or no label are ignored."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return embedbag.train(*labelled_sample(known, texts, bound), features, epochs=4, rate=3.0)


def score(docs: DataFrame, model: embedbag.Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """All columns of docs, then score_col double (probability of label 1) and predicted_col int; nothing is shuffled.

    A null text counts as empty; an empty one has the score of the output bias.
    If all labels learned from were the same, every text has that label; if there
    were none, every score is 0.5.  An empty table gives no rows.  Columns of
    these two names are replaced.  A text is read whole, in arrays of a few dozen
    times its bytes.
    """
    one = model.classes.index(1) if 1 in model.classes else None
    kept = [c for c in docs.columns if c not in (score_col, predicted_col)]
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.probabilities(batch.column(at))[:, one].clip(0, 1) if one is not None else [0.0 if model.classes else 0.5] * len(batch)
            s = pa.array(p, pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, s, pa.array([int(x >= threshold) for x in s.to_pylist()], pa.int32())], [*kept, score_col, predicted_col])

    source = docs.select(*[f"`{c}`" for c in kept])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) + f", `{score_col}` double, `{predicted_col}` int"
    return arrow_map(source, run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = fit(docs, labels.where(~held_out))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
