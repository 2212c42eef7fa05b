"""Quality classifier: hashed word n-gram logistic regression fitted by follow-the-regularised-leader updates."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.llm.columns import free_name, in_holdout
from hydrospark.llm.hashed_features import labelled_sample, ngram_features
from hydrospark.llm.logistic import Model, fit, score_column

BITS = 20
#: Labelled rows that the model is fitted on, at most.
MAX_ROWS = 6000
THRESHOLD = 0.3
HOLDOUT = (5, 0)
features = partial(ngram_features, bits=BITS)


def one_variant(text):
    return [features(text)]


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Model of ``labels.quality`` from labelled rows whose id is not held out; without any, every text scores alike."""
    learn = lambda doc_id: ~in_holdout(doc_id, *HOLDOUT)
    samples = labelled_sample(docs, labels, "quality", learn, max_rows, one_variant)
    return fit(samples, BITS, alpha=5.0, l1=0.1)


def score_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row, scored on its whole text however long.

    Repeated rows and null ids keep their rows, null texts score as empty, a
    score at the threshold is predicted 1, an empty table gives an empty
    result.  Other columns are ignored.
    """
    scored = docs.select("doc_id", score_column(F.col("text"), model, features).alias("score"))
    return scored.select(
        "doc_id", in_holdout(F.col("doc_id"), *HOLDOUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``threshold``; rows as in ``score_quality``."""
    name = free_name(docs, "quality_score")
    return docs.withColumn(name, score_column(F.col("text"), model, features)).where(F.col(name) >= threshold).drop(name)
