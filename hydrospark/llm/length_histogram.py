"""Exact token counts from a histogram of encoded lengths."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydrospark.llm.tokens import VOCABULARY, encoder
from hydrospark.storage import write_table

#: Lengths in one window partition of the suffix sums.
SPAN = 1024


def encoded_length(column, vocabulary: str = VOCABULARY):
    """Number of ids of a text; 0 for a null or empty one."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(vocabulary)
        for batch in texts:
            yield pd.Series([len(encode(x)) for x in batch], dtype="int64")

    return count(column)


def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``length, n_docs`` over all rows; counts are added up before the shuffle."""
    return docs.select(encoded_length(F.col("text"), vocabulary).alias("length")).groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def length_totals(histogram: DataFrame) -> DataFrame:
    """For each length L that occurs, taken as a context limit, the answers over the whole corpus.

    ``docs_from``/``tokens_from``: documents of at least L tokens and their
    tokens; ``truncated_total``: tokens left if every document is cut at L;
    ``docs_to``: documents of at most L tokens, from which every quantile
    follows (the q-quantile is the least L with ``docs_to >= q * n``);
    ``total_docs``/``total_tokens``: the corpus.  Suffix sums run within spans
    of lengths and over the spans' totals, so no task orders all lengths.
    An empty table gives no rows.
    """
    span = F.floor(F.col("length") / SPAN)
    kept = write_table(histogram.select("length", "n_docs", span.alias("span")), "lengths").df
    spans = kept.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("length")).alias("t"))
    whole = Window.orderBy(F.desc("span"))  # one row for each SPAN lengths
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    every = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spans = spans.select(
        "span",
        F.coalesce(F.sum("d").over(before), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("t").over(before), F.lit(0)).alias("later_tokens"),
        F.sum("d").over(every).alias("total_docs"),
        F.sum("t").over(every).alias("total_tokens"),
    )
    inside = Window.partitionBy("span").orderBy(F.desc("length"))
    out = kept.join(spans, "span").select(
        "length",
        "n_docs",
        (F.sum("n_docs").over(inside) + F.col("later_docs")).alias("docs_from"),
        (F.sum(F.col("n_docs") * F.col("length")).over(inside) + F.col("later_tokens")).alias("tokens_from"),
        "total_docs",
        "total_tokens",
    )
    return out.select(
        "length",
        "n_docs",
        "docs_from",
        "tokens_from",
        (F.col("total_docs") - F.col("docs_from") + F.col("n_docs")).alias("docs_to"),
        (F.col("total_tokens") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("truncated_total"),
        "total_docs",
        "total_tokens",
    )


def answer(totals: DataFrame, limit: int) -> DataFrame:
    """One row for any context limit, also one that no document has: tokens left after cutting, documents cut."""
    longer = totals.where(F.col("length") > limit)
    return totals.agg(F.max("total_docs").alias("total_docs"), F.max("total_tokens").alias("total_tokens")).crossJoin(
        longer.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs_cut"), F.coalesce(F.sum(F.col("n_docs") * (F.col("length") - limit)), F.lit(0)).alias("tokens_cut"))
    ).select(F.lit(limit).alias("limit"), "docs_cut", (F.col("total_tokens") - F.col("tokens_cut")).alias("truncated_total"))


def quantile(totals: DataFrame, q: float) -> DataFrame:
    """The least length that at least a share ``q`` of all documents don't exceed."""
    return totals.where(F.col("docs_to") >= q * F.col("total_docs")).agg(F.min("length").alias("length"))
