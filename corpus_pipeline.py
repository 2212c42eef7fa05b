"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes what a stage returns and hands the next stage the written table, so
what the stage has kept in the shared folder for itself can go.  A stage that
is called alone drops nothing: its tables last as long as its result is read,
until ``storage.clear``.  The result of ``run`` reads tables of its last stage
and stays readable whatever is run after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hydrospark.llm import decontamination, host_rules, ngram_join, packing, quality_classifier
from hydrospark.storage import drop_path, write_table, written

#: Tokenizers and hashed models have no SQL form; a test runs the stages against plain Python.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from labels of the documents given."""
    model = quality_classifier.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.keep_quality(docs, model)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host does."""
    return host_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by n-gram similarity."""
    return ngram_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontamination.drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("quality rules", rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; of what this run has written, what the last stage reads and has written is left."""
    docs, own = spark.read.parquet(f"{sf_dir}/documents.parquet"), set()
    for name, stage in STAGES[:-1]:
        before = written()
        table = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        # the next stage reads the written table alone
        for path in own | (written() - before - {table.path}):
            drop_path(spark, path)
        docs, own = table.df, {table.path}
    return STAGES[-1][1](spark, docs, sf_dir)
