"""From raw documents to packed sequences: the stages of a training-data pipeline.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it
kept, and returns a DataFrame that is written as Parquet and read again as the
next one's documents.  As its documents are a written table, a stage first
deletes the lineage cuts of the stages before it (and no others); a session runs
one chain of stages at a time.  All but the last return the columns of ``documents``.
The result cannot be had from SQL (two of the stages learn), so ``ORACLE_SQL``
is None; the tests hold the pipeline against a version in plain Python.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from cabmart.llm import line_dedup, ngram_join, packing, quality, toxicity
from cabmart.llm.common import Cuts, labelled_fold, owned, release, scratch_path, table
from cabmart.llm.queries import vocabulary

#: Lineage cuts of the chain's stages so far.
_cuts = Cuts()


def _stage(function):
    """The stage as a link of the chain: the cuts before it go, its own belong to the chain."""
    @functools.wraps(function)
    def link(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _cuts.delete(spark)
        release(spark)                                   # the stage before it wrote its result: its shuffle files, and what the driver's JVM holds
        with owned(_cuts):
            return function(spark, docs, sf_dir)
    return link


@_stage
def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), held_out=labelled_fold(F.col("doc_id"), 3, 1))
    scored = quality.classify(docs, model)
    return scored.filter(F.col(scored.columns[-1]) == 1).select(*docs.columns)


@_stage
def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine accepts."""
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"), held_out=labelled_fold(F.col("doc_id"), 5, 0))
    scored = toxicity.classify(docs, machine)
    return scored.filter(F.col(scored.columns[-1]) == 0).select(*docs.columns)


@_stage
def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are near copies of earlier ones; ``n_chars`` follows the text."""
    kept = line_dedup.dedup(docs, percent=80, counts=False)
    if "n_chars" in kept.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast("long"))
    return kept


@_stage
def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard of at least 0.8)."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("quality classifier", good),
    ("toxicity", harmless),
    ("line dedup", fresh_lines),
    ("n-gram Jaccard join", distinct_documents),
    ("best-fit packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
