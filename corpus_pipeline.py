"""The corpus pipeline: stages of text operators, each written as Parquet and reread as the next one's documents.

Every stage works on all that the one before kept. Defined results: rows with a null id pass every filter that is by id; an empty table stays
empty; repeated rows are kept or dropped together, except near duplicates, of which one row stays; columns beyond those of
``documents`` are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidecast.llm import crf, decontaminate as leaks, mixing, prefix_join, toxicity as tox
from tidecast.llm.common import scan, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SHARE = 0.4


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted toxic by a model of the labels outside the hold-out."""
    model = tox.fit(docs, scan(spark, sf_dir, "labels", "doc_id", "toxic"))
    return tox.score(docs, model, *COLUMNS).where("predicted = 0").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those in which no language holds ``LEAST_SHARE`` of the words. A label that the
    prediction contradicts is no reason: it may be the label that is wrong."""
    found = crf.label(docs, crf.train(docs), *COLUMNS)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component: the one with the least id. Texts without words are components of their own."""
    found = prefix_join.jaccard_components(docs)
    keep = found.where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select("doc_id").distinct()
    rows = docs.join(keep, docs["doc_id"].eqNullSafe(keep["doc_id"]), "left_semi").select(*COLUMNS)
    again = W.partitionBy("doc_id", F.xxhash64("text")).orderBy("lang", "source", "n_chars")
    return rows.withColumn("_k", F.row_number().over(again)).where(F.col("_k") == 1).drop("_k")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    held = leaks.contaminated(docs, scan(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(held, "doc_id", "left_anti").select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mix(docs)


STAGES = [("toxicity", toxicity), ("language-id", language_id), ("near-duplicates", near_duplicates),
          ("decontamination", decontamination), ("mixing", mixed_sources)]

#: The learned stages have no SQL form; ``tests/llm/test_pipeline.py`` compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = scan(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
