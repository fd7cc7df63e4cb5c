"""A corpus run: each stage is written as Parquet and read again as the next one's documents.

Language ID drops texts of no language (null or without a letter), toxicity what it finds toxic, the Jaccard join keeps the row of least id of each group of near copies
(of rows equal in id and text one), and packing returns a row for each piece of a document. Models are
fitted on each stage's own input. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalogspark.llm import common, op2_jaccard, op3_toxicity, op5_packing, op9_langid


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op9_langid.keep_known(docs, op9_langid.fit(docs))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op3_toxicity.keep_clean(docs, op3_toxicity.fit(docs, op3_toxicity.training_labels(spark, sf_dir)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_jaccard.keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op5_packing.pack(docs)


STAGES = [("language", language), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("packing", packing)]
#: Learned models decide, so SQL can't say it; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
