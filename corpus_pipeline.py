"""Corpus pipeline: filter, deduplicate, decontaminate and pack a document table.

Each stage is a function of (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and read again as the next stage's ``docs``.  All but
the last keep the columns of ``documents``.

* quality - rows that the quality classifier scores below its threshold go;
* toxicity - rows that the toxicity model scores at or over its threshold go;
* near_duplicates - one document of each component of the Jaccard join (on
  five-word shingles, linked from 0.8) stays;
* decontamination - documents that hold a benchmark item go;
* packing - the rest is packed into sequences, one row per piece.

The classifiers learn from ``labels`` of rows outside their held-out fold.
Null and empty texts pass through every stage as the operators define it: no
rule removes them but the quality model, if it scores emptiness low.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelink.llm import decontamination, jaccard_join, packing, quality, toxicity
from tidelink.llm.common import materialise, read_docs


#: Bytes of token ids a worker keeps while packing; by then it has run the other stages' models too.
PACKING_REMEMBER = 32 << 20
#: Near duplicates: words of a shingle, and the similarity of a link as a fraction (op7's own query has 3 and 0.9).
NEAR_WORDS, NEAR_NUM, NEAR_DEN = 5, 80, 100


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs, quality.train(docs, read_docs(spark, sf_dir, "labels")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_filter(docs, toxicity.train(docs, read_docs(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one_per_component(docs, n=NEAR_WORDS, num=NEAR_NUM, den=NEAR_DEN)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_leaks(docs, read_docs(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, remember=PACKING_REMEMBER)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Trained models and token ids are beyond SQL; the tests check each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_docs(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
