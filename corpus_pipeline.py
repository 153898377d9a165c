"""Training-data pipeline over ``documents``.

Five stages, each written as Parquet and read again as the next one's
documents: quality classifier (rejected documents go), SimHash near-dedup
(one document of each group stays), benchmark decontamination (contaminated
documents go), secret scan (secrets are masked in the texts) and best-fit
packing (the result: a row per packed piece).

Every stage but the last returns the columns of ``documents``; ``n_chars``
is renewed where a text changes. Null ids and texts, repeated rows and extra
columns follow the rules of the operators; a repeated row that stays, stays
once per distinct (id, text).
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from logpond.llm.common import load
from logpond.llm.op2_decontaminate import clean_documents
from logpond.llm.op3_secrets import mask_secrets
from logpond.llm.op4_simhash import keep_one_of_each
from logpond.llm.op8_packing import best_fit
from logpond.llm.op9_quality_model import keep_quality
from logpond.llm.queries import QUALITY_LEAST, vocabulary
from logpond.session import apply_runtime_defaults, scratch_path


def _stage(fn):
    """Session settings and the package on the executors, however a stage is
    called."""
    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        apply_runtime_defaults(spark)
        return fn(spark, docs, sf_dir)
    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs, load(spark, sf_dir, "labels"), QUALITY_LEAST)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, load(spark, sf_dir, "benchmark"))


@_stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mask_secrets(docs)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit(docs, vocabulary()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secret scan", secrets),
    ("packing", packing),
]

#: Tokenizing and the classifier are not expressible in SQL; tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = scratch_path(spark, f"pipeline-{k}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
