"""The corpus pipeline: documents without toxic ones and near copies, without personal data, mixed and encoded.

Each stage is a function of (spark, docs, sf_dir); run() writes what a stage returns as Parquet in the
shared folder and gives the next one what it reads there. All stages but the last return the columns of
documents; extra columns, nulls, empty and very long texts and empty tables pass as the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronostrata.llm.common import discard, materialise, scratch
from chronostrata.llm.mixing import mix
from chronostrata.llm.pii import redact
from chronostrata.llm.probminhash import keep_one
from chronostrata.llm.sentencepiece_codec import encode
from chronostrata.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced in the texts; no document goes."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least, those of small sources up to twice, in blocks that hold the weights."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) of each row."""
    return encode(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("tokens", tokens)]

#: Model training, sketches and merges can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with scratch() as kept:  # what a stage has written for itself goes with it
            docs = materialise(stage(spark, docs, sf_dir), name)
            kept.append(docs)
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
