"""The training-data pipeline: five stages, each over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import packing, pii, quality, simhash, toxicity
from lodestone.llm.common import column_at, numbered, saved


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of operator 5 rejects go; the others stay as they are."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    d = numbered(docs)  # extra columns may be called score or predicted, too
    scored = toxicity.score(d, model, carry=tuple(d.columns), text_col=f"_{column_at(docs, 'text')}")
    return scored.where("predicted = 0").select(*d.columns).toDF(*docs.columns)


def bad_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule of operator 6 rejects go."""
    return quality.keep_good(docs)


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of operator 8 stays."""
    return simhash.one_each(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data that operator 3 finds is replaced by its kind; ``n_chars`` follows the text."""
    d = numbered(pii.redacted(docs))
    return d.withColumn(f"_{column_at(docs, 'n_chars')}", F.length(f"_{column_at(docs, 'text')}").cast("long")).toDF(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in windows, by operator 10."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out),
    ("quality", bad_out),
    ("near_duplicates", copies_out),
    ("personal_data", redacted),
    ("packing", packed),
]

#: Fingerprints, the classifier and the tokenizer are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
