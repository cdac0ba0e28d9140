"""From raw documents to a training mix: five stages, each working on all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prepflow.llm import decontaminate, exact_dedup, language, mixing, near_dedup
from prepflow.llm.common import written

#: A document goes if no language reaches this probability: with L languages, chance alone gives 1 / L.
LEAST_LANGUAGE_SCORE = 0.3


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without a letter or without a likely language go."""
    return language.keep_identified(docs, language.fit(docs), LEAST_LANGUAGE_SCORE)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text (A-Z lower-cased): the one with the largest id."""
    return exact_dedup.drop_copies(docs)


def distinct_enough(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, similarity 0.8): the one with the smallest id."""
    return near_dedup.drop_near(docs, size=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each document in the mix, so that the sources meet their weights."""
    return mixing.mix(docs)


STAGES = [
    ("language", identified),
    ("exact_dedup", distinct_texts),
    ("near_dedup", distinct_enough),
    ("decontaminate", without_benchmark),
    ("mix", mixed),
]

#: No SQL can express the network and the forest; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, with a written table between two stages."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
