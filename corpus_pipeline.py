"""Corpus pipeline: toxicity, near duplicates, decontamination, mixing to target weights, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``. SQL cannot express the learned toxicity score, so
there is no ORACLE_SQL; tests hold the ids that each stage keeps against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gausstide.llm import decontaminate, mixture, ngram_join, sharding, toxicity
from gausstide.llm.common import stage, table

N_SHARDS = 8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches 0.5 go; the model is fitted on the labelled training documents among ``docs``."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more over five-word shingles one document stays, that of the least doc_id."""
    return ngram_join.one_of_each(docs, k=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item (or a whole shorter item) go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Weights are tokens to the power of 0.8 on each level; the budget is all tokens, a document comes twice at most."""
    return mixture.mixed(docs, budget_share=1.0, max_epochs=2.0, temperature=0.8)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shards(docs, N_SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixture", mix_sources),
    ("sharding", deal_shards),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
