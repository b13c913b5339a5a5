"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from pyspark.sql import DataFrame, SparkSession

from turnwise.llm import decontaminate, mixing, quality_rules, simhash_dedup, token_files
from turnwise.llm.common import durable
from turnwise.llm.queries import table

#: Toxic and low-quality words are to vanish; the budget is the words that the classifier expects to be good.
MIX = {"good": 1.0}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule go."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group stays."""
    return simhash_dedup.keep(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays with the probability of its rate (1 at most), drawn from a hash of its doc_id."""
    return mixing.keep(docs, mixing.fit(table(spark, sf_dir, "documents"), mixing.labelled(table(spark, sf_dir, "labels")), mixing.DOMAINS), MIX)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, and each document's place in them."""
    return token_files.op7(docs)


STAGES = [("quality_rules", quality), ("simhash_dedup", near_duplicates), ("decontamination", benchmark), ("mixing", mix), ("token_output", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name)
    return docs
