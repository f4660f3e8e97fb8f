"""The corpus pipeline: documents in, a mixed training set out.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept and returns a
DataFrame; ``run`` writes every stage's result as Parquet to the shared folder and rereads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridspark.llm import common, decontamination, line_dedup, mixing, near_dedup, quality


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores as good; it is fitted on the labelled rows that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels))


def fuzzy_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occur before, exactly or nearly; documents with nothing left go."""
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_dedup.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with ``taken`` added."""
    return mixing.mixture(docs).where("taken > 0")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", fuzzy_line_dedup),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("mixing", source_mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: The classifier and the near-duplicate stages have no SQL form; tests compare with brute-force versions.
ORACLE_SQL = None
