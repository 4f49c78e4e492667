"""The stages of the corpus pipeline, each one operator.

Every stage but the last returns the columns of its documents, whatever they are besides doc_id and text (names that begin with
an underscore are reserved). An empty table passes through all stages; null texts count as empty; repeated rows are
documents like any other until the near-duplicate stage, which keeps one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, line_dedup, near_dup, toxicity
from .common import cut
from .queries import table, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic, unchanged; null and empty texts have the prior's score and stay."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without its dropped lines; n_chars counts what is left."""
    kept = line_dedup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id; texts without a word all stay."""
    return near_dup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, unchanged; an empty benchmark drops nothing."""
    return decontaminate.keep_unleaked(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the token digests, row for row; a null text has no tokens."""
    return bpe.op10(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_shared_lines), ("near duplicates", drop_near_copies),
          ("benchmark decontamination", drop_leaks), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and token digests of the documents that all stages keep."""
    docs = table(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
