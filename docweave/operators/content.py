"""Project context (C9): the project's own introduction, put into every prompt of the project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from .chunking import decode_lossy

# README names looked for at the project root, in priority order.
README_NAMES = ["README.md", "README.txt", "README", "Readme.md", "readme.md"]


def project_context(corpus: DataFrame, projects: DataFrame, n_words: int = TX.CONTEXT_WORDS) -> DataFrame:
    """Per project: ``documented`` ('true'/'false') and the first ``n_words`` words of the first
    README found in priority order. Result has one row per project (small; joined by AQE as a
    broadcast when its measured size allows)."""
    names = F.array(*[F.lit(n) for n in README_NAMES])
    cand = corpus.where(F.col("path").isin(*README_NAMES)).select(
        "project", F.array_position(names, F.col("path")).alias("pos"),
        TX.first_n_words(decode_lossy(F.substring("head", 1, TX.MAX_TEXT_BYTES)), n_words).alias("snippet"))
    best = cand.groupBy("project").agg(F.min_by("snippet", "pos").alias("snippet"))
    out = projects.select("project").distinct().join(best, "project", "left")
    return out.select("project", F.when(F.col("snippet").isNull(), F.lit("false")).otherwise(F.lit("true")).alias("documented"),
                      F.coalesce("snippet", F.lit("")).alias("snippet"))
