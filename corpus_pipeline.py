"""The corpus pipeline: toxicity, line dedup, near duplicates, benchmark decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's documents. All stages but the last return the columns of documents."""

from __future__ import annotations

from docweave.llm.pipeline import STAGES, run

# SQL can express neither the trained classifier of the first stage nor what follows from it
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
