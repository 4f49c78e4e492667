"""Registered queries: one per operator of SURVEY §2, each ``(spark, sf_dir) -> DataFrame``, with the
DuckDB oracle SQL next to it. Every query reads the driver's tables (through the fixture views)
in full. Computed columns are aliased and cast so both engines give the same names and types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracle_sql import with_views

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def deco(fn):
        REGISTRY[name] = (fn, with_views(sql, *views) if sql is not None else None)
        return fn
    return deco


def ts_text(c) -> F.Column:
    """Timestamps leave queries as ISO text so both engines agree on the value."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


SQL_TS = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"

# import the modules that register queries
from . import q_state, q_paths, q_content, q_chunks, q_prompt, q_hierarchy, q_reports  # noqa: E402,F401
