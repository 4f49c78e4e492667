from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_or_lit(x) -> Column:
    """Accept a Column, a column name, or (wrapped in ``F.lit``) a constant."""
    if isinstance(x, Column):
        return x
    return F.col(x)


def sql_str(s: str) -> str:
    """Quote a Python string as a SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a one-element ``transform``).

    Spark does not share a subexpression that several CASE branches repeat; binding it here keeps a
    regex or split over a large text from running once per reference.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
