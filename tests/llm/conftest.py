import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))


@pytest.fixture(scope="session")
def frame(spark):
    """Rows of (doc_id, text) as documents over several partitions, with columns that clash with inner names."""
    def make(rows, parts=3):
        rows = [(i, t, "x", 7, "k") for i, t in rows]
        schema = "doc_id long, text string, id string, start int, key string"
        return spark.createDataFrame(rows, schema).repartition(parts) if rows else spark.createDataFrame([], schema)
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty, blank and very long texts, repeated rows, ties."""
    rnd = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "été", "ß", "日本", "12", "x,"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared = "This line is shared by very many documents of the table."
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, text(40)), (None, None), (4, text(4)), (5, text(30)), (5, None)]
    rows += [(6, text(30_000)), (7, "z" * 200_000), (8, "word"), (8, "word")]
    same = text(80)
    rows += [(i, same) for i in range(10, 16)] + [(10, same)]
    rows += [(i, f"{text(30)}\n  {shared.upper()}\t\n{text(20)}\n{shared}") for i in range(20, 40)]
    rows += [(i, same + " " + text(3)) for i in range(40, 46)]
    return rows
