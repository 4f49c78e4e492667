"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a column that is true where a text fails. On a sample each rule is timed and its rejections
are counted; the rules are then ordered by rejections per cost, and one CASE tries them in that order, so a
text that an early rule rejects never meets the later ones. The order changes the work, not the verdict.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions._util import let

WHITE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 2_000


def text_words(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE, -1), "")


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are sorted by (hash, place); a window with an equal neighbour repeats. The repeating places, in
    order, cover min(3, distance to the next) words each. Windows are compared by a 64-bit hash."""
    n = F.size(words)
    later = lambda k: F.slice(words, k + 1, F.greatest(n - 2, F.lit(0)))
    windows = F.transform(F.arrays_zip(later(0), later(1), later(2)), lambda z: F.xxhash64(z["0"], z["1"], z["2"]))
    none = F.array(F.lit(None).cast("struct<h: bigint, i: int>"))

    def hits(order):
        m = F.size(order)
        beside = F.arrays_zip(order.alias("x"), F.concat(none, F.slice(order, 1, m - 1)).alias("p"), F.concat(F.slice(order, 2, m), none).alias("q"))
        same = F.filter(beside, lambda z: F.coalesce(z["x"]["h"] == z["p"]["h"], F.lit(False)) | F.coalesce(z["x"]["h"] == z["q"]["h"], F.lit(False)))
        return F.sort_array(F.transform(same, lambda z: z["x"]["i"]))

    def covered(places):
        steps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda a, b: F.coalesce(F.least(F.lit(3), b - a), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    def count(hashes):
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(let(order, hits), covered))

    return F.when(n < 4, 0).otherwise(let(windows, count)).cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, words, n_lines and the base measures, row for row; a null text has no words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    full_lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    staged = docs.select(F.col(id_col).alias("id"), text.alias("text"), text_words(text).alias("words"), full_lines.alias("lines"))
    return staged.select(
        "id", "text", "words", F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Columns over ``measure`` that are true where a text fails."""
    n = F.col("n_words")
    return {
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
        "symbols": 10 * F.col("n_symbols") > 3 * n,
        "duplicate_lines": 10 * F.col("n_dup_lines") > 6 * F.col("n_lines"),
        "letters": 2 * F.size(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))) < n,
        "few_distinct": 20 * F.size(F.array_distinct("words")) < n,
        "digits": 5 * F.length(F.regexp_replace("text", "[^0-9]+", "")) > 2 * F.col("word_chars"),
        "long_word": F.length(F.regexp_extract("text", r"[^\x20\x09-\x0D]{1000}", 0)) > 0,
    }


def cascade_order(sample: DataFrame, failed: dict[str, Column], seconds: dict[str, float] | None = None) -> list[str]:
    """Rule names by rejections per cost on measured rows of a sample, costs as timed or as given.

    An empty sample keeps the order of the rules."""
    sample = sample.persist()
    try:
        if not sample.count():
            return list(failed)
        rejected = sample.agg(*(F.sum(c.cast("int")).alias(k) for k, c in failed.items())).first()
        cost = dict(seconds or {})
        for k, c in failed.items():
            if k not in cost:
                began = time.perf_counter()
                sample.agg(F.sum(c.cast("int"))).first()
                cost[k] = time.perf_counter() - began
        return sorted(failed, key=lambda k: (-(rejected[k] or 0) / max(cost[k], 1e-6), cost[k]))
    finally:
        sample.unpersist()


def verdict(order: list[str], failed: dict[str, Column]) -> Column:
    """The name of the first rule that rejects, null where none does; later rules are not evaluated then."""
    out = F.when(base_failed(), "base")
    for k in order:
        out = out.when(failed[k], k)
    return out


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seconds: dict[str, float] | None = None,
          sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """id, the measures, base_failed and rejected_by, row for row. Null and empty texts have no words and fail the base; rows
    with equal ids are judged each by itself; other columns are not read; an empty table gives no rows. About ``sample_rows`` rows
    are measured beforehand to order the rules."""
    measured = measure(docs, id_col, text_col)
    failed = rules()
    share = min(1.0, sample_rows / max(docs.count(), 1))
    order = cascade_order(measure(docs.sample(share, seed=7), id_col, text_col), failed, seconds)
    return measured.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
                           verdict(order, failed).alias("rejected_by"))


def op3(docs: DataFrame) -> DataFrame:
    return judge(docs).select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                              F.col("rejected_by").isNull().alias("kept"))
