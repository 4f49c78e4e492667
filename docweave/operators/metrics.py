"""Run metrics (M1) and per-file metrics (M2): plain grouped counts on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIONS = ["new", "changed", "reuse", "forced"]


def run_summary(plan: DataFrame, prev_state: DataFrame, stale: DataFrame, nested: DataFrame | None = None,
                new_state: DataFrame | None = None, unreadable: DataFrame | None = None,
                rejected: DataFrame | None = None) -> DataFrame:
    """Per project: files walked, previous records, counts per action, stale records; with
    ``nested`` the number of nested states and their rows, with ``new_state`` the records written, with
    ``unreadable`` (rows of the scan) the entries that could not be read, with ``rejected`` the records
    and trees that state files lost.

    Each input is reduced by a partial aggregation before the (small, per-project) joins.
    """
    w = plan.groupBy("project").agg(
        F.count(F.lit(1)).alias("walked"),
        *[F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ACTIONS])
    e = prev_state.groupBy("project").agg(F.count(F.lit(1)).alias("existing"))
    s = stale.groupBy("project").agg(F.count(F.lit(1)).alias("stale"))
    out = w.join(e, "project", "left").join(s, "project", "left")
    cols = ["project", F.col("walked").cast("long"), F.coalesce("existing", F.lit(0)).cast("long").alias("existing"),
            *[F.col(f"n_{a}").cast("long") for a in ACTIONS], F.coalesce("stale", F.lit(0)).cast("long").alias("stale")]
    if nested is not None:
        n = nested.groupBy("project").agg(F.count_distinct("base").alias("nested_states"),
                                          F.count(F.lit(1)).alias("nested_rows"))
        out = out.join(n, "project", "left")
        cols += [F.coalesce("nested_states", F.lit(0)).cast("long").alias("nested_states"),
                 F.coalesce("nested_rows", F.lit(0)).cast("long").alias("nested_rows")]
    if new_state is not None:
        u = new_state.groupBy("project").agg(F.count(F.lit(1)).alias("updated"))
        out = out.join(u, "project", "left")
        cols += [F.coalesce("updated", F.lit(0)).cast("long").alias("updated")]
    if unreadable is not None:
        x = unreadable.groupBy("project").agg(F.count(F.lit(1)).alias("unreadable"))
        out = out.join(x, "project", "left")
        cols.append(F.coalesce("unreadable", F.lit(0)).cast("long").alias("unreadable"))
    if rejected is not None:
        b = rejected.groupBy("project").agg(F.sum("bad_records").alias("bad_records"), F.count_if("unreadable").alias("bad_trees"))
        out = out.join(b, "project", "left")
        cols += [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("bad_records", "bad_trees")]
    return out.select(*cols)


def nested_summary(own: DataFrame, nested: DataFrame, base_col: str = "base") -> DataFrame:
    """Per nested state: its rows and how many keys it added to the own state (after rebasing)."""
    reb = nested.select("project", base_col,
                        F.concat_ws("/", F.nullif(F.col(base_col), F.lit("")), F.col("path")).alias("path"))
    known = own.select("project", "path").withColumn("_own", F.lit(True))
    j = reb.join(known, ["project", "path"], "left")
    return j.groupBy("project", base_col).agg(F.count(F.lit(1)).alias("rows"),
                                              F.count_if(F.col("_own").isNull()).alias("added"))


def file_metrics(fingerprints: DataFrame, triples: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Per file: size label, type, splitter used, byte lengths of the three chunks, call time."""
    lengths = [F.col("chunks.used").alias("splitter_used"),
               F.octet_length("chunks.first").cast("long").alias("chunk1_bytes"),
               F.octet_length("chunks.mid").cast("long").alias("chunk2_bytes"),
               F.octet_length("chunks.last").cast("long").alias("chunk3_bytes")]
    meta = ["project", "path", "size_label", "file_type", "content_type"]
    if triples is fingerprints:  # computed in one projection: no join
        out = fingerprints.select(*meta, *lengths)
    else:
        out = fingerprints.select(*meta).join(triples.select("project", "path", *lengths), ["project", "path"], "inner")
    if answers is not None:
        out = out.join(answers.select("project", "path", "elapsed_ms", "attempts"), ["project", "path"], "left")
    return out
