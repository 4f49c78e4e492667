"""Hierarchy: directory nodes (T1), directory stamps (T2), roll-ups (T3), nested JSON export (T4).

Directories are derived, never stored: each is a distinct path prefix of the files below it. The
prefix explode is followed at once by a partial aggregation, so each prefix leaves a map task once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P

KEY = ["project", "path"]


def derive_nodes(files: DataFrame) -> DataFrame:
    """``project, path, parent_path, name, depth, kind`` for files and every directory prefix.
    A directory and a file of the same name may coexist."""
    f = files.select("project", "path", F.lit("file").alias("kind"))
    d = files.select("project", F.explode(P.ancestors("path")).alias("path")).distinct().withColumn("kind", F.lit("dir"))
    n = f.unionByName(d)
    return n.select("project", "path", P.parent_path("path").alias("parent_path"), P.path_name("path").alias("name"),
                    P.depth("path").alias("depth"), "kind")


def rollup_dirs(files: DataFrame, measures: dict[str, Column] | None = None, include_root: bool = True) -> DataFrame:
    """Per directory (and the root ''), aggregates over all files below it.

    ``measures`` maps output names to aggregate expressions over the file rows; defaults count the
    files. Explode prefixes, then ``groupBy`` with map-side partial aggregation: a hot directory is
    combined in every map task before the shuffle.
    """
    measures = measures or {"n_files": F.count(F.lit(1))}
    exp = files.select("*", F.explode(P.ancestors("path", include_root=include_root)).alias("dir"))
    return exp.groupBy("project", "dir").agg(*[v.alias(k) for k, v in measures.items()])


def stamp_dirs(state: DataFrame, run_ts) -> DataFrame:
    """Directory records: the run timestamp as ``updated_at`` (time of the last insert beneath it)
    and the newest file timestamp below as ``content_updated_at``. Full paths are written."""
    r = rollup_dirs(state, {"content_updated_at": F.max("updated_at"), "n_files": F.count(F.lit(1))}, include_root=False)
    return r.select("project", F.col("dir").alias("path"), P.path_name("dir").alias("name"),
                    F.lit(run_ts).cast("timestamp").alias("updated_at"), "content_updated_at", "n_files")


# ---------------------------------------------------------------- T4: nested JSON export

def _jstr(c: Column) -> Column:
    """JSON string literal of a text column."""
    return F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)


def _ts_json(c: Column) -> Column:
    fmt = F.when(F.date_format(c, "SSSSSS") == "000000", F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")) \
        .otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return F.concat(F.lit('"'), fmt, F.lit('"'))


def file_node_json(state: DataFrame) -> DataFrame:
    """One JSON object per file record, ``kind`` tagged, with the doc object."""
    doc = F.concat(F.lit('{"fileDescription":'), _jstr(F.coalesce("doc.description", F.lit(""))),
                   F.lit(',"joyThisFileBrings":'), F.coalesce(F.col("doc.joy"), F.lit("null")),
                   F.lit(',"personalityEmoji":'), _jstr(F.coalesce("doc.emoji", F.lit(""))), F.lit("}"))
    js = F.concat(F.lit('{"kind":"file","name":'), _jstr(P.path_name("path")), F.lit(',"path":'), _jstr(F.col("path")),
                  F.lit(',"hash":'), _jstr(F.col("content_hash")), F.lit(',"updated_at":'), _ts_json(F.col("updated_at")),
                  F.lit(',"doc":'), doc, F.lit("}"))
    return state.select("project", "path", P.parent_path("path").alias("parent_path"), P.depth("path").alias("depth"),
                        P.path_name("path").alias("name"), F.lit(1).alias("kind_order"), js.alias("json"))


LAST = "\U0010ffff"  # sorts behind every name


def _order_key(path: Column, is_dir: Column) -> Column:
    """Pre-order of the export: per level the name, then directories before files."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.array_join(F.transform(parts, lambda c, i: F.concat(
        c, F.lit("\u0001"), F.when((i < n - 1) | is_dir, F.lit("0")).otherwise(F.lit("1")), F.lit("\u0002"))), "")


def nest_export(state: DataFrame, run_ts, root_label: Column | None = None) -> DataFrame:
    """Nested JSON of every project in ordered fragments: ``project, ord, part, text``.

    Each node gives its own opening text (with a comma unless it is its parent's first entry) and a
    directory its closing text; sorted by ``ord`` the fragments of a project are its document, whatever its
    size or depth. No node's text is held by its parent. First entries are one row per directory,
    joined on their own full path, so a directory with very many entries is no hot key.
    """
    s = state.select("project", "path", "content_hash", "updated_at", "doc")
    files = file_node_json(s).select("project", "path", F.lit(False).alias("is_dir"), "json")
    ts = _ts_json(F.lit(run_ts).cast("timestamp"))
    dirs = s.select("project", F.explode(P.ancestors("path")).alias("path")).distinct()
    opened = F.concat(F.lit('{"kind":"dir","name":'), _jstr(P.path_name("path")), F.lit(',"path":'), _jstr(F.col("path")),
                      F.lit(',"updated_at":'), ts, F.lit(',"entries":['))
    nodes = files.unionByName(dirs.select("project", "path", F.lit(True).alias("is_dir"), opened.alias("json")))
    entry = F.struct(P.path_name("path").alias("name"), (~F.col("is_dir")).alias("file"), "path")
    first = nodes.groupBy("project", P.parent_path("path").alias("parent")).agg(F.min(entry).alias("e")) \
        .select("project", F.col("e.path").alias("path"), (~F.col("e.file")).alias("is_dir"), F.lit(True).alias("is_first"))
    marked = nodes.join(first, ["project", "path", "is_dir"], "left")
    comma = F.when(F.col("is_first"), F.lit("")).otherwise(F.lit(","))
    out = marked.select("project", _order_key(F.col("path"), F.col("is_dir")).alias("ord"),
                        F.when(F.col("is_dir"), F.lit("open")).otherwise(F.lit("file")).alias("part"), F.concat(comma, "json").alias("text"))
    closed = dirs.select("project", F.concat(_order_key(F.col("path"), F.lit(True)), F.lit(LAST)).alias("ord"),
                         F.lit("close").alias("part"), F.lit("]}").alias("text"))
    label = root_label if root_label is not None else F.col("project")
    top = s.select("project").distinct()
    root = top.select("project", F.lit("").alias("ord"), F.lit("open").alias("part"), F.concat(
        F.lit('{"root":'), _jstr(label), F.lit(',"updated_at":'), ts, F.lit(',"entries":[')).alias("text"))
    end = top.select("project", F.lit(LAST).alias("ord"), F.lit("close").alias("part"), F.lit("]}").alias("text"))
    return root.unionByName(out).unionByName(closed).unionByName(end)
