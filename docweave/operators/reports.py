"""Reports on the state: annotation join (L1), directory listings (L2, L3), fun columns (L4),
tree view (L5) and its styles (L6).

Ordering never relies on a window over one huge partition: the tree's pre-order is a string sort
key built per row from its own path, ``is_last`` comes from a per-parent ``max`` (partial
aggregation) joined back, and listing indexes come from a range sort with per-partition offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as TX
from ..functions.answer import emoji_presentation
from ..session import materialize
from .state import load_annotations, nearest_root, rebase_state

KEY = ["project", "path"]
SEP = "\u0001"  # lowest separator: a shorter name sorts first, a parent before its children

# Connector styles (connector for a non-last / last child, continuation below a
# non-last / last directory).
STYLES = {
    "classic": {"dir": ("├── ", "└── "), "file": ("├── ", "└── "), "cont": ("│   ", "    ")},
    "emoji": {"dir": ("🪾 ", "🪾 "), "file": ("🍃 ", "🍃 "), "cont": ("🪾  ", "   ")},
}
DESC_SEP = " — "


def annotate(nodes: DataFrame, annotations: DataFrame) -> DataFrame:
    """Left join of entries with annotations by root-relative path; missing values are ''."""
    ann = annotations.select(*KEY, *[c for c in ("description", "personality", "joy") if c in annotations.columns])
    j = nodes.join(ann, KEY, "left")
    for c in ("description", "personality", "joy"):
        if c in j.columns:
            j = j.withColumn(c, F.coalesce(F.col(c), F.lit("")))
    return j


def index_within(df: DataFrame, group: list[str], order: list[Column], n_partitions: int | None = None) -> DataFrame:
    """Adds ``idx`` (0-based position within ``group`` by ``order``), whatever the size of a group.

    Rows are range partitioned by (group, order), so a huge group is spread over many tasks, and written
    with their place (partition, row) as stored columns. The count of a group's rows in earlier
    partitions comes from a small per-(group, partition) table of what was written: both sides of the
    join see one and the same partitioning.
    """
    keys = [F.col(g) for g in group] + order
    n = n_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the range partitioner samples its input: read it from a written table, not recomputed
    df = materialize(df, "index-input")
    s = materialize(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                    .withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()), "index-sorted")
    w = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    per = s.groupBy(*group, "_pid").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_cnt")) \
        .withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    per = per.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_pid").alias("_p"), "_first", "_off")
    same = F.col("_pid") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return s.join(per, same).withColumn("idx", (F.col("_off") + F.col("_mid") - F.col("_first")).cast("long")) \
        .select(*df.columns, "idx")


def listing_nodes(files: DataFrame, run_ts) -> DataFrame:
    """Entries for listings: files with size and mtime, directories with size 0 and the newest
    mtime below them. ``files`` needs ``project, path, size, mtime``."""
    f = files.select("project", "path", F.lit("file").alias("type"), "size", "mtime")
    d = files.select("project", "mtime", F.explode(P.ancestors("path")).alias("path")) \
        .groupBy("project", "path").agg(F.max("mtime").alias("mtime")) \
        .select("project", "path", F.lit("dir").alias("type"), F.lit(0).cast("long").alias("size"), "mtime")
    n = f.unionByName(d)
    return n.select("*", P.parent_path("path").alias("parent_path"), P.path_name("path").alias("name"))


def list_rows(nodes: DataFrame, annotations: DataFrame, run_ts, show_all: bool = False, fun: bool = False,
              directory: str | None = None, start: str | None = None) -> DataFrame:
    """Listing rows ``project, dir, idx, name, type, size, modified, description[, personality, joy]``.

    One directory (``directory``) or every directory at once (``None``: the recursive listing, where
    hidden directories are still listed, only their hidden children are not). Files first, then
    case-insensitive name; index from 0.
    """
    n = nodes if directory is None else nodes.where(F.col("parent_path") == directory)
    if start:  # recursive listing of one subtree: the start directory and every directory below it
        n = n.where((F.col("parent_path") == start) | F.col("parent_path").startswith(start + "/"))
    if not show_all:
        n = n.where(~P.is_hidden_name(F.col("name")))
    n = annotate(n, annotations)
    n = n.select("project", F.col("parent_path").alias("dir"), "name", "type",
                 TX.decimal_size_label("size", F.col("type") == "file").alias("size"),
                 TX.age_label("mtime", F.lit(run_ts).cast("timestamp")).alias("modified"), "description",
                 *([emoji_presentation("personality").alias("personality"), "joy"] if fun else []))
    order = [F.when(F.col("type") == "file", 0).otherwise(1), F.lower("name"), F.col("name")]
    return index_within(n, ["project", "dir"], order)


def list_from(files: DataFrame, states: DataFrame, starts: DataFrame, run_ts, show_all: bool = False, fun: bool = False) -> DataFrame:
    """Listings of start folders, as a user asks for them: the nearest documented root at or above each
    start, that root's annotations re-keyed to the project, then the rows of the start folder.

    ``files``: ``project, path, size, mtime``; ``states``: flat records with ``project, root, path, doc``, paths
    relative to their ``root``; ``starts``: ``project, start``. A start without a root is listed without
    annotations."""
    roots = states.select("project", F.col("root").alias("dir")).distinct()
    near = nearest_root(starts, roots)
    used = states.join(near.select("project", "root").distinct(), ["project", "root"], "left_semi")
    ann = load_annotations(rebase_state(used.select("project", F.col("root").alias("base"), "path", "doc")))
    nodes = listing_nodes(files, run_ts)
    asked = starts.select("project", F.col("start").alias("parent_path")).distinct()
    return list_rows(nodes.join(asked, ["project", "parent_path"], "left_semi"), ann, run_ts, show_all, fun)


def _sort_key(path: Column, is_dir: Column) -> Column:
    """Pre-order key from the path alone: per level kind (dir 0, file 1), lower name, name."""
    parts = F.split(path, "/")
    n = F.size(parts)
    enc = F.transform(parts, lambda c, i: F.concat(
        F.when((i < n - 1) | is_dir, F.lit("0")).otherwise(F.lit("1")), F.lower(c), F.lit(SEP), c, F.lit(SEP)))
    return F.array_join(enc, "")


def tree_lines(files: DataFrame, annotations: DataFrame, style: str = "classic", root_label: Column | None = None,
               write_nodes: bool = True, start: str | None = None) -> DataFrame:
    """Tree view lines ``project, path, depth, sort_key, line`` (root line has path '' and depth 0).

    Filters (hidden, pruned names, ignore rules) are applied to ``files`` by the caller; directories
    are the prefixes of what remains. Order the output by ``(project, sort_key)``. With ``start``
    the tree is the subtree below that directory: paths and depths are relative to it, the root line
    is its base name, and annotations are still found by the full path.
    """
    if start:
        pref = start.rstrip("/") + "/"

        def below(df):
            return df.where(F.col("path").startswith(pref)).withColumn("path", F.expr(f"substring(path, {len(pref) + 1})"))

        files, annotations = below(files), below(annotations)
        if root_label is None:
            root_label = F.lit(start.rstrip("/").split("/")[-1])
    st = STYLES[style]
    fl = files.select("project", "path")
    dirs = fl.select("project", F.explode(P.ancestors("path")).alias("path")).distinct()
    nodes = fl.withColumn("is_dir", F.lit(False)).unionByName(dirs.withColumn("is_dir", F.lit(True)))
    nodes = nodes.select("project", "path", "is_dir", P.parent_path("path").alias("parent_path"),
                         P.path_name("path").alias("name"), P.depth("path").alias("depth"))
    sib = F.struct(F.when(F.col("is_dir"), 0).otherwise(1).alias("k"), F.lower("name").alias("l"), F.col("name").alias("n"))
    nodes = nodes.withColumn("_sib", sib)
    if write_nodes:  # used four times below: scan, explode and distinct once, from the shared folder
        nodes = materialize(nodes, "tree-nodes")
        dirs = nodes.where("is_dir").select("project", "path")
    # per directory: its last child (a partial max) ...
    last = nodes.groupBy("project", "parent_path").agg(F.max("_sib").alias("_max"))
    dirs_last = nodes.where("is_dir").join(last, ["project", "parent_path"], "inner") \
        .select("project", F.col("path").alias("anc"), "depth", (F.col("_sib") == F.col("_max")).alias("is_last"))
    # ... and the continuation text it contributes to every line below it
    dflag = dirs_last.select("project", "anc", "depth", F.when(F.col("is_last"), F.lit(st["cont"][1]))
                             .otherwise(F.lit(st["cont"][0])).alias("cont"))
    dexp = dirs.select("project", "path", F.explode(P.ancestors("path", include_self=True)).alias("anc"))
    prefixes = dexp.join(dflag, ["project", "anc"], "inner").groupBy("project", "path").agg(
        F.array_sort(F.collect_list(F.struct("depth", "cont"))).alias("c")) \
        .select("project", F.col("path").alias("parent_path"),
                F.array_join(F.transform("c", lambda x: x["cont"]), "").alias("prefix"))
    # one join of the node set with the per-parent table (last child + prefix); the root has no prefix
    per_parent = last.join(prefixes, ["project", "parent_path"], "left")
    nodes = nodes.join(per_parent, ["project", "parent_path"], "inner") \
        .withColumn("is_last", F.col("_sib") == F.col("_max")).withColumn("prefix", F.coalesce("prefix", F.lit(""))) \
        .drop("_sib", "_max")
    ann = annotations.select(*KEY, "description")
    nodes = nodes.join(ann, KEY, "left")
    conn = (F.when(F.col("is_dir") & F.col("is_last"), F.lit(st["dir"][1]))
            .when(F.col("is_dir"), F.lit(st["dir"][0]))
            .when(F.col("is_last"), F.lit(st["file"][1])).otherwise(F.lit(st["file"][0])))
    desc = F.coalesce(F.col("description"), F.lit(""))
    line = F.concat("prefix", conn, "name", F.when(desc != "", F.concat(F.lit(DESC_SEP), desc)).otherwise(F.lit("")))
    out = nodes.select("project", "path", F.col("depth").cast("long").alias("depth"),
                       _sort_key(F.col("path"), F.col("is_dir")).alias("sort_key"), line.alias("line"))
    label = root_label if root_label is not None else F.col("project")
    roots = fl.select("project").distinct().select("project", F.lit("").alias("path"), F.lit(0).cast("long").alias("depth"),
                                                   F.lit("").alias("sort_key"), label.alias("line"))
    return roots.unionByName(out)
