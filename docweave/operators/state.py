"""State operators: flatten (S3), annotations (S6), nested-state discovery (S4), nearest root (P9),
rebase and merge (D1, D2), change plan (D3), carry forward (D4), replacement (D5), stale keys (D6).

State schema: ``project, path, name, content_hash, hash_algo, updated_at, doc struct<description,
joy, emoji>`` with ``(project, path)`` the key. Last-wins merges use ``max_by`` (partial
aggregation) rather than a window, so a hot key is combined map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.answer import emoji_presentation, joy_text
from ..functions.text import trim_ws

KEY = ["project", "path"]
# Default file names, all of them parameters: the names of nested states searched below
# a root (ASCII case-insensitive) and the name that marks a documented root for list and tree views.
NESTED_STATE_NAMES = [".docstate.nu", ".docs.nuon"]
ROOT_STATE_NAME = ".docstate.nuon"
ALL_STATE_NAMES = [ROOT_STATE_NAME, *NESTED_STATE_NAMES]
DOC_SCHEMA = "struct<description:string,joy:string,emoji:string>"


def empty_doc():
    return F.struct(F.lit("").alias("description"), F.lit(None).cast("string").alias("joy"), F.lit("").alias("emoji"))


def as_state(df: DataFrame, updated_at=None, hash_algo: str = "sha256") -> DataFrame:
    """Bring ``(project, path, content_hash, description | doc [, updated_at])`` to the state schema."""
    cols = df.columns
    doc = F.col("doc") if "doc" in cols else F.struct(
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
        F.lit(None).cast("string").alias("joy"), F.lit("").alias("emoji"))
    ts = F.col("updated_at") if "updated_at" in cols else (updated_at if updated_at is not None else F.lit(None))
    return df.select(
        "project", "path", P.path_name("path").alias("name"), "content_hash",
        (F.col("hash_algo") if "hash_algo" in cols else F.lit(hash_algo)).alias("hash_algo"),
        ts.cast("timestamp").alias("updated_at"), doc.cast(DOC_SCHEMA).alias("doc"))


def flatten_state(rows: DataFrame, order_col: str = "ord") -> DataFrame:
    """Duplicate paths in one tree: the later record (greater ``ord``) wins."""
    other = [c for c in rows.columns if c not in KEY + [order_col]]
    agg = F.max_by(F.struct(*other), F.col(order_col)).alias("r")
    return rows.groupBy(*KEY).agg(agg).select(*KEY, "r.*")


def rebase_state(nested: DataFrame, base_col: str = "base") -> DataFrame:
    """Re-key a nested state's paths by putting its root's relative path in front."""
    return nested.withColumn("path", F.concat_ws("/", F.nullif(F.col(base_col), F.lit("")), F.col("path")))


def merge_states(own: DataFrame, nested: DataFrame | None, base_col: str = "base") -> DataFrame:
    """Own state first, then nested states in sorted directory order; the later one wins on equal
    path regardless of time. Sorted order compares path components, as directory paths do."""
    own_r = own.withColumn("_rank", F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("b")))
    if nested is None:
        return own
    reb = rebase_state(nested, base_col)
    nest_r = reb.withColumn("_rank", F.struct(F.lit(1).alias("n"), F.split(F.col(base_col), "/").alias("b"))) \
        .drop(base_col)
    u = own_r.unionByName(nest_r, allowMissingColumns=True)
    other = [c for c in u.columns if c not in KEY + ["_rank"]]
    return u.groupBy(*KEY).agg(F.max_by(F.struct(*other), F.col("_rank")).alias("r")).select(*KEY, "r.*")


def plan_changes(corpus: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """Action per inventoried file: ``new`` (no previous record), ``forced`` (force flag), ``reuse``
    (same hash and algorithm, non-empty previous description), else ``changed``.

    Only narrow columns take part: content never crosses this join.
    """
    c = corpus.select(*KEY, "content_hash", *(["hash_algo"] if "hash_algo" in corpus.columns else []))
    s_cols = state.columns
    prev_desc = F.col("doc.description") if "doc" in s_cols else F.col("description")
    s = state.select(*KEY, F.lit(True).alias("_known"), F.col("content_hash").alias("prev_hash"),
                     F.coalesce(prev_desc, F.lit("")).alias("prev_description"),
                     (F.col("hash_algo") if "hash_algo" in s_cols else F.lit(None).cast("string")).alias("prev_algo"))
    j = c.join(s, KEY, "left")
    same_algo = F.lit(True)
    if "hash_algo" in c.columns:
        same_algo = F.col("prev_algo").isNull() | (F.col("prev_algo") == F.col("hash_algo"))
    action = (F.when(F.col("_known").isNull(), F.lit("new"))
              .when(F.lit(force), F.lit("forced"))
              .when((F.col("prev_hash") == F.col("content_hash")) & same_algo & (F.col("prev_description") != ""),
                    F.lit("reuse"))
              .otherwise(F.lit("changed")))
    return j.select(*KEY, "content_hash", action.alias("action"), "prev_hash", "prev_description")


def carry_forward(plan: DataFrame, state: DataFrame) -> DataFrame:
    """Reused rows: current name, path and hash with the previous timestamp and doc."""
    reuse = plan.where(F.col("action") == "reuse").select(*KEY, "content_hash")
    prev = state.select(*KEY, "updated_at", "doc", *(["hash_algo"] if "hash_algo" in state.columns else []))
    return as_state(reuse.join(prev, KEY, "inner"))


def replace_state(reused: DataFrame, enriched: DataFrame) -> DataFrame:
    """New state = exactly the files of this walk: reused rows plus freshly enriched rows."""
    return as_state(reused).unionByName(as_state(enriched))


def stale_keys(state: DataFrame, corpus: DataFrame) -> DataFrame:
    """Previous keys that the new walk no longer has (what replacement drops)."""
    return state.select(*KEY).join(corpus.select(*KEY), KEY, "left_anti")


def load_annotations(state: DataFrame, require: str = "any") -> DataFrame:
    """Reader-side annotations: trimmed description and emoji, joy as text.

    ``require='any'`` (list view) keeps a record unless all three are empty; ``'description'``
    (tree view) keeps it only with a non-empty description.
    """
    desc = trim_ws(F.coalesce(F.col("doc.description"), F.lit("")))
    emo = trim_ws(F.coalesce(F.col("doc.emoji"), F.lit("")))
    joy = joy_text(F.col("doc.joy"))
    out = state.select(*KEY, desc.alias("description"), emo.alias("personality"), joy.alias("joy"))
    if require == "description":
        return out.where(F.col("description") != "")
    return out.where((F.col("description") != "") | (F.col("personality") != "") | (F.col("joy") != ""))


def fun_columns(ann: DataFrame) -> DataFrame:
    """Emoji presentation for the personality column (joy is already text)."""
    return ann.withColumn("personality", emoji_presentation("personality"))


def find_nested_states(inventory: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Directories holding a nested state file; nothing below such a directory is searched, so only
    the top-most ones are kept."""
    names = [n.lower() for n in (names or NESTED_STATE_NAMES)]
    marked = inventory.where(F.lower(P.path_name("path")).isin(*names)) \
        .select("project", P.parent_path("path").alias("dir")).distinct()
    anc = marked.select("project", "dir", F.explode(P.ancestors("dir", include_self=False, include_root=True)).alias("anc"))
    anc = anc.where(F.col("anc") != F.col("dir"))
    blocked = anc.join(marked.select("project", F.col("dir").alias("anc")), ["project", "anc"], "left_semi") \
        .select("project", "dir").distinct()
    return marked.join(blocked, ["project", "dir"], "left_anti")


def nearest_root(starts: DataFrame, roots: DataFrame, start_col: str = "start") -> DataFrame:
    """For each start path, the nearest ancestor-or-self that is a documented root (null if none):
    an as-of join on path depth via exploded prefixes and ``max_by``."""
    exp = starts.select("project", start_col,
                        F.explode(P.ancestors(start_col, include_self=True, include_root=True)).alias("root"))
    hit = exp.join(roots.select("project", F.col("dir").alias("root")).distinct(), ["project", "root"], "inner")
    best = hit.groupBy("project", start_col).agg(F.max_by("root", F.length("root")).alias("root"))
    return starts.select("project", start_col).distinct().join(best, ["project", start_col], "left")


def roots_from_inventory(inventory: DataFrame, name: str = ROOT_STATE_NAME) -> DataFrame:
    """Directories holding the root state file (exact name)."""
    return inventory.where(P.path_name("path") == name).select("project", P.parent_path("path").alias("dir")).distinct()
