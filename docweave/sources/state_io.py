"""State files: import of nested JSON trees (S2, flattened by S3) and the table write.

A nested tree is one document, so it is parsed whole by one task; many trees (one per project or
nested root) parse in parallel. Ordinary runs read and write the flat parquet state instead.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.state import DOC_SCHEMA

# Doc keys and the older alias keys accepted when reading.
DOC_KEYS = {"description": ["fileDescription"],
            "joy": ["joyThisFileBrings", "howMuchJoyDoesThisFileBringYou"],
            "emoji": ["personalityEmoji", "emojiThatExpressesThisFilesPersonality"]}

FLAT_SCHEMA = ("project string, base string, path string, name string, content_hash string, updated_at string, "
               "description string, joy string, emoji string, ord long, bad_records long")


def _doc(d) -> tuple | None:
    if d is None:
        return ("", None, "")
    if not isinstance(d, dict):
        return None
    out = []
    for k, names in DOC_KEYS.items():
        present = [n for n in names if n in d]
        if len(present) != 1:
            return None  # missing field or key given under both names
        v = d[present[0]]
        if k == "joy":
            out.append(None if v is None else json.dumps(v, ensure_ascii=False, separators=(",", ":")))
        elif not isinstance(v, str):
            return None
        else:
            out.append(v)
    return tuple(out)


def _walk(nodes, project, rows, counter):
    for n in nodes or []:
        if not isinstance(n, dict):
            counter[0] += 1
            continue
        if n.get("kind") == "dir":
            _walk(n.get("entries"), project, rows, counter)
        elif n.get("kind") == "file":
            doc = _doc(n.get("doc"))
            if doc is None or not isinstance(n.get("path"), str) or not isinstance(n.get("hash"), str):
                counter[0] += 1  # reject only the bad record
                continue
            rows.append([project, n["path"], n.get("name", ""), n["hash"], n.get("updated_at"), *doc, len(rows)])
        else:
            counter[0] += 1


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        bases = pdf["base"] if "base" in pdf.columns else [""] * len(pdf)
        for project, base, text in zip(pdf["project"], bases, pdf["json"]):
            try:
                tree = json.loads(text)
            except (TypeError, ValueError):
                continue  # unreadable tree: no records, never a failure
            if not isinstance(tree, dict):
                continue
            rows, bad = [], [0]
            _walk(tree.get("entries"), project, rows, bad)
            out.extend([r[0], base] + r[1:] + [bad[0]] for r in rows)
        yield pd.DataFrame(out, columns=["project", "base", "path", "name", "content_hash", "updated_at", "description",
                                         "joy", "emoji", "ord", "bad_records"])


def rejected_records(trees: DataFrame) -> DataFrame:
    """Per tree: ``project[, base], bad_records, unreadable`` (the tree itself is no JSON object)."""
    has_base = "base" in trees.columns

    def count(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                try:
                    tree = json.loads(r.json)
                except (TypeError, ValueError):
                    tree = None
                bad = [0]
                if isinstance(tree, dict):
                    _walk(tree.get("entries"), r.project, [], bad)
                out.append((r.project, getattr(r, "base", ""), bad[0], not isinstance(tree, dict)))
            yield pd.DataFrame(out, columns=["project", "base", "bad_records", "unreadable"])

    out = trees.select("project", "json", *(["base"] if has_base else [])).mapInPandas(
        count, "project string, base string, bad_records long, unreadable boolean")
    return out if has_base else out.drop("base")


def read_state_trees(trees: DataFrame, hash_algo: str | None = None) -> DataFrame:
    """``(project, json[, base])`` nested trees -> flat state rows (``base`` kept when given); a
    duplicate path within one tree keeps the later record. ``hash_algo`` names the digest that the trees
    hold, null when it isn't known; what is left out is in ``rejected_records``."""
    has_base = "base" in trees.columns
    flat = trees.select("project", "json", *(["base"] if has_base else [])).mapInPandas(_parse, FLAT_SCHEMA)
    flat = flat.drop("bad_records")
    keys = ["project", "base"] if has_base else ["project"]
    if not has_base:
        flat = flat.drop("base")
    # last record wins per (tree, path)
    other = [c for c in flat.columns if c not in keys + ["path", "ord"]]
    s = flat.groupBy(*keys, "path").agg(F.max_by(F.struct(*other), "ord").alias("r")).select(*keys, "path", "r.*")
    return s.select(*keys, "path", "name", "content_hash", F.lit(hash_algo).cast("string").alias("hash_algo"),
                    F.to_timestamp("updated_at").alias("updated_at"),
                    F.struct("description", "joy", "emoji").cast(DOC_SCHEMA).alias("doc"))


def nested_trees_from_inventory(corpus: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``project, base, json`` of the nested state files of a scanned tree: ``base`` is the nested
    root's directory. Top-most roots only; per root the first existing name in list order; the
    files' text comes from the scan (state files are read whole). Fully distributed."""
    from ..functions import paths as P
    from ..operators.chunking import decode_lossy
    from ..operators.state import NESTED_STATE_NAMES, find_nested_states

    names = [n.lower() for n in (names or NESTED_STATE_NAMES)]
    roots = find_nested_states(corpus.select("project", "path"), names)
    arr = F.array(*[F.lit(n) for n in names])
    files = corpus.where(F.lower(P.path_name("path")).isin(*names)).select(
        "project", P.parent_path("path").alias("dir"), F.array_position(arr, F.lower(P.path_name("path"))).alias("pos"),
        decode_lossy("head").alias("json"))
    pick = files.join(roots, ["project", "dir"], "left_semi").groupBy("project", "dir") \
        .agg(F.min_by("json", "pos").alias("json"))
    return pick.select("project", F.col("dir").alias("base"), "json")


def nested_states_from_inventory(corpus: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The records of the nested state files of a scanned tree, ready for ``merge_states``."""
    return read_state_trees(nested_trees_from_inventory(corpus, names))


def _read_whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for project, path in zip(pdf["project"], pdf["file"]):
            try:
                with open(path, "rb") as fh:
                    out.append((project, fh.read().decode("utf-8", "replace")))
            except OSError:
                continue  # unreadable state file: no records, never a failure
        yield pd.DataFrame(out, columns=["project", "json"])


def read_state_files(spark, paths: list[str], project_from_path: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """Read nested state files whole, one task row per file; the project is taken from the path.

    State files have names starting with a dot, which Spark's file sources skip, so the files are
    opened by the tasks themselves (shared storage); the path list is spread over the partitions.
    """
    import re

    rows = [(m.group(1) if (m := re.search(project_from_path, p)) else "", p) for p in paths]
    files = spark.createDataFrame(rows, "project string, file string")
    files = files.repartition(max(1, min(len(rows), int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return read_state_trees(files.mapInPandas(_read_whole, "project string, json string"))


def write_state(state: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Flat state table, partitioned by project.

    Each project's rows go to as many tasks as it has files' worth of rows, and to no other, so the number
    of files follows the rows and not tasks times projects."""
    spark = state.sparkSession
    sizes = state.groupBy("project").agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_per_file)).cast("int").alias("_files"))
    salted = state.join(sizes.withColumnRenamed("project", "_p"), F.col("project").eqNullSafe(F.col("_p")), "left").drop("_p")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64("path"), F.col("_files")))
    salted.repartition(n, "project", "_salt").drop("_salt", "_files").write.mode("overwrite").partitionBy("project").parquet(path)


def read_state_fragments(fragments: DataFrame) -> DataFrame:
    """Flat state rows from the export's lines, each parsed on its own; duplicates keep the later line.

    Every row of a file stands on one line, so a tree of any size is read by as many tasks as it has parts."""
    v = F.try_parse_json(F.regexp_replace("text", "^,", ""))
    get = lambda p: F.try_variant_get(F.col("v"), p, "string")
    rows = fragments.where(F.col("part") == "file").select("project", "ord", v.alias("v")).select(
        "project", "ord", get("$.path").alias("path"), get("$.name").alias("name"), get("$.hash").alias("content_hash"),
        get("$.hash_algo").alias("hash_algo"), get("$.updated_at").alias("updated_at"), get("$.doc.fileDescription").alias("description"),
        F.to_json(F.try_variant_get(F.col("v"), "$.doc.joyThisFileBrings", "variant")).alias("joy"), get("$.doc.personalityEmoji").alias("emoji"))
    other = ["name", "content_hash", "hash_algo", "updated_at", "description", "joy", "emoji"]
    last = rows.where(F.col("path").isNotNull()).groupBy("project", "path").agg(F.max_by(F.struct(*other), "ord").alias("r")).select("project", "path", "r.*")
    return last.select("project", "path", "name", "content_hash", "hash_algo", F.to_timestamp("updated_at").alias("updated_at"),
                       F.struct("description", F.nullif("joy", F.lit("null")).alias("joy"), "emoji").cast(DOC_SCHEMA).alias("doc"))


def write_nested(fragments: DataFrame, path: str) -> None:
    """The export as text under ``path/project=.../``: the parts of a project, in name order, are its document."""
    spark = fragments.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fragments.repartitionByRange(n, "project", "ord").sortWithinPartitions("project", "ord").select("project", F.col("text").alias("value")) \
        .write.mode("overwrite").partitionBy("project").text(path)
