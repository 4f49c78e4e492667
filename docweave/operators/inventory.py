"""Inventory filters: hidden entries (P5), pruned directory names (P6), version-control ignore rules
as a join (P7) and compilation of ignore-file lines to regexes (P8).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths as P

BROADCAST_RULE_BYTES = 32 << 20
SALTS = 64


def drop_hidden(df: DataFrame, path_col: str = "path", show_all: bool = False) -> DataFrame:
    """Drop entries whose name starts with a dot and everything beneath hidden directories."""
    return df if show_all else df.where(~P.is_hidden_path(path_col))


def prune_dirs(df: DataFrame, names: list[str], path_col: str = "path") -> DataFrame:
    """Drop everything below a directory whose exact name is in ``names`` (a file of that name stays)."""
    return df.where(~P.under_pruned_dir(path_col, names)) if names else df


def derive_nodes(files: DataFrame) -> DataFrame:
    """Files plus one directory node per distinct path prefix: ``project, path, is_dir``.

    The prefixes are de-duplicated right after the explode, so a prefix is carried once per map
    task (partial aggregation), then once in total.
    """
    dirs = files.select("project", F.explode(P.ancestors("path")).alias("path")).distinct() \
        .withColumn("is_dir", F.lit(True))
    return files.select("project", "path", F.lit(False).alias("is_dir")).unionByName(dirs)


def _bounded(df: DataFrame, limit: int) -> bool:
    """Whether a rules table's text, as it would be broadcast, has at most ``limit`` bytes."""
    size = sum((F.octet_length(F.to_json(F.struct(c))) for c in df.columns), F.lit(0))
    return (df.agg(F.sum(size)).first()[0] or 0) <= limit


def _rule_matches(nodes: DataFrame, rules: DataFrame, by_project: bool) -> DataFrame:
    """Per node and rule directory at or above it, the last rule of that directory that matches the node.

    Rules are one row per directory, with its lines in an array, so a node meets a directory once and not
    once per line. Small tables (by their bytes) are broadcast; beyond that the directory's row is copied
    to ``SALTS`` keys, so the nodes below one hot root directory are spread over as many tasks.
    """
    key = ["project", "rule_dir"] if by_project else ["rule_dir"]
    r = rules.where(F.col("project").isNotNull() if by_project else F.col("project").isNull())
    r = r.groupBy(*key).agg(F.collect_list(F.struct("level", "seq", "regex", "negated", "dir_only")).alias("lines"))
    cand = nodes.select("project", "path", "is_dir",
                        F.explode(P.ancestors("path", include_root=True)).alias("rule_dir"))
    if _bounded(r, BROADCAST_RULE_BYTES):
        j = cand.join(F.broadcast(r), key, "inner")
    else:
        salted = r.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        j = cand.withColumn("_salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")).join(salted, [*key, "_salt"], "inner")
    rel = F.when(F.col("rule_dir") == "", F.col("path")).otherwise(
        F.expr("substring(path, length(rule_dir) + 2)"))
    hit = F.filter("lines", lambda x: F.regexp_like(rel, F.concat(F.lit("^(?:"), x["regex"], F.lit(")$"))) & (~x["dir_only"] | F.col("is_dir")))
    last = F.array_max(F.transform(hit, lambda x: F.struct(x["level"].alias("level"), F.length("rule_dir").alias("depth"),
                                                          x["seq"].alias("seq"), x["negated"].alias("negated"))))
    return j.select("project", "path", "is_dir", last.alias("last")).where(F.col("last").isNotNull())


def rule_verdicts(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Per matched node the last matching rule's verdict: ``negated`` true = re-included.
    Precedence: level (global < repository exclude < ignore files), deeper rule directory, later line."""
    m = _rule_matches(nodes, rules, True).unionByName(_rule_matches(nodes, rules, False))
    return m.groupBy("project", "path", "is_dir").agg(F.max("last").alias("last")).select("project", "path", "is_dir", "last.negated")


def ignored_nodes(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Nodes whose last matching rule excludes them."""
    return rule_verdicts(nodes, rules).where(~F.col("negated")).select("project", "path", "is_dir")


def apply_ignore_rules(files: DataFrame, rules: DataFrame, hidden: bool = False) -> DataFrame:
    """Keep the files no ignore rule excludes; a file below an excluded directory stays excluded
    even when a deeper rule re-includes it (an excluded directory is never entered).

    ``hidden=True`` also applies the hidden filter the way the walker does: a hidden entry is
    excluded unless a rule explicitly re-includes it.
    """
    nodes = derive_nodes(files.select("project", "path"))
    if hidden:
        v = rule_verdicts(nodes, rules)
        st = nodes.join(v, ["project", "path", "is_dir"], "left")
        excl = st.where((F.col("negated") == F.lit(False)) |
                        (P.is_hidden_name(P.path_name("path")) & ~F.coalesce(F.col("negated"), F.lit(False))))
        ign = excl.select("project", "path", "is_dir")
    else:
        ign = ignored_nodes(nodes, rules)
    anc = files.select("project", F.col("path").alias("file"),
                       F.explode(P.ancestors("path", include_self=True)).alias("path"))
    anc = anc.withColumn("is_dir", F.col("path") != F.col("file"))
    excluded = anc.join(ign, ["project", "path", "is_dir"], "left_semi").select("project", F.col("file").alias("path")).distinct()
    return files.join(excluded, ["project", "path"], "left_anti")


# ---------------------------------------------------------------- P8: ignore-file lines -> regex

NOTHING = r"[^\s\S]"


def _class(body: str, negated_class: bool) -> str:
    """A bracket expression: ranges in order (reversed ones hold nothing), never a path separator, every sign
    but letters and digits escaped, as engines differ in what else is special inside brackets."""
    members, i = [], 0
    while i < len(body):
        if body[i] == "\\" and i + 1 < len(body):
            i += 1
        low = high = body[i]
        if body[i + 1:i + 2] == "-" and i + 2 < len(body):
            i += 2
            if body[i] == "\\" and i + 1 < len(body):
                i += 1
            high = body[i]
        i += 1
        members.append((low, high))
    if negated_class:
        members.insert(0, ("/", "/"))
    else:
        members = [m for low, high in members for m in ([(low, "."), ("0", high)] if low <= "/" <= high else [(low, high)])]
    members = [(low, high) for low, high in members if low <= high]
    if not members:
        return NOTHING
    sign = lambda c: c if c.isalnum() or ord(c) > 127 else "\\" + c
    return "[" + "^" * negated_class + "".join(sign(a) if a == b else f"{sign(a)}-{sign(b)}" for a, b in members) + "]"


def glob_to_regex(line: str) -> dict | None:
    """One ignore-file line to ``{regex, negated, dir_only, anchored}``; None for blanks/comments, and a
    null regex for a line that is no valid pattern.

    Matching is against the path relative to the ignore file's directory, as a full match.
    """
    if line is None:
        return None
    s = line.rstrip("\n").rstrip("\r")
    # trailing spaces are dropped unless escaped
    while s.endswith(" ") and not s.endswith("\\ "):
        s = s[:-1]
    if not s or s.startswith("#"):
        return None
    negated = s.startswith("!")
    if negated:
        s = s[1:]
    elif s.startswith("\\!") or s.startswith("\\#"):
        s = s[1:]
    dir_only = s.endswith("/")
    s = s.rstrip("/")
    if not s:
        return None
    anchored = "/" in s
    s = s.lstrip("/")
    out, i = [], 0
    while i < len(s):
        if s.startswith("**/", i) and (i == 0 or s[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif s.startswith("/**", i) and i + 3 == len(s):
            out.append("/.*")
            i += 3
        elif s[i] == "*":
            out.append("[^/]*")
            i += 1
        elif s[i] == "?":
            out.append("[^/]")
            i += 1
        elif s[i] == "[":
            first = i + 2 if s[i + 1:i + 2] in ("!", "^") else i + 1  # a ] right there is a member
            j = s.find("]", first + 1)
            if j < 0:
                out.append(re.escape(s[i]))
                i += 1
            else:
                out.append(_class(s[first:j], negated_class=first == i + 2))
                i = j + 1
        elif s[i] == "\\" and i + 1 < len(s):
            out.append(re.escape(s[i + 1]))
            i += 2
        else:
            out.append(re.escape(s[i]) if not s[i].isalnum() else s[i])
            i += 1
    body = "".join(out)
    regex = body if anchored else "(?:.*/)?" + body
    try:
        re.compile(regex)
    except re.error:
        regex = None  # reported by rejected_patterns
    return {"regex": regex, "negated": negated, "dir_only": dir_only, "anchored": anchored}


RULE_SCHEMA = T.StructType([T.StructField("regex", T.StringType()), T.StructField("negated", T.BooleanType()),
                            T.StructField("dir_only", T.BooleanType()), T.StructField("anchored", T.BooleanType())])


@F.pandas_udf(RULE_SCHEMA)
def compile_ignore_line(lines: pd.Series) -> pd.DataFrame:
    """Arrow-batched compilation of ignore-file lines (null struct fields for blanks/comments)."""
    rows = [glob_to_regex(x) or {"regex": None, "negated": None, "dir_only": None, "anchored": None} for x in lines]
    return pd.DataFrame(rows, columns=["regex", "negated", "dir_only", "anchored"])


def compile_ignore_patterns(lines: DataFrame) -> DataFrame:
    """``(project, rule_dir, level, seq, line)`` -> rules table usable by ``apply_ignore_rules``."""
    c = lines.withColumn("_c", compile_ignore_line(F.col("line")))
    return c.where(F.col("_c.regex").isNotNull()).select(
        "project", "rule_dir", "level", "seq", "line", "_c.regex", "_c.negated", "_c.dir_only", "_c.anchored")


def rejected_patterns(lines: DataFrame) -> DataFrame:
    """The lines that are neither blank nor a comment and still give no rule; they never fail a job."""
    c = lines.withColumn("_c", compile_ignore_line(F.col("line")))
    return c.where(F.col("_c.regex").isNull() & F.col("_c.negated").isNotNull()).select("project", "rule_dir", "level", "seq", "line")


# Ignore files honoured inside a tree and their precedence level (higher wins):
# repository exclude file 1, version-control ignore files 2, generic ignore files 3.
IGNORE_FILE_LEVELS = {".gitignore": 2, ".ignore": 3}
EXCLUDE_FILE = ".git/info/exclude"


def rules_from_inventory(corpus: DataFrame, require_git: bool = True) -> DataFrame:
    """Rules table from the ignore files found in the inventory itself (needs ``head``).

    Each file's lines become rules of its directory (the exclude file's rules belong to the
    repository root above ``.git``); lines are numbered so later lines win. With ``require_git``
    the version-control files count only inside a repository (a ``.git`` directory at or above
    them); generic ignore files always count.
    """
    from .chunking import decode_lossy

    name = P.path_name("path")
    is_excl = (F.col("path") == EXCLUDE_FILE) | F.col("path").endswith("/" + EXCLUDE_FILE)
    is_ign = name.isin(*IGNORE_FILE_LEVELS)
    level = F.when(is_excl, F.lit(1))
    for n, lv in IGNORE_FILE_LEVELS.items():
        level = level.when(name == n, F.lit(lv))
    rule_dir = F.when(is_excl, F.regexp_extract("path", r"^(.*?)/?\.git/info/exclude$", 1)).otherwise(P.parent_path("path"))
    files = corpus.where(is_ign | is_excl).select("project", "path", rule_dir.alias("rule_dir"), level.alias("level"),
                                                  is_excl.alias("is_excl"), (name == ".gitignore").alias("is_vcs"), "head")
    if require_git:
        # repository roots: directories holding a .git directory (seen through the files inside it)
        repos = corpus.where(F.col("path").rlike(r"(^|/)\.git/")) \
            .select("project", F.regexp_extract("path", r"^(.*?)/?\.git/.*$", 1).alias("repo")).distinct()
        anc = files.where("is_vcs").select("project", "path", F.explode(P.ancestors("rule_dir", include_self=True,
                                                                                       include_root=True)).alias("repo"))
        inside = anc.join(repos, ["project", "repo"], "left_semi").select("project", "path").distinct()
        files = files.where(~F.col("is_vcs")).unionByName(files.where("is_vcs").join(inside, ["project", "path"], "left_semi"))
    f = files.select("project", "rule_dir", "level",
                     F.posexplode(F.split(decode_lossy("head"), r"\r?\n")).alias("seq", "line"))
    return compile_ignore_patterns(f.withColumn("seq", F.col("seq").cast("long")))
