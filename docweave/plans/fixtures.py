"""Test inputs derived from the driver's tables (FIXTURES.md), built with the DataFrame API.

Each builder reads the whole given table; nothing is sampled. The same views exist as SQL for the
DuckDB oracle in ``oracle.py`` (``FIXTURE_SQL``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_TS = "2025-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, project, path, content, content_hash)``, one row per document.

    The first two documents of each source (by id) become the README candidates. They are found with
    two partial aggregations instead of a window, so a source holding a third of all rows is never
    sorted in one task.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("project"), "lang",
                                                 F.col("text").alias("content"))
    first = d.groupBy("project").agg(F.min("doc_id").alias("m1"))
    second = (d.join(first, "project").where(F.col("doc_id") > F.col("m1"))
              .groupBy("project").agg(F.min("doc_id").alias("m2")))
    firsts = first.join(second, "project", "left")
    a = d.join(firsts, "project", "left")
    rn = F.when(F.col("doc_id") == F.col("m1"), 1).when(F.col("doc_id") == F.col("m2"), 2).otherwise(3)
    dir_ = (F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("."), "lang"))
            .when(F.col("doc_id") % 19 == 0, F.concat(F.lit("target/"), "lang")).otherwise(F.col("lang")))
    ext = F.element_at(F.array(*[F.lit(x) for x in [".md", ".rs", ".py", ".txt", "", ".json", ".MD", ".tar.gz"]]),
                       (F.col("doc_id") % 8 + 1).cast("int"))
    path = (F.when(rn == 1, F.lit("readme.md"))
            .when((rn == 2) & (F.length("project") == 4), F.lit("README.txt"))
            .otherwise(F.concat(dir_, F.lit("/d"), F.col("doc_id").cast("string"), ext)))
    return a.select("doc_id", "project", path.alias("path"), "content",
                    F.sha2(F.col("content"), 256).alias("content_hash"))


def prev_v(spark: SparkSession, sf_dir: str, corpus: DataFrame | None = None) -> DataFrame:
    """Previous state: 20 % missing, some stale hashes, some empty descriptions, deleted files."""
    c = corpus if corpus is not None else corpus_v(spark, sf_dir)
    kept = c.where(F.col("doc_id") % 5 != 0).select(
        "project", "path",
        F.when(F.col("doc_id") % 7 == 0, F.lit("stale")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(
            F.concat(F.lit("Kept "), F.col("doc_id").cast("string"))).alias("description"))
    gone = c.where(F.col("doc_id") % 13 == 0).select(
        "project", F.concat(F.lit("gone/d"), F.col("doc_id").cast("string")).alias("path"),
        F.lit("x").alias("content_hash"), F.lit("Gone").alias("description"))
    return kept.unionByName(gone)


def nested_v(spark: SparkSession, sf_dir: str, corpus: DataFrame | None = None) -> DataFrame:
    """Nested states of every project: one below each top directory, with paths relative to it."""
    c = corpus if corpus is not None else corpus_v(spark, sf_dir)
    return c.where(F.instr("path", "/") > 0).select(
        "project", F.substring_index("path", "/", 1).alias("base"), F.expr("substring(path, instr(path, '/') + 1)").alias("path"),
        "content_hash", F.concat(F.lit("Nested "), F.col("doc_id").cast("string")).alias("description"))


ANSWER_KINDS = 8


def answers_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model answer per document, eight kinds (good, aliases, cut, missing key, empty, wrong
    type, null joy plus extra key, object joy)."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 8
    ans = (F.when(k == 0, F.concat(F.lit('{"fileDescription":"This file is a note on '), "lang",
                                   F.lit('","joyThisFileBrings":7,"personalityEmoji":"x"}')))
           .when(k == 1, F.concat(F.lit('{"fileDescription":"Defines '), "source",
                                  F.lit('","howMuchJoyDoesThisFileBringYou":"8","emojiThatExpressesThisFilesPersonality":"y"}')))
           .when(k == 2, F.lit('{"fileDescription":"Broken'))
           .when(k == 3, F.lit('{"fileDescription":"No joy","personalityEmoji":"z"}'))
           .when(k == 4, F.lit(""))
           .when(k == 5, F.lit('{"fileDescription":5,"joyThisFileBrings":1,"personalityEmoji":"x"}'))
           .when(k == 6, F.lit('{"fileDescription":"Extra","joyThisFileBrings":null,"personalityEmoji":"x","more":1}'))
           .otherwise(F.lit('{"fileDescription":"this config: Holds keys","joyThisFileBrings":{"a":[1]},"personalityEmoji":"x"}')))
    return d.select("doc_id", ans.alias("answer"))


def state_v(spark: SparkSession, sf_dir: str, corpus: DataFrame | None = None) -> DataFrame:
    """A documented state with all three doc fields: padded, empty and JSON-typed values."""
    c = corpus if corpus is not None else corpus_v(spark, sf_dir)
    i = F.col("doc_id")
    lang = F.regexp_extract("path", r"^\.?(?:target/)?([a-z]{2})/", 1)
    desc = (F.when(i % 11 == 0, F.lit("")).when(i % 11 == 1, F.concat(F.lit("  Padded "), i.cast("string"), F.lit("  ")))
            .otherwise(F.concat(F.lit("Doc "), i.cast("string"))))
    joy = (F.when(i % 4 == 0, F.lit(None).cast("string")).when(i % 4 == 1, ((i % 10) + 1).cast("string"))
           .when(i % 4 == 2, F.concat(F.lit('"'), F.coalesce(F.nullif(lang, F.lit("")), F.lit("root")), F.lit('"')))
           .otherwise(F.lit('{"a":[1]}')))
    emoji = (F.when(i % 5 == 0, F.lit("")).when(i % 5 == 1, F.lit(" x ")).when(i % 5 == 2, F.lit("\U0001F418"))
             .when(i % 5 == 3, F.lit("\U0001F418\ufe0f")).otherwise(F.lit("ab")))
    upd = F.timestamp_seconds(F.unix_timestamp(F.lit(RUN_TS)) - i * 3600)
    return c.select("doc_id", "project", "path", "content_hash", upd.alias("updated_at"),
                    F.struct(desc.alias("description"), joy.alias("joy"), emoji.alias("emoji")).alias("doc"))


def state_trees_v(spark: SparkSession, sf_dir: str, corpus: DataFrame | None = None) -> DataFrame:
    """Nested JSON trees, one per project and 50 documents: files two directories deep and at the root, by ``doc_id % 13`` with
    older keys (3), a missing field (5), a wrong kind (7), a null doc (9) or an earlier record of the same path (11); every
    seventh tree is cut off."""
    from ..operators.hierarchy import file_node_json

    s = state_v(spark, sf_dir, corpus)
    i = F.col("doc_id") % 13
    js = file_node_json(s.select("project", "path", "content_hash", "updated_at", "doc")).select("project", "path", "json")
    older = F.regexp_replace(F.regexp_replace("json", '"joyThisFileBrings":', '"howMuchJoyDoesThisFileBringYou":'),
                             '"personalityEmoji":', '"emojiThatExpressesThisFilesPersonality":')
    node = (F.when(i == 3, older).when(i == 5, F.regexp_replace("json", ',"personalityEmoji":"[^"]*"', ""))
            .when(i == 7, F.regexp_replace("json", '^\\{"kind":"file"', '{"kind":"link"'))
            .when(i == 9, F.regexp_replace("json", '"doc":.*$', '"doc":null}'))
            .when(i == 11, F.concat(F.regexp_replace("json", '"hash":"[^"]*"', '"hash":"old"'), F.lit(","), "json")).otherwise(F.col("json")))
    tree = F.floor(F.col("doc_id") / 50)
    rows = s.join(js, ["project", "path"]).select("project", tree.alias("tree"), F.struct("doc_id", node.alias("node")).alias("n"))
    folded = rows.groupBy("project", "tree").agg(F.array_sort(F.collect_list("n")).alias("n"))  # 50 records at most
    part = lambda odd: F.array_join(F.transform(F.filter("n", lambda x: x["doc_id"] % 2 == odd), lambda x: x["node"]), ",")
    deep = F.concat(F.lit('{"kind":"dir","name":"a","path":"a","updated_at":"2025-01-01T00:00:00Z","entries":[{"kind":"dir","name":"b","path":"a/b","entries":['),
                    part(0), F.lit("]}]}"))
    rest = part(1)
    whole = F.concat(F.lit('{"root":".","updated_at":"2025-01-01T00:00:00Z","entries":['), deep, F.when(rest == "", "").otherwise(F.concat(F.lit(","), rest)), F.lit("]}"))
    return folded.select("project", F.concat(F.lit("t"), F.col("tree").cast("string")).alias("base"),
                         F.when(F.col("tree") % 7 == 4, F.substring(whole, F.lit(1), F.length(whole) - 4)).otherwise(whole).alias("json"))


STATE_NAME_VARIANTS = [".docstate.nu", ".DOCS.NUON", ".docstate.nuon", ".Docstate.Nu"]


def markers_v(spark: SparkSession, sf_dir: str, corpus: DataFrame | None = None) -> DataFrame:
    """Inventory of state files placed next to documents (``doc_id % 23``) and two levels below
    them (``doc_id % 31``), in four name spellings."""
    c = corpus if corpus is not None else corpus_v(spark, sf_dir)
    i = F.col("doc_id")
    dir_ = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    name = F.element_at(F.array(*[F.lit(x) for x in STATE_NAME_VARIANTS]), (i % 4 + 1).cast("int"))
    near = c.where(i % 23 == 0).select("project", F.concat_ws("/", F.nullif(dir_, F.lit("")), name).alias("path"))
    deep = c.where(i % 31 == 0).select("project", F.concat_ws(
        "/", F.nullif(dir_, F.lit("")), F.concat(F.lit("d"), i.cast("string")), F.lit("sub"), name).alias("path"))
    return near.unionByName(deep)


# Ignore lines of every project: rule_dir, level, seq, line. Level 1 = repository exclude, 2 = ignore files.
RULE_LINES = [
    ("", 2, 1, "*.json"),
    ("en", 2, 1, "!d[0-9]*1.json"),
    ("", 2, 2, "target/"),
    ("target/en", 2, 1, "!*"),
    ("", 1, 1, "*.M[!a]"),
    ("fr", 2, 1, "!d[0-9]*5.MD"),
    ("", 2, 3, "[z-a]*"),
    ("", 2, 4, "[[]x"),
    ("", 2, 5, "d2*.[p-r][!a&&x]"),
    ("", 2, 6, "es/d*7.py"),
    ("", 2, 7, "# a comment"),
]
GLOBAL_LINES = [("", 0, 1, "*.tar.gz")]


def rules_v(spark: SparkSession, sf_dir: str, corpus: DataFrame | None = None) -> DataFrame:
    """Compiled ignore rules of all projects of the corpus, and the user-global ones (project null)."""
    from ..operators.inventory import compile_ignore_patterns

    c = corpus if corpus is not None else corpus_v(spark, sf_dir)

    def with_lines(df, lines):
        rows = F.array(*[F.struct(F.lit(d).alias("rule_dir"), F.lit(lv).alias("level"), F.lit(s).alias("seq"), F.lit(x).alias("line"))
                         for d, lv, s, x in lines])
        return df.select("project", F.explode(rows).alias("r")).select("project", "r.*")

    lines = with_lines(c.select("project").distinct(), RULE_LINES).unionByName(
        with_lines(spark.range(1).select(F.lit(None).cast("string").alias("project")), GLOBAL_LINES))
    return compile_ignore_patterns(lines).select("project", "rule_dir", "level", "seq", "regex", "negated", "dir_only")
