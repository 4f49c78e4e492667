"""A directory holding a third of all rows: the skew-safe routes give the same answers."""
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docweave.operators import reports as R
from docweave.plans import fixtures as FX

from locations import SF_MID


def skewed_files(spark):
    d = FX.table(spark, SF_MID, "documents")
    hot = F.col("doc_id") % 3 == 0
    path = F.when(hot, F.concat(F.lit("hot/f"), F.col("doc_id").cast("string")))\
        .otherwise(F.concat(F.col("lang"), F.lit("/g"), F.col("doc_id").cast("string")))
    project = F.when(hot, F.lit("big")).otherwise(F.col("source"))
    return d.select(project.alias("project"), path.alias("path"), F.octet_length("text").cast("long").alias("size"),
                    F.timestamp_seconds(F.col("doc_id") * 60).alias("mtime"))


def window_index(rows):
    w = Window.partitionBy("project", "dir").orderBy(F.when(F.col("type") == "file", 0).otherwise(1), F.lower("name"), F.col("name"))
    return rows.drop("idx").withColumn("idx", (F.row_number().over(w) - 1).cast("long"))


@pytest.mark.parametrize("parts", [4, 200])
def test_range_index_equals_window_index(spark, parts):
    """All output columns, many tries: the index must not depend on how often a plan is sampled."""
    files = skewed_files(spark)
    nodes = R.listing_nodes(files, F.lit(FX.RUN_TS))
    odd = spark.createDataFrame([(None, "x", "file"), (None, "y", "file"), ("p", "z", "file")], "project string, name string, type string") \
        .select("project", F.lit(None).cast("string").alias("dir"), "name", "type")
    ann = spark.createDataFrame([], "project string, path string, description string, personality string, joy string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        for _ in range(10 if parts == 4 else 3):
            r = R.list_rows(nodes, ann, F.lit(FX.RUN_TS), fun=True)
            got = sorted(map(tuple, r.collect()), key=str)
            assert len(got) == nodes.where(~F.col("name").startswith(".")).count()
        assert got == sorted(map(tuple, window_index(r).select(*r.columns).collect()), key=str)
        i = R.index_within(odd, ["project", "dir"], [F.col("name")])
        assert sorted((str(x.project), x.name, x.idx) for x in i.collect()) == [("None", "x", 0), ("None", "y", 1), ("p", "z", 0)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    hot = r.where((F.col("project") == "big") & (F.col("dir") == "hot"))
    n = hot.count()
    assert n > 300 and hot.agg(F.min("idx"), F.max("idx")).first() == (0, n - 1)


def test_tree_on_hot_directory(spark):
    files = skewed_files(spark).select("project", "path")
    ann = spark.createDataFrame([], "project string, path string, description string")
    lines = R.tree_lines(files, ann).where(F.col("project") == "big").orderBy("sort_key").collect()
    assert lines[0]["line"] == "big" and lines[1]["line"] == "└── hot"
    assert all(x["line"].startswith("    ├── ") for x in lines[2:-1]) and lines[-1]["line"].startswith("    └── ")


def test_tree_and_listing_from_a_start_directory(spark):
    files = spark.createDataFrame([("p", "a/b/x.md"), ("p", "a/b/c/y.md"), ("p", "a/z.md"), ("p", "q.md")], "project string, path string")
    ann = spark.createDataFrame([("p", "a/b/x.md", "Explains x")], "project string, path string, description string")
    lines = [r["line"] for r in R.tree_lines(files, ann, start="a/b").orderBy("sort_key").collect()]
    assert lines == ["b", "├── c", "│   └── y.md", "└── x.md — Explains x"]
    nodes = R.listing_nodes(files.withColumn("size", F.lit(1).cast("long")).withColumn("mtime", F.current_timestamp()),
                            F.current_timestamp())
    empty = spark.createDataFrame([], "project string, path string, description string, personality string, joy string")
    rows = R.list_rows(nodes, empty, F.current_timestamp(), start="a/b").collect()
    assert sorted((r["dir"], r["idx"], r["name"]) for r in rows) == [("a/b", 0, "x.md"), ("a/b", 1, "c"), ("a/b/c", 0, "y.md")]


def test_export_of_a_hot_directory_and_depth(spark, tmp_path):
    """Sorted fragments are one JSON document per project, also as written parts; reading the lines gives the state back."""
    import json
    import os

    from docweave.operators import hierarchy as H
    from docweave.operators.state import as_state
    from docweave.sources.state_io import read_state_fragments, read_state_trees, write_nested
    rows = [("p", f"hot/f{i:04d}", "h", f"d \"{i}\"\n\u00e9") for i in range(3000)] + [("p", "/".join("abcdefghij") + "/x", "h", "deep"), ("q", "a", "h", ""),
            ("q", "a/b", "h", "same name"), ("q", "a.b", "h", "z")]
    state = as_state(spark.createDataFrame(rows, "project string, path string, content_hash string, description string"),
                     F.lit("2025-01-01 00:00:00"))
    out = H.nest_export(state, F.lit(FX.RUN_TS))
    text = {p: "".join(r.text for r in out.where(F.col("project") == p).orderBy("ord").collect()) for p in "pq"}
    assert [x["name"] for x in json.loads(text["p"])["entries"]] == ["a", "hot"] and len(json.loads(text["p"])["entries"][1]["entries"]) == 3000
    assert [(x["kind"], x["name"]) for x in json.loads(text["q"])["entries"]] == [("dir", "a"), ("file", "a"), ("file", "a.b")]
    write_nested(out, str(tmp_path / "x"))
    for p in "pq":
        d = tmp_path / "x" / f"project={p}"
        assert json.loads("".join(open(d / f).read() for f in sorted(os.listdir(d)) if f.startswith("part"))) == json.loads(text[p])
    want = sorted(tuple(r) for r in state.select("project", "path", "content_hash", "doc.description", "updated_at").collect())
    trees = spark.createDataFrame(list(text.items()), "project string, json string")
    for got in (read_state_fragments(out), read_state_trees(trees)):
        assert sorted(tuple(r) for r in got.select("project", "path", "content_hash", "doc.description", "updated_at").collect()) == want


def test_listing_from_start_folders(spark):
    """Nearest root, its annotations re-keyed, then the listing."""
    files = spark.createDataFrame([("p", "a/b/x.md", 10), ("p", "a/z.md", 20), ("p", "q.md", 30), ("r", "m.md", 5)], "project string, path string, size long") \
        .withColumn("mtime", F.lit("2025-01-01 00:00:00").cast("timestamp"))
    doc = lambda t: (t, None, "")
    states = spark.createDataFrame([("p", "", "q.md", doc("top q")), ("p", "", "a/b/x.md", doc("top x")), ("p", "a", "b/x.md", doc("near x")), ("p", "a", "z.md", doc("near z"))],
                                   "project string, root string, path string, doc struct<description: string, joy: string, emoji: string>")
    starts = spark.createDataFrame([("p", "a/b"), ("r", "")], "project string, start string")
    rows = R.list_from(files, states, starts, F.lit("2025-01-02 00:00:00")).collect()
    assert sorted((r["project"], r["dir"], r["idx"], r["name"], r["description"]) for r in rows) == [("p", "a/b", 0, "x.md", "near x"), ("r", "", 0, "m.md", "")]
