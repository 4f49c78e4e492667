"""The state as generations of a bucketed table: small writes, no exchange on its side of a join, safe attempts."""
import glob
import json

from pyspark.sql import functions as F

from docweave.operators.enrich import DeterministicClient
from docweave.operators.state import as_state, plan_changes
from docweave.plans import fixtures as FX
from docweave.plans.run import read_current_state, run
from docweave.sources import state_table as TB
from docweave.sources.corpus import corpus_from_table

from locations import SF_SMALL


def always():
    class Always(DeterministicClient):  # local: tasks get it by value
        def __call__(self, request):
            return json.dumps({"fileDescription": "Holds text", "joyThisFileBrings": 5, "personalityEmoji": "x"})

    return Always()


def state_of(spark, n, word="h"):
    return as_state(spark.range(n).select(F.lit("p").alias("project"), F.concat(F.lit("f"), "id").alias("path"), F.concat(F.lit(word), "id").alias("content_hash"),
                                          F.lit("d").alias("description")))


def rows(df):
    return sorted((r["project"], r["path"], r["content_hash"]) for r in df.collect())


def test_changes_write_changes_only(spark, tmp_path):
    out = str(tmp_path)
    v1 = TB.write_base(spark, state_of(spark, 5000), out, "one", 5000)
    TB.publish(spark, v1, "one")
    assert v1.rows == [5000] and len(glob.glob(f"{v1.location}/gen={v1.generations[0]}/*.parquet")) == v1.buckets
    changed = state_of(spark, 50, "new")                      # 1 percent
    gone = spark.createDataFrame([("p", "f4999"), ("p", "f4998")], "project string, path string")
    v2 = TB.write_changes(spark, v1, changed, gone, "two")
    assert v2.rows == [5000, 52]
    # an attempt without its pointer is not seen
    assert rows(read_current_state(spark, out)) == rows(state_of(spark, 5000))
    TB.publish(spark, v2, "two")
    want = dict((p, h) for _, p, h in rows(state_of(spark, 4998))) | dict((p, h) for _, p, h in rows(changed))
    assert rows(read_current_state(spark, out)) == sorted(("p", p, h) for p, h in want.items())
    # the earlier version can still be read
    assert TB.read_version(spark, v1).count() == 5000


def test_no_exchange_on_the_state_side(spark, tmp_path):
    v = TB.write_base(spark, state_of(spark, 3000), str(tmp_path), "one", 3000)
    v = TB.write_changes(spark, v, state_of(spark, 30, "new"), state_of(spark, 0).select("project", "path"), "two")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        corpus = spark.range(3000).select(F.when(F.col("id") < 0, F.lit("q")).otherwise("p").alias("project"), F.concat(F.lit("f"), "id").alias("path"), F.concat(F.lit("h"), "id").alias("content_hash"))
        plan = plan_changes(corpus, TB.read_version(spark, v))
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in text
        scan = text[:text.index("FileScan parquet")].rsplit("Join", 1)[1]
        assert "Exchange" not in scan.split("Range (")[-1]     # between the state's scan and the join
        acts = {r["action"]: r["n"] for r in plan.groupBy("action").agg(F.count("*").alias("n")).collect()}
        assert acts == {"reuse": 2970, "changed": 30}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_runs_write_their_changes(spark, tmp_path):
    cv, out = FX.corpus_v(spark, SF_SMALL), str(tmp_path / "a")
    first = run(spark, corpus_from_table(cv), None, out, always(), chunk_mode="window", run_ts="2025-01-01 00:00:00")
    n = first.state.count()
    changed = cv.withColumn("content", F.when(F.col("doc_id") == 7, F.concat("content", F.lit(" more"))).otherwise(F.col("content"))).where("doc_id <> 9")
    again = run(spark, corpus_from_table(changed), read_current_state(spark, out), out, always(), chunk_mode="window", run_ts="2025-02-01 00:00:00")
    v = TB.current_version(spark, out)
    assert v.rows == [n, again.plan.where("action <> 'reuse'").count() + 1] and v.rows[1] <= 3
    whole = run(spark, corpus_from_table(changed), None, str(tmp_path / "b"), always(), chunk_mode="window", run_ts="2025-02-01 00:00:00")
    assert rows(again.state) == rows(whole.state) == rows(read_current_state(spark, out))
    # nothing changed: nothing written
    run(spark, corpus_from_table(changed), read_current_state(spark, out), out, always(), chunk_mode="window")
    assert TB.current_version(spark, out).generations == v.generations


def test_a_new_base_after_many_generations(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(TB, "MAX_GENERATIONS", 2)
    cv, out = FX.corpus_v(spark, SF_SMALL).where("doc_id < 40"), str(tmp_path)
    bases, last = set(), None
    for i in range(4):
        corpus = corpus_from_table(cv.withColumn("content", F.when(F.col("doc_id") == i, F.concat("content", F.lit(" more"))).otherwise(F.col("content"))))
        last = run(spark, corpus, read_current_state(spark, out), out, always(), chunk_mode="window")
        bases.add(TB.current_version(spark, out).base)
    assert len(bases) == 2 and rows(last.state) == rows(read_current_state(spark, out)) and last.state.count() == last.plan.count()
    names = [t.name for t in spark.catalog.listTables() if t.name.startswith("docweave_state_")]
    assert TB.current_version(spark, out).table in names


def test_the_catalog_entry_is_made_again(spark, tmp_path):
    v = TB.write_base(spark, state_of(spark, 100), str(tmp_path), "one", 100)
    TB.publish(spark, v, "one")
    spark.sql(f"DROP TABLE {v.table}")
    assert read_current_state(spark, str(tmp_path)).count() == 100
