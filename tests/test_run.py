"""End-to-end run with the deterministic describer: invariants of SURVEY §5."""
import tempfile

from pyspark.sql import functions as F

from docweave.operators.enrich import DeterministicClient
from docweave.plans import fixtures as FX
from docweave.plans.run import read_current_state, run
from docweave.sources.corpus import corpus_from_table

from locations import SF_SMALL


class CountingClient(DeterministicClient):
    pass


def test_first_and_second_run(spark):
    out = tempfile.mkdtemp(prefix="dw-run-")
    corpus = corpus_from_table(FX.corpus_v(spark, SF_SMALL))
    n_walk = corpus.where(~F.col("path").rlike(r"(^|/)\.")).count()

    r1 = run(spark, corpus, None, out, DeterministicClient(), chunk_mode="packed", run_ts="2025-01-01 00:00:00")
    actions = {r["action"]: r["n"] for r in r1.plan.groupBy("action").agg(F.count("*").alias("n")).collect()}
    assert actions == {"new": n_walk}                      # hidden files are not walked
    assert r1.state.count() == n_walk                       # every walked file in the new state
    assert r1.answers.count() == n_walk                     # one call per new file
    documented = r1.state.where(F.col("doc.description") != "").count()
    assert 0 < documented < n_walk                          # the test describer gives some unparseable answers

    prev = read_current_state(spark, out)
    r2 = run(spark, corpus, prev, out, DeterministicClient(), chunk_mode="packed", run_ts="2025-02-01 00:00:00")
    a2 = {r["action"]: r["n"] for r in r2.plan.groupBy("action").agg(F.count("*").alias("n")).collect()}
    assert a2.get("reuse", 0) == documented                 # unchanged and documented: reused
    assert a2.get("changed", 0) == n_walk - documented      # earlier enrichment failed: asked again
    assert r2.answers.count() == n_walk - documented        # the describer only sees non-reused rows
    same_ts = r2.state.alias("b").join(r1.state.alias("a"), ["project", "path"]) \
        .where((F.col("b.doc.description") != "") & (F.col("a.updated_at") == F.col("b.updated_at"))).count()
    assert same_ts == documented                            # reused rows keep their timestamp
    s = r2.summary.agg(F.sum("walked"), F.sum("n_reuse")).first()
    assert (s[0], s[1]) == (n_walk, documented)


def test_force_and_changed_content(spark):
    out = tempfile.mkdtemp(prefix="dw-run-")
    cv = FX.corpus_v(spark, SF_SMALL)
    corpus = corpus_from_table(cv)
    run(spark, corpus, None, out, DeterministicClient(), chunk_mode="window", run_ts="2025-01-01 00:00:00")
    prev = read_current_state(spark, out)
    changed = corpus_from_table(cv.withColumn("content", F.when(F.col("doc_id") % 10 == 0, F.concat("content", F.lit(" more")))
                                              .otherwise(F.col("content"))))
    r = run(spark, changed, prev, out, DeterministicClient(), chunk_mode="window", force=True)
    acts = {x["action"] for x in r.plan.select("action").distinct().collect()}
    assert acts == {"forced"}


def test_dirty_fetch_ways_agree(spark, monkeypatch):
    """Broadcast keys and chunk-first give the same prompt inputs."""
    from docweave.operators import content as CO
    from docweave.operators import state as ST
    from docweave.plans import run as RUN
    from docweave.session import materialize
    cv = FX.corpus_v(spark, SF_SMALL)
    corpus = corpus_from_table(cv)
    plan = materialize(ST.plan_changes(corpus, ST.as_state(FX.prev_v(spark, SF_SMALL, cv))), "plan")
    ctx = materialize(CO.project_context(corpus, corpus.select("project")), "ctx")

    def collect():
        df = RUN.prompt_inputs_for_dirty(corpus, plan, ctx, "window")
        return sorted((r["project"], r["path"], r["chunks"]["first"], r["snippet"]) for r in df.collect())

    keys = collect()
    monkeypatch.setattr(RUN, "BROADCAST_BYTES", 0)
    assert len(keys) == plan.where("action != 'reuse'").count() and keys == collect()


def test_an_unchanged_documented_corpus_asks_nothing(spark, tmp_path):
    import json

    class Always(DeterministicClient):
        def __call__(self, request):
            return json.dumps({"fileDescription": "Holds text", "joyThisFileBrings": 5, "personalityEmoji": "x"})

    corpus = corpus_from_table(FX.corpus_v(spark, SF_SMALL))
    first = run(spark, corpus, None, str(tmp_path), Always(), chunk_mode="window")
    again = run(spark, corpus, read_current_state(spark, str(tmp_path)), str(tmp_path), Always(), chunk_mode="window")
    assert again.answers.count() == 0 and again.plan.where("action <> 'reuse'").count() == 0
    assert again.state.count() == first.state.count() == again.summary.agg(F.sum("n_reuse")).first()[0]


def test_content_is_read_twice_at_most(spark, tmp_path):
    """One pass for the inventory, one for the dirty rows' text, with rules, nested states and the summary."""
    log = str(tmp_path / "reads")
    cv = corpus_from_table(FX.corpus_v(spark, SF_SMALL)).withColumn("mtime", F.lit("2024-01-01 00:00:00").cast("timestamp"))

    def seen(batches):
        for pdf in batches:
            with open(log, "a") as fh:
                fh.write("".join("x\n" for _ in range(len(pdf))))
            yield pdf

    corpus = cv.mapInPandas(seen, cv.schema)
    out = str(tmp_path / "out")
    r = run(spark, corpus, None, out, DeterministicClient(), chunk_mode="window", rules="inventory", nested="inventory")
    r.summary.collect()
    r.file_metrics.collect()
    assert len(open(log).readlines()) <= 2 * cv.count()
    assert r.file_metrics.count() == r.plan.count() and r.file_metrics.where("elapsed_ms is null").count() == 0


def test_state_files_follow_the_rows(spark, tmp_path):
    import glob

    from docweave.operators.state import as_state
    from docweave.sources.state_io import write_state
    state = as_state(spark.range(20_000).select(F.concat(F.lit("p"), F.col("id") % 500).alias("project"),
                                                F.concat(F.lit("f"), "id").alias("path"), F.lit("h").alias("content_hash"), F.lit("d").alias("description")))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        write_state(state.repartition(50), str(tmp_path / "s"))
        assert len(glob.glob(str(tmp_path / "s" / "*" / "*.parquet"))) == 500
        write_state(state, str(tmp_path / "t"), rows_per_file=10)
        assert len(glob.glob(str(tmp_path / "t" / "*" / "*.parquet"))) <= 500 * 4
        assert spark.read.parquet(str(tmp_path / "t")).count() == 20_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_waves_and_resume(spark):
    """Enrichment in several waves gives the same state; resuming the run asks nothing again."""
    out = tempfile.mkdtemp(prefix="dw-run-")
    corpus = corpus_from_table(FX.corpus_v(spark, SF_SMALL))
    r1 = run(spark, corpus, None, out, DeterministicClient(), chunk_mode="window", wave_rows=37, max_concurrency=2,
             run_ts="2025-01-01 00:00:00")
    n = r1.answers.count()
    before = sorted(r1.state.select("path", "doc.description").collect())   # the resumed run rewrites this run's folder
    calls = []

    class Spy(DeterministicClient):
        def __call__(self, request):
            calls.append(1)
            return super().__call__(request)

    r2 = run(spark, corpus, None, out, Spy(), chunk_mode="window", wave_rows=37, max_concurrency=2, resume_run_id=r1.run_id,
             run_ts="2025-01-01 00:00:00")
    assert r2.answers.count() == n and not calls           # every answer of the run is reused
    assert before == sorted(r2.state.select("path", "doc.description").collect())


def test_keep_previous_on_error(spark):
    """A forced rerun whose answer fails keeps the earlier doc only when asked to."""
    cv = FX.corpus_v(spark, SF_SMALL)
    corpus = corpus_from_table(cv)
    good = DeterministicClient()

    class Broken(DeterministicClient):
        def __call__(self, request):
            return "not json"

    for keep, expect_docs in ((False, 0), (True, None)):
        out = tempfile.mkdtemp(prefix="dw-keep-")
        r1 = run(spark, corpus, None, out, good, chunk_mode="window")
        documented = r1.state.where(F.col("doc.description") != "").count()
        r2 = run(spark, corpus, read_current_state(spark, out), out, Broken(), chunk_mode="window", force=True,
                 keep_previous_on_error=keep)
        got = r2.state.where(F.col("doc.description") != "").count()
        assert got == (documented if expect_docs is None else expect_docs)


def test_a_killed_job_keeps_what_its_tasks_ended(spark, tmp_path):
    """A worker dies in one partition; the resumed run asks for nothing that another partition answered."""
    import pytest
    corpus = corpus_from_table(FX.corpus_v(spark, SF_SMALL))
    out, log, broken = str(tmp_path / "out"), str(tmp_path / "log"), str(tmp_path / "broken")

    def client(request):
        import os
        import time
        path = request["fields"]["path"]
        if os.path.exists(broken) and open(broken).read() == path:
            time.sleep(10)
            os._exit(1)
        with open(log, "a") as fh:
            fh.write(request["fields"]["project"] + "/" + path + "\n")
        return DeterministicClient()(request)

    keep = dict(chunk_mode="window", unit_rows=10, resume_run_id="k", run_ts="2025-01-01 00:00:00")
    (tmp_path / "broken").write_text(corpus.where(~F.col("path").rlike(r"(^|/)\.")).agg(F.max("path")).first()[0])
    with pytest.raises(Exception):
        run(spark, corpus, None, out, client, **keep)
    (tmp_path / "broken").unlink()
    kept = {f"{r['project']}/{r['path']}" for r in spark.read.parquet(f"{out}/answers/run_id=k/wave=0").collect()}
    asked = len(open(log).read().split("\n")) - 1
    r = run(spark, corpus, None, out, client, **keep)
    again = open(log).read().split("\n")[asked:-1]
    assert kept and again and not kept & set(again) and r.answers.count() == r.plan.count()
