"""Plan tests: no registered query builds a cartesian product or a nested-loop join."""
import pytest

import __spark_entry__ as E

from locations import SF_SMALL

BAD = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_pairwise_joins(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(b in plan for b in BAD), plan[:2000]


def _exchange_inputs(df):
    """The column lists that cross each exchange of the formatted plan."""
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    out, lines = [], text.split("\n")
    for i, line in enumerate(lines):
        if ") Exchange" in line or ") BroadcastExchange" in line:
            for nxt in lines[i + 1:i + 4]:
                if nxt.startswith("Input ["):
                    out.append(nxt)
    return out


def test_content_never_crosses_an_exchange(spark, tmp_path, monkeypatch):
    from docweave.operators import content as CO
    from docweave.operators import state as ST
    from docweave.plans import fixtures as FX
    from docweave.plans import run as RUN
    from docweave.sources.corpus import corpus_from_table
    FX.corpus_v(spark, SF_SMALL).write.parquet(str(tmp_path / "corpus"))
    ST.as_state(FX.state_v(spark, SF_SMALL)).write.parquet(str(tmp_path / "state"))
    corpus = corpus_from_table(spark.read.parquet(str(tmp_path / "corpus")))
    state = spark.read.parquet(str(tmp_path / "state"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ST.plan_changes(corpus, state)
        ctx = CO.project_context(corpus, corpus.select("project"))
        checks = {"plan": plan,
                  "dirty_keys": RUN.prompt_inputs_for_dirty(corpus, plan, ctx, "window")}
        monkeypatch.setattr(RUN, "BROADCAST_BYTES", 0)
        checks["dirty_chunks"] = RUN.prompt_inputs_for_dirty(corpus, plan, ctx, "window")
        # the detector itself: a naive join of the corpus with the state does move the content
        naive = corpus.join(state.select("project", "path"), ["project", "path"])
        assert any("head#" in x for x in _exchange_inputs(naive))
        for name, df in checks.items():
            ex = _exchange_inputs(df)
            assert ex, name
            heavy = [x for x in ex if "content#" in x or "head#" in x]
            assert not heavy, (name, heavy)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["prompt_fields", "render_prompt", "enrich", "finalize_record", "replace_state"])
def test_prompt_queries_move_no_file_heads(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = E.queries()[name](spark, SF_SMALL)
        assert not [x for x in _exchange_inputs(df) if "content#" in x or "head#" in x]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
