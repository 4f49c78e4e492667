"""Print the formatted physical plans reviewed in PLANS.md, on table input (corpus and state written
as parquet under the session's checkpoint folder), with the broadcast threshold off so the
large-table shapes show. Usage: explain_plans.py [sf_dir]"""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from docweave.operators import content as CO, hierarchy as H, reports as R, state as ST  # noqa: E402
from docweave.plans import fixtures as FX  # noqa: E402
from docweave.plans import run as RUN  # noqa: E402
from docweave.session import local_session, scratch_path  # noqa: E402
from docweave.sources.corpus import corpus_from_table  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    cp, sp = scratch_path(spark, "corpus"), scratch_path(spark, "state")
    FX.corpus_v(spark, sf).write.parquet(cp)
    ST.as_state(FX.state_v(spark, sf)).write.partitionBy("project").parquet(sp)
    corpus, state = corpus_from_table(spark.read.parquet(cp)), spark.read.parquet(sp)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = ST.plan_changes(corpus, state)
    ctx = CO.project_context(corpus, corpus.select("project"))
    shown = {
        "change plan (D3)": plan,
        "README context (C9)": ctx,
        "dirty fetch, exact keys": RUN.prompt_inputs_for_dirty(corpus, plan, ctx, 100, "window", n_projects=20),
        "dirty fetch, key hashes": RUN.prompt_inputs_for_dirty(corpus, plan, ctx, RUN.BROADCAST_KEYS_MAX + 1, "window",
                                                               n_projects=20),
        "roll-up (T3)": H.rollup_dirs(state, {"n": F.count(F.lit(1))}),
        "tree view (L5)": R.tree_lines(state.select("project", "path"), ST.load_annotations(state, "description"),
                                       write_nodes=False),
    }
    for name, df in shown.items():
        print(f"##### {name}")
        df.explain("formatted")


if __name__ == "__main__":
    main()
