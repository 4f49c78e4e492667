"""Benchmark: the documentation run (first, unchanged, 1 % changed) and the headline queries.

Prints one JSON line: {"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}.
Inputs: $BENCH_SF_DIR (default /root/testdata/sf0.1), $BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["plan_changes", "merge_states", "stale_keys", "apply_ignore_rules", "find_nested_states", "nearest_root",
            "project_context", "content_type", "is_probably_text", "token_chunks", "pick_three", "file_metrics",
            "render_prompt", "enrich", "parse_answer", "answer_contract", "clean_description", "rollup_dirs",
            "list_recursive", "tree_view", "nest_export", "read_state"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import functions as F

    from docweave.operators.enrich import DeterministicClient as Fields

    class DeterministicClient(Fields):
        """Always a valid answer, so the unchanged rerun shows what an unchanged corpus costs."""

        def __call__(self, request):
            f = request["fields"]
            return json.dumps({"fileDescription": f"Stores {f['filetype']} text", "joyThisFileBrings": 5, "personalityEmoji": "x"})

    from docweave.plans import fixtures as FX
    from docweave.plans.queries import REGISTRY
    from docweave.plans.run import read_current_state, run
    from docweave.session import local_session, scratch_path
    from docweave.sources.corpus import corpus_from_table

    spark = local_session(app="docweave-bench", cpus=cpus, extra={"spark.sql.shuffle.partitions": str(int(cpus) * 2)})
    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.time()
        fn()
        times[name] = round(time.time() - t0, 3)

    # the incremental run: first run, unchanged rerun, rerun with 1 % of the documents changed,
    # over the corpus as a table (written once, as a real inventory would be)
    out = scratch_path(spark, "bench")
    corpus_path = os.path.join(out, "corpus_table")
    timed("corpus_table", lambda: FX.corpus_v(spark, sf_dir).write.parquet(corpus_path))
    cv = spark.read.parquet(corpus_path)
    corpus = corpus_from_table(cv)
    timed("run_first", lambda: run(spark, corpus, None, out, DeterministicClient(), chunk_mode="packed",
                                   run_ts="2025-01-01 00:00:00"))
    again: list = []
    timed("run_unchanged", lambda: again.append(run(spark, corpus, read_current_state(spark, out), out, DeterministicClient(),
                                                    chunk_mode="packed", run_ts="2025-01-02 00:00:00")))
    assert again[0].answers.count() == 0, "an unchanged corpus asks nothing"
    changed = corpus_from_table(cv.withColumn("content", F.when(F.col("doc_id") % 100 == 0, F.concat("content", F.lit(" edit")))
                                              .otherwise(F.col("content"))))
    timed("run_1pct_changed", lambda: run(spark, changed, read_current_state(spark, out), out, DeterministicClient(),
                                          chunk_mode="packed", run_ts="2025-01-03 00:00:00"))

    for name in HEADLINE:
        fn = REGISTRY[name][0]
        timed(name, lambda fn=fn: fn(spark, sf_dir).write.format("noop").mode("overwrite").save())

    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(sf.group(1)) if sf else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
