"""Continuous documentation: a Structured Streaming query over arriving file versions.

Each micro-batch is one partial run (only the batch's keys are planned, enriched and merged into
the state; other records are kept). The run id is derived from the batch id, so a batch replayed
after a failure resumes its own answers table instead of asking the describer again.

    stream = spark.readStream.schema("project string, path string, content string, mtime timestamp")
                  .parquet(incoming_dir)
    q = document_stream(stream, out_dir, DeterministicClient(), checkpoint=f"{out_dir}/_stream")
    q.processAllAvailable()
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.run import read_current_state, run
from ..sources.corpus import corpus_from_table


def document_batch(batch: DataFrame, batch_id: int, out_dir: str, client: Callable[[dict], str], **run_options):
    """One micro-batch as a partial run resumed by its batch id (a replay asks nothing again).

    Within a batch the latest version per ``(project, path)`` wins, by ``mtime`` (without it, the greatest content).
    """
    spark = batch.sparkSession
    cols = batch.columns
    rest = F.struct(*[c for c in cols if c not in ("project", "path")])
    # one row per key in either case; without times the greatest content stands for the key
    latest = batch.groupBy("project", "path").agg(F.max_by(rest, F.struct("mtime", rest) if "mtime" in cols else rest).alias("r")) \
        .select("project", "path", "r.*")
    corpus = corpus_from_table(latest, mtime="mtime" if "mtime" in cols else None)
    return run(spark, corpus, read_current_state(spark, out_dir), out_dir, client,
               resume_run_id=f"batch-{batch_id:012d}", partial=True, **run_options)


def document_stream(stream: DataFrame, out_dir: str, client: Callable[[dict], str], checkpoint: str,
                    trigger_seconds: int | None = None, **run_options):
    """Start the streaming query (``foreachBatch`` over ``document_batch``); returns the ``StreamingQuery``."""

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        document_batch(batch, batch_id, out_dir, client, **run_options)

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    if trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()
