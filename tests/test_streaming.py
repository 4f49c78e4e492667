import os
import tempfile

from pyspark.sql import functions as F

from docweave.operators.enrich import DeterministicClient
from docweave.plans import fixtures as FX
from docweave.plans.run import read_current_state
from docweave.streaming.incremental import document_stream

from locations import SF_SMALL


def test_stream_batches_merge_into_state(spark):
    base = tempfile.mkdtemp(prefix="dw-stream-")
    incoming, out = os.path.join(base, "in"), os.path.join(base, "out")
    cv = FX.corpus_v(spark, SF_SMALL).where(~F.col("path").startswith("."))
    rows = cv.select("project", "path", "content", F.current_timestamp().alias("mtime"))
    first = rows.where(F.col("doc_id") % 2 == 0)
    second = rows.where(F.col("doc_id") % 2 == 1)
    first.write.parquet(os.path.join(incoming, "b1"))
    stream = spark.readStream.schema("project string, path string, content string, mtime timestamp") \
        .option("recursiveFileLookup", "true").parquet(incoming)
    q = document_stream(stream, out, DeterministicClient(), checkpoint=os.path.join(base, "ckpt"), chunk_mode="window")
    q.processAllAvailable()
    n1 = read_current_state(spark, out).count()
    second.write.parquet(os.path.join(incoming, "b2"))
    q.processAllAvailable()
    q.stop()
    st = read_current_state(spark, out)
    assert n1 == first.count()
    assert st.count() == rows.count()                       # the second batch is merged, the first kept
    assert st.select("project", "path").distinct().count() == rows.count()


def test_replayed_batch_asks_nothing_again(spark):
    from docweave.streaming.incremental import document_batch
    base = tempfile.mkdtemp(prefix="dw-replay-")
    out = os.path.join(base, "out")
    rows = FX.corpus_v(spark, SF_SMALL).where(~F.col("path").startswith(".")) \
        .select("project", "path", "content", F.current_timestamp().alias("mtime"))
    calls = []

    class Spy(DeterministicClient):
        def __call__(self, request):
            calls.append(1)
            return super().__call__(request)

    document_batch(rows, 7, out, Spy(), chunk_mode="window")
    first = len(calls)
    # the driver (unlike the Python workers) never sees the calls, so count the answers instead
    answers = spark.read.parquet(os.path.join(out, "answers", "run_id=batch-000000000007")).count()
    document_batch(rows, 7, out, Spy(), chunk_mode="window")        # replay after a failure
    again = spark.read.parquet(os.path.join(out, "answers", "run_id=batch-000000000007")).count()
    assert first == 0 and answers > 0
    assert again == answers        # no new answers: every prompt of the batch was already answered
