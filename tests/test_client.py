"""The chat-completions describer, with the HTTP call replaced by a fake (no endpoint is opened)."""
import io
import json
import urllib.request

from docweave.operators.enrich import ChatCompletionsClient, call_with_retry


class FakeResponse(io.BytesIO):
    def __enter__(self):
        return self

    def __exit__(self, *a):
        return False


def test_request_shape_and_answer(monkeypatch):
    seen = {}

    def fake_urlopen(req, timeout):
        seen["url"], seen["timeout"] = req.full_url, timeout
        seen["headers"] = dict(req.header_items())
        seen["body"] = json.loads(req.data.decode())
        answer = {"fileDescription": "Holds notes", "joyThisFileBrings": 5, "personalityEmoji": "x"}
        return FakeResponse(json.dumps({"choices": [{"message": {"content": json.dumps(answer)}}]}).encode())

    monkeypatch.setattr(urllib.request, "urlopen", fake_urlopen)
    c = ChatCompletionsClient("http://model.invalid/v1/", "m1", api_key="k", timeout_s=7)
    out = c({"system": "S", "user": "U", "fields": {}})
    assert json.loads(out)["joyThisFileBrings"] == 5
    assert seen["url"] == "http://model.invalid/v1/chat/completions" and seen["timeout"] == 7
    assert seen["headers"]["Authorization"] == "Bearer k"
    body = seen["body"]
    assert [m["role"] for m in body["messages"]] == ["system", "user"] and body["model"] == "m1"
    assert body["response_format"]["json_schema"]["schema"]["required"] == \
        ["fileDescription", "joyThisFileBrings", "personalityEmoji"]


def test_transport_errors_are_retried(monkeypatch):
    calls = []

    def failing(req, timeout):
        calls.append(1)
        raise OSError("connection refused")

    monkeypatch.setattr(urllib.request, "urlopen", failing)
    c = ChatCompletionsClient("http://model.invalid/v1", "m1")
    ans, attempts, waited, err = call_with_retry(lambda: c({"system": "", "user": "", "fields": {}}), sleep=lambda s: None)
    assert (ans, attempts, len(calls)) == ("", 5, 5) and "connection refused" in err


def test_retry_schedule_over_a_failing_endpoint(spark):
    """The fake client fails size % 7 times: attempts, waits and the error follow the schedule."""
    from docweave.operators import enrich as EN

    class FlakyClient:
        """Fails the first ``size % 7`` calls for a file, then answers."""

        def __init__(self):
            self.calls = {}

        def __call__(self, request):
            f = request["fields"]
            n = self.calls[f["path"]] = self.calls.get(f["path"], 0) + 1
            if n <= int(f["size"]) % 7:
                raise ConnectionError("temporary failure")
            return EN.DeterministicClient()(request)

    rows = [("p", f"f{i}", "h", "q", "s", "u", i, "txt", "1 B", "text/plain") for i in range(14)]
    prompts = spark.createDataFrame(rows, "project string, path string, content_hash string, prompt_hash string, system string, user string, "
                                          "size long, filetype string, filesize string, mimetype string")
    for r in EN.enrich(prompts, FlakyClient(), max_concurrency=2, sleep=lambda s: None).collect():
        fails = int(r["path"][1:]) % 7
        assert r["attempts"] == min(fails + 1, EN.MAX_ATTEMPTS)
        assert r["backoff_ms"] == sum(min(300 * 2 ** a, 8000) for a in range(r["attempts"] - 1))
        assert (r["error"] is not None) == (fails >= EN.MAX_ATTEMPTS) == (r["answer"] == "")


def _prompts(spark, n):
    from pyspark.sql import functions as F
    return spark.range(n).select(F.lit("p").alias("project"), F.concat(F.lit("f"), "id").alias("path"), F.lit("h").alias("content_hash"),
                                 F.lit("q").alias("prompt_hash"), F.lit("s").alias("system"), F.lit("u").alias("user"), F.col("id").alias("size"),
                                 F.lit("txt").alias("filetype"), F.lit("1 B").alias("filesize"), F.lit("text/plain").alias("mimetype"))


def _noting(folder, pause):
    """A client that notes when each call begins and ends."""
    def client(request):
        import time
        import uuid
        began = time.time()
        time.sleep(pause)
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as fh:
            fh.write(f"{began} {time.time()}")
        return "{}"

    return client


def _times(folder):
    return sorted(tuple(map(float, p.read_text().split())) for p in folder.iterdir())


def test_calls_are_bounded_not_by_cores(spark, tmp_path):
    """64 calls at a time on 4 task slots, and never more."""
    from docweave.operators import enrich as EN
    slots = spark.sparkContext.defaultParallelism
    got = EN.enrich(_prompts(spark, 640), _noting(str(tmp_path), 0.5), max_concurrency=8 * slots, slots=slots).collect()
    times = _times(tmp_path)
    most = max(sum(a <= t < b for a, b in times) for t, _ in times)
    assert len({r["path"] for r in got}) == 640 and 4 * slots < most <= 8 * slots
    assert EN.share_calls(10**6, 64, 4, 1000) == (1000, 16) and EN.share_calls(10**6, 8, 4000, 1000) == (8, 1)


def test_the_rate_is_never_passed(spark, tmp_path):
    from docweave.operators import enrich as EN
    slots = spark.sparkContext.defaultParallelism
    EN.enrich(_prompts(spark, 160), _noting(str(tmp_path), 0.0), max_concurrency=4 * slots, rate=40.0).collect()
    starts = [a for a, _ in _times(tmp_path)]
    assert len(starts) == 160 and all(sum(t <= x < t + 1 for x in starts) <= 40 + slots for t in starts)


def test_the_schedule_as_an_expression(spark):
    from docweave.operators import enrich as EN
    got = spark.range(0, 9).select("id", EN.backoff_total_ms("id").alias("w")).collect()
    assert [r["w"] for r in got] == [sum(EN.backoff_ms(a) for a in range(1, max(1, r["id"]))) for r in got]


def test_retry_backoff_asks_for_every_prompt(spark, tmp_path):
    """Every dirty file is rendered and asked for again until its client answers or gives up."""
    import __spark_entry__ as entry
    from docweave.operators import enrich as EN
    ids = range(1, 81)
    spark.createDataFrame([(i, "web", "en", "w" * i) for i in ids], "doc_id long, source string, lang string, text string") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["retry_backoff"](spark, str(tmp_path)).collect()
    dirty = [i for i in ids if i % 5 == 0 or i % 7 == 0 or i % 11 == 0]
    attempts = [min(i % 7 + 1, EN.MAX_ATTEMPTS) for i in dirty]
    waits = [sum(EN.backoff_ms(a) for a in range(1, n)) for n in attempts]
    assert sorted((r["attempts"], r["backoff_ms"]) for r in got) == sorted(zip(attempts, waits))
    failed = [r for r in got if r["error"]]
    assert len(failed) == sum(i % 7 >= EN.MAX_ATTEMPTS for i in dirty) and all(r["answer"] == "" for r in failed)
    assert all(r["answer"] for r in got if not r["error"])


def test_repeated_rows_fail_as_often_each(spark):
    """Two equal requests don't share a count of calls."""
    from docweave.operators import enrich as EN
    row = ("p", "f", "h", "q", "s", "u", 3, "txt", "1 B", "text/plain")
    prompts = spark.createDataFrame([row, row], "project string, path string, content_hash string, prompt_hash string, system string, "
                                                "user string, size long, filetype string, filesize string, mimetype string")
    assert [r["attempts"] for r in EN.enrich(prompts, EN.FlakyClient(), sleep=lambda s: None).collect()] == [4, 4]


def test_a_task_holds_few_prompts_at_a_time(spark):
    """The objects of a worker don't grow with the rows of an Arrow batch."""
    from pyspark.sql import functions as F
    from docweave.operators import enrich as EN

    def client(request):
        import sys
        return str(sys.getallocatedblocks())

    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    try:
        most = []
        for n in (100, 20_000):
            prompts = _prompts(spark, n).withColumn("system", F.concat(F.lit("system "), "path")).withColumn("user", F.concat(F.lit("user "), "path"))
            most.append(max(int(r["answer"]) for r in EN.enrich(prompts, client, max_concurrency=1, slots=2).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    assert most[1] - most[0] < 20_000, most
