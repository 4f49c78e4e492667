"""Enrichment (E3) with retry and backoff (E4), answer handling into records.

Model calls are not repeatable and cost money, so:

* only non-reused rows reach this step (the caller filters on the change plan);
* calls wait for the network, not for a core: each task keeps a pool of threads, and all pools together hold at most
  ``max_concurrency`` calls, whatever the number of cores; a task's calls start no faster than its share of ``rate``;
* a per-row failure gives an ``error`` value, never a failed task;
* the run writes the answers table (append) keyed by path, content hash and prompt hash, and a
  rerun anti-joins on it; a finished task's answers stay, so partitions are what is lost or resumed.
"""

from __future__ import annotations

import json
import random
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answer import clean_description, parse_answer
from .state import empty_doc

# Attempts and backoff schedule.
MAX_ATTEMPTS = 5
BACKOFF_BASE_MS = 300
BACKOFF_CAP_MS = 8000
JITTER_MS = 250

ANSWER_SCHEMA = ("project string, path string, content_hash string, prompt_hash string, answer string, "
                 "attempts int, elapsed_ms long, backoff_ms long, error string, asked_at double")


ANSWER_TYPES = {"project": pa.string(), "path": pa.string(), "content_hash": pa.string(), "prompt_hash": pa.string(), "answer": pa.string(),
                "attempts": pa.int32(), "elapsed_ms": pa.int64(), "backoff_ms": pa.int64(), "error": pa.string(), "asked_at": pa.float64()}
UNIT_ROWS = 1_000   # prompts of a partition, which is what a failure loses
OUT_ROWS = 256
IN_ROWS = 64        # prompts that a task holds as Python objects besides those in flight


def backoff_ms(attempt: int) -> int:
    """Base wait before attempt ``attempt + 1`` (without jitter): min(300 * 2^(attempt-1), 8000)."""
    return min(BACKOFF_BASE_MS * (2 ** min(attempt - 1, 16)), BACKOFF_CAP_MS)


def backoff_total_ms(attempts) -> Column:
    """Base waits of a call that took so many attempts, added up: the schedule as an expression."""
    a = F.greatest(F.col(attempts) if isinstance(attempts, str) else attempts, F.lit(1)).cast("int")
    waits = F.transform(F.sequence(F.lit(0), a - 1), lambda k: F.when(k > 0, F.least(F.lit(BACKOFF_BASE_MS) * F.pow(F.lit(2.0), k - 1), F.lit(BACKOFF_CAP_MS)))
                        .otherwise(0.0).cast("long"))
    return F.aggregate(waits, F.lit(0).cast("long"), lambda total, w: total + w)


def call_with_retry(call: Callable[[], str], max_attempts: int = MAX_ATTEMPTS,
                    sleep: Callable[[float], None] = time.sleep,
                    jitter: Callable[[], float] = lambda: random.uniform(0, JITTER_MS)) -> tuple[str, int, int, str | None]:
    """Returns ``(answer, attempts, base_backoff_ms, error)``; the answer is '' after the last failure."""
    waited = 0
    last_err = None
    for attempt in range(1, max_attempts + 1):
        try:
            return call(), attempt, waited, None
        except Exception as e:  # noqa: BLE001 - any client error is retried
            last_err = f"{type(e).__name__}: {e}"
            if attempt == max_attempts:
                break
            base = backoff_ms(attempt)
            waited += base
            sleep((base + jitter()) / 1000.0)
    return "", max_attempts, waited, last_err


class DeterministicClient:
    """Test describer: the answer is a pure function of the prompt fields, so it has an oracle.

    Four answer kinds by ``(length(path) + size) % 4``: a lead-phrase description, a verb-first
    description, text that is not JSON, and alias keys.
    """

    def __call__(self, request: dict) -> str:
        f = request["fields"]
        size = int(f["size"])
        kind = (len(f["path"]) + size) % 4
        joy = size % 10 + 1
        if kind == 0:
            return json.dumps({"fileDescription": f"This file holds {f['filetype']} data of {f['filesize']}",
                               "joyThisFileBrings": joy, "personalityEmoji": "📄"}, ensure_ascii=False, separators=(",", ":"))
        if kind == 1:
            return json.dumps({"fileDescription": f"provides notes for {f['project']}",
                               "joyThisFileBrings": joy, "personalityEmoji": "📝"}, ensure_ascii=False, separators=(",", ":"))
        if kind == 2:
            return f"not json: {f['filetype']}"
        return json.dumps({"fileDescription": f"Stores {f['filetype']} text",
                           "howMuchJoyDoesThisFileBringYou": joy,
                           "emojiThatExpressesThisFilesPersonality": "🗂"}, ensure_ascii=False, separators=(",", ":"))


class FlakyClient:
    """Test describer that fails the first ``size % 7`` calls of a request, then answers. The request itself carries
    its number of calls, so that repeated rows and threads don't share one, and a task holds none of them."""

    def __init__(self, inner: Callable[[dict], str] | None = None):
        self.inner = inner or DeterministicClient()

    def __call__(self, request: dict) -> str:
        request["calls"] = request.get("calls", 0) + 1
        if request["calls"] <= int(request["fields"]["size"]) % 7:
            raise ConnectionError("temporary failure")
        return self.inner(request)


class ChatCompletionsClient:
    """Describer for an OpenAI-compatible chat-completions endpoint (standard library HTTP).

    Sends the system and user messages and the answer contract as a JSON-schema response format.
    """

    def __init__(self, api_base: str, model: str, api_key: str = "", timeout_s: float = 120.0,
                 max_tokens: int = 2048, response_schema: dict | None = None):
        self.api_base, self.model, self.api_key = api_base.rstrip("/"), model, api_key
        self.timeout_s, self.max_tokens = timeout_s, max_tokens
        from .prompt import ANSWER_SCHEMA as _S
        self.schema = response_schema or _S

    def __call__(self, request: dict) -> str:
        import urllib.request

        body = {
            "model": self.model, "max_tokens": self.max_tokens, "stream": False,
            "messages": [{"role": "system", "content": request["system"]},
                         {"role": "user", "content": request["user"]}],
            "response_format": {"type": "json_schema",
                                "json_schema": {"name": "file_doc", "strict": True, "schema": self.schema}},
        }
        req = urllib.request.Request(self.api_base + "/chat/completions", data=json.dumps(body).encode(),
                                     headers={"Content-Type": "application/json",
                                              **({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})})
        with urllib.request.urlopen(req, timeout=self.timeout_s) as r:
            data = json.loads(r.read().decode("utf-8"))
        return data["choices"][0]["message"]["content"] or ""


REQUEST_FIELDS = ["project", "path", "size", "filetype", "filesize", "mimetype"]


class Pace:
    """Lets calls start no faster than ``rate`` a second, over all threads of a task."""

    def __init__(self, rate: float | None, sleep: Callable[[float], None] = time.sleep):
        self.step, self.sleep = (1.0 / rate if rate else 0.0), sleep
        self.lock, self.next = threading.Lock(), 0.0

    def wait(self) -> None:
        if not self.step:
            return
        with self.lock:
            now = time.monotonic()
            start = max(now, self.next)
            self.next = start + self.step
        if start > now:
            self.sleep(start - now)


def share_calls(n_rows: int | None, max_concurrency: int, slots: int, unit_rows: int) -> tuple[int, int]:
    """Partitions and threads per task, so that running tasks hold at most ``max_concurrency`` calls. ``slots``: tasks that run at
    a time. With fewer calls than slots each partition makes one call at a time and there are no more partitions than calls."""
    if max_concurrency < slots:
        return max(1, max_concurrency), 1
    parts = max(slots, -(-n_rows // unit_rows)) if n_rows else slots
    return parts, max_concurrency // slots


def enrich(prompts: DataFrame, client: Callable[[dict], str], max_concurrency: int = 8,
           max_attempts: int = MAX_ATTEMPTS, sleep: Callable[[float], None] = time.sleep,
           passthrough: tuple[str, ...] = (), rate: float | None = None, n_rows: int | None = None,
           unit_rows: int = UNIT_ROWS, slots: int | None = None) -> DataFrame:
    """One call per prompt row; returns the answers rows, in the order in which they come.

    ``prompts`` needs ``project, path, content_hash, prompt_hash, system, user`` and the request
    fields ``size, filetype, filesize, mimetype``; ``passthrough`` columns are copied to the answers. ``rate`` bounds the calls
    that start in a second, over the whole job; ``n_rows``, if known, sets partitions of about ``unit_rows`` prompts;
    ``slots`` is the number of tasks that run at a time where the session's default parallelism doesn't tell. The client
    is called from several threads of a worker."""
    extra = list(passthrough)
    schema = ANSWER_SCHEMA + "".join(f", {c} {prompts.schema[c].dataType.simpleString()}" for c in extra)
    slots = slots or prompts.sparkSession.sparkContext.defaultParallelism
    parts, threads = share_calls(n_rows, max_concurrency, slots, unit_rows)
    task_rate = rate / min(parts, slots) if rate else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace = Pace(task_rate)

        def call(request: dict) -> str:
            pace.wait()
            return client(request)

        def ask(row: dict) -> tuple:
            req = {"system": row["system"], "user": row["user"], "fields": {k: row.get(k) for k in REQUEST_FIELDS}}
            t0, asked_at = time.monotonic(), time.time()
            ans, attempts, waited, err = call_with_retry(lambda: call(req), max_attempts, sleep)
            return (*(row[c] for c in ("project", "path", "content_hash", "prompt_hash")), ans, attempts,
                    int((time.monotonic() - t0) * 1000), waited, err, asked_at, *(row[c] for c in extra))

        def packed(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], list(types))

        def rows(b: pa.RecordBatch) -> Iterator[dict]:
            for at in range(0, b.num_rows, IN_ROWS):
                yield from b.slice(at, IN_ROWS).to_pylist()

        types = dict(ANSWER_TYPES)
        with ThreadPoolExecutor(threads) as pool:
            pending, out = set(), []
            for b in batches:
                types |= {c: b.schema.field(c).type for c in extra}
                for row in rows(b):
                    pending.add(pool.submit(ask, row))
                    while len(pending) >= 2 * threads:
                        done, pending = wait(pending, return_when=FIRST_COMPLETED)
                        out += [f.result() for f in done]
                    if len(out) >= OUT_ROWS:
                        yield packed(out)
                        out = []
            out += [f.result() for f in pending]
            if out:
                yield packed(out)

    cols = ["project", "path", "content_hash", "prompt_hash", "system", "user", "size", "filetype", "filesize", "mimetype"]
    # by hash, so that a lost task meets the same prompts again
    return prompts.select(*cols, *extra).repartition(parts, F.xxhash64("project", "path")).mapInArrow(run, schema)


def finalize_records(answers: DataFrame, run_ts) -> DataFrame:
    """State records for enriched rows: parsed, cleaned doc or the empty doc; the timestamp is the
    run's (taken before the calls)."""
    parsed = parse_answer(F.col("answer"))
    doc = F.when(parsed.isNull(), empty_doc()).otherwise(F.struct(
        clean_description(parsed["description"]).alias("description"), parsed["joy"].alias("joy"),
        parsed["emoji"].alias("emoji")))
    return answers.select("project", "path", F.element_at(F.split("path", "/"), -1).alias("name"), "content_hash",
                          F.lit("sha256").alias("hash_algo"), F.lit(run_ts).cast("timestamp").alias("updated_at"),
                          doc.alias("doc"))
