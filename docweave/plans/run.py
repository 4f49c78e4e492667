"""The whole documentation run as Spark jobs.

    one scan -> narrow inventory: hashes, and text of ignore files, state files and READMEs only
                                                                             [written table]
      -> filters, context, change plan: narrow key join with the previous state  [written tables]
      -> dirty rows only: fingerprint + three chunks + project context -> prompts
      -> enrichment, bounded concurrency, resumable                          [answers table, append]
      -> parse + clean -> records -> the state's next generation: changed records and dropped keys only
                                                                             [bucketed state table]
      -> run summary

Every cut point is a table written under the output folder (shared storage), so a lost executor
costs a recomputation of one stage, and model answers are never asked twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as TX
from ..operators import chunking as CH
from ..operators import content as CO
from ..operators import enrich as EN
from ..operators import inventory as INV
from ..operators import metrics as M
from ..operators import prompt as PR
from ..operators import state as ST
from ..sources.corpus import fingerprint
from ..sources import state_table as TB
from ..sources.state_io import nested_trees_from_inventory, read_state_trees, rejected_records

KEY = ["project", "path"]
METRIC_COLUMNS = [*KEY, "filesize", "filetype", "mimetype", "splitter_used", "chunk1_bytes", "chunk2_bytes", "chunk3_bytes"]
ANSWER_KEY = ["project", "path", "content_hash", "prompt_hash"]
BROADCAST_BYTES = 64 << 20   # key or context tables of at most this much text are broadcast
MAX_WAVES = 64               # enrichment steps of a run, whatever its size


def scan_inventory(corpus: DataFrame) -> DataFrame:
    """The corpus without its text, but for READMEs at a root, ignore files and state files (``head``)."""
    name = P.path_name("path")
    small = (F.col("path").isin(*CO.README_NAMES) | name.isin(*INV.IGNORE_FILE_LEVELS) | F.col("path").endswith(INV.EXCLUDE_FILE)
             | F.lower(name).isin(*[n.lower() for n in ST.ALL_STATE_NAMES]))
    return corpus.withColumn("head", F.when(small, F.col("head")))


def filter_inventory(corpus: DataFrame, show_hidden: bool = False, ignore_dirs: list[str] | None = None,
                     rules: DataFrame | str | None = None, extra_rules: DataFrame | None = None) -> DataFrame:
    """J1 filters: hidden entries, pruned directory names, ignore rules.

    ``rules="inventory"`` takes the rules from the ignore files in the corpus itself (directory
    scans); a DataFrame of rules (e.g. user-global ones, project null) is applied as given.
    ``extra_rules`` are added to the inventory's own (user-global rules, ignore files above the root).
    """
    if isinstance(rules, str):
        if rules != "inventory":
            raise ValueError("rules must be a DataFrame, None or 'inventory'")
        rules = INV.rules_from_inventory(corpus).select("project", "rule_dir", "level", "seq", "regex", "negated",
                                                        "dir_only")
        if extra_rules is not None:
            rules = rules.unionByName(extra_rules.select(*rules.columns))
    inv = INV.prune_dirs(corpus, list(ignore_dirs or []))
    if rules is None:
        return INV.drop_hidden(inv, show_all=show_hidden)
    # with rules, an explicit re-include also lifts the hidden filter (as the walker does)
    return INV.apply_ignore_rules(inv, rules, hidden=not show_hidden)


def text_bytes(df: DataFrame) -> int:
    """Bytes of text in a (written) table: what a broadcast of it would hold."""
    return df.agg(F.sum(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 8 for c in df.columns), F.lit(0)))).first()[0] or 0


def prompt_inputs_for_dirty(corpus: DataFrame, plan: DataFrame, context: DataFrame, chunk_mode: str = "packed",
                            n_words: int = CH.DEFAULT_WINDOW_WORDS, max_tokens: int = CH.DEFAULT_MAX_TOKENS,
                            sizer: Callable[[str], int] = CH.approx_tokens, text_rule: str = "bytes") -> DataFrame:
    """Prompt inputs of new/changed/forced files (``plan`` and ``context`` are written tables).

    While the dirty keys' measured bytes allow it they are broadcast and filter the scan map-side; beyond
    that every row is chunked map-side and only the small chunk rows are joined with the keys. In neither
    way does file content cross a shuffle.
    """
    dirty = plan.where(F.col("action") != "reuse").select(*KEY)
    if text_bytes(dirty) <= BROADCAST_BYTES:
        content = corpus.join(F.broadcast(dirty), KEY, "left_semi")
        return prompt_inputs(content, context, chunk_mode, n_words, max_tokens, sizer, text_rule)
    inputs = prompt_inputs(corpus, context, chunk_mode, n_words, max_tokens, sizer, text_rule)
    return inputs.join(dirty, KEY, "left_semi")


def prompt_inputs(content: DataFrame, context: DataFrame, chunk_mode: str = "packed",
                  n_words: int = CH.DEFAULT_WINDOW_WORDS, max_tokens: int = CH.DEFAULT_MAX_TOKENS,
                  sizer: Callable[[str], int] = CH.approx_tokens, text_rule: str = "bytes") -> DataFrame:
    """Fingerprint and chunk triple in one projection over the content (no join), then the README
    context by project."""
    fp = fingerprint(content, keep_head=True, text_rule=text_rule)
    text = CH.decode_lossy("head")
    fp = fp.withColumn("chunks", CH.chunk_triple(text, F.col("is_text"), F.col("splitter"), mode=chunk_mode,
                                                 n_words=n_words, max_tokens=max_tokens, sizer=sizer)).drop("head")
    # the README field is prepared once per project, not once per file
    context = context.withColumn("project_documentation",
                                 TX.indent_lines(TX.sanitize_yaml_text(F.col("snippet")), 2))
    ctx = F.broadcast(context) if text_bytes(context) <= BROADCAST_BYTES else context
    j = fp.join(ctx, "project", "left")
    return j.withColumn("documented", F.coalesce("documented", F.lit("false"))) \
        .withColumn("snippet", F.coalesce("snippet", F.lit(""))) \
        .withColumn("project_documentation", F.coalesce("project_documentation", F.lit("")))


@dataclass
class RunResult:
    run_id: str
    plan: DataFrame
    answers: DataFrame
    state: DataFrame
    summary: DataFrame
    state_path: str
    file_metrics: DataFrame | None = None


def build_prompts(inputs: DataFrame, template: dict | None = None, escape_html: bool = True,
                  root_prefix: str = "/", operating_system: str = "linux") -> DataFrame:
    """Prompt fields + rendered messages + request fields, all in one projection chain (no join)."""
    t = template or PR.DEFAULT_TEMPLATE
    with_fields = PR.prompt_fields(inputs, root_prefix, operating_system)
    avail = PR.FIELDS + PR.EXTRA_FIELDS
    system = PR.render(PR.compile_template(t.get("system", "")), avail, escape_html)
    user = F.concat(PR.render(PR.compile_template(t.get("user_before", "")), avail, escape_html),
                    PR.render(PR.compile_template(t.get("user_after", "")), avail, escape_html))
    lengths = [F.octet_length(F.col("chunks")[c]).cast("long").alias(f"chunk{i}_bytes") for i, c in enumerate(("first", "mid", "last"), 1)]
    out = with_fields.select(*KEY, "content_hash", "size", "filetype", "filesize", "mimetype",
                             F.col("chunks")["used"].alias("splitter_used"), *lengths, system.alias("system"), user.alias("user"))
    return out.withColumn("prompt_hash", F.sha2(F.concat_ws("\n", "system", "user"), 256))


def _n_waves(n_rows: int, wave_rows: int, max_concurrency: int, slots: int) -> int:
    """One job, unless fewer calls are allowed than tasks run at a time: its few partitions then hold ``wave_rows`` prompts in all."""
    return 1 if max_concurrency >= slots else min(MAX_WAVES, max(1, -(-int(n_rows) // max(1, wave_rows))))


def _write_prompts(prompts: DataFrame, n_waves: int, path: str) -> None:
    """Prompts in one folder per wave (``wave=<w>``), so a wave reads exactly its folder. A single wave is written as it comes."""
    p = prompts.withColumn("waves", F.lit(n_waves)) \
        .withColumn("wave", F.pmod(F.xxhash64("project", "path"), F.lit(n_waves)).cast("int"))
    if n_waves > 1:
        spark = prompts.sparkSession
        per_wave = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // n_waves))
        sub = F.pmod(F.xxhash64("path", "project", F.lit("sub")), F.lit(per_wave))
        p = p.withColumn("_sub", sub).repartition(n_waves * per_wave, "wave", "_sub").drop("_sub")
    p.write.mode("overwrite").partitionBy("wave").parquet(path)


def _read_wave(spark: SparkSession, path: str, w: int) -> DataFrame | None:
    d = f"{path}/wave={w}"
    return spark.read.option("basePath", path).parquet(d) if _exists(spark, d) else None


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def run(spark: SparkSession, corpus: DataFrame, state: DataFrame | None, out_dir: str,
        client: Callable[[dict], str], *, force: bool = False, ignore_dirs: list[str] | None = None,
        rules: DataFrame | str | None = None, extra_rules: DataFrame | None = None, show_hidden: bool = False,
        nested: DataFrame | str | None = None,
        chunk_mode: str = "packed", n_words: int = CH.DEFAULT_WINDOW_WORDS,
        max_tokens: int = CH.DEFAULT_MAX_TOKENS, sizer: Callable[[str], int] = CH.approx_tokens,
        context_words: int = TX.CONTEXT_WORDS, run_ts: str | None = None, max_concurrency: int = 8,
        template: dict | None = None, escape_html: bool = True, keep_previous_on_error: bool = False,
        operating_system: str = "linux", root_prefix: str = "/", sleep=None,
        resume_run_id: str | None = None, partial: bool = False, text_rule: str = "bytes",
        wave_rows: int = 50_000, unit_rows: int = EN.UNIT_ROWS, rate: float | None = None, slots: int | None = None,
        timings: dict | None = None) -> RunResult:
    """One incremental documentation run; returns the written plan, answers, state and summary.

    ``resume_run_id`` re-enters an interrupted run: its answers without error are kept and only
    the remaining prompts are sent. A new run asks again for every new or changed file.
    ``partial``: the corpus holds only some keys (a stream batch); records of other keys are kept
    instead of being dropped as stale. ``max_concurrency`` calls are made at a time and ``rate`` begin in a second at most, in one
    job whose partitions of ``unit_rows`` prompts are kept as they end. Only where fewer calls are allowed than tasks
    run at a time (``slots``), the job has as many partitions as calls, and a wave of ``wave_rows`` prompts is what is kept.
    """
    import time as _time

    run_id = resume_run_id or uuid.uuid4().hex[:12]
    clock = [_time.time()]

    def lap(name: str) -> None:
        if timings is not None:
            now = _time.time()
            timings[name] = round(timings.get(name, 0.0) + now - clock[0], 3)
            clock[0] = now
    run_ts = run_ts or _time.strftime("%Y-%m-%d %H:%M:%S", _time.gmtime())
    base = out_dir.rstrip("/")

    # The one pass over all content; text is kept only of the small files that later steps read
    scan_path = f"{base}/runs/{run_id}/scan"
    scan_inventory(corpus).write.mode("overwrite").parquet(scan_path)
    scan = spark.read.parquet(scan_path)
    unreadable = rejected = None
    if "error" in scan.columns:
        unreadable = scan.where(F.col("error").isNotNull())
        scan = scan.where(F.col("error").isNull())
    inv = filter_inventory(scan, show_hidden, ignore_dirs, rules, extra_rules)
    if state is None:
        state = spark.createDataFrame([], "project string, path string, name string, content_hash string, "
                                          "hash_algo string, updated_at timestamp, doc " + ST.DOC_SCHEMA)
    if isinstance(nested, str):
        if nested != "inventory":
            raise ValueError("nested must be a DataFrame, None or 'inventory'")
        trees = nested_trees_from_inventory(scan)
        nested, rejected = read_state_trees(trees), rejected_records(trees)
    prev = ST.merge_states(state, nested) if nested is not None else state
    lap("scan")

    # Change plan (narrow), written; everything below follows from it
    plan_path = f"{base}/runs/{run_id}/plan"
    prompts_path = f"{base}/runs/{run_id}/prompts"
    ST.plan_changes(inv, prev, force).write.mode("overwrite").parquet(plan_path)
    plan = spark.read.parquet(plan_path)
    lap("plan")

    # Project context (one row per project), written
    ctx_path = f"{base}/runs/{run_id}/context"
    readmes = scan.join(plan.where(F.col("path").isin(*CO.README_NAMES)).select(*KEY), KEY, "left_semi")
    CO.project_context(readmes, plan.select("project"), context_words).write.mode("overwrite").parquet(ctx_path)
    context = spark.read.parquet(ctx_path)
    lap("context")

    # J4 + J6: prompts, with a second read of content for dirty rows only
    n_dirty = plan.where(F.col("action") != "reuse").count()
    n_waves = _n_waves(n_dirty, wave_rows, max_concurrency, slots or spark.sparkContext.defaultParallelism)
    inputs = prompt_inputs_for_dirty(corpus, plan, context, chunk_mode, n_words, max_tokens, sizer, text_rule)
    built = build_prompts(inputs, template, escape_html, root_prefix, operating_system)
    _write_prompts(built, n_waves, prompts_path)
    # with its schema: an unchanged corpus has no prompt, and so no file to take one from
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in built.schema)
    prompts = spark.read.schema(f"{kinds}, waves int, wave int").parquet(prompts_path)
    lap("prompts")

    # Enrichment with resume (answers appended; earlier answers for the same key are reused)
    answers_path = f"{base}/answers/run_id={run_id}"
    kw = {} if sleep is None else {"sleep": sleep}
    for w in range(n_waves):
        # each wave reads only its own prompt folder and, on resume, only its own earlier answers;
        # each wave is one committed append into its own answers folder
        todo = _read_wave(spark, prompts_path, w)
        if todo is None:
            continue
        done = _read_wave(spark, answers_path, w)
        if done is not None:
            done = done.where((F.col("waves") == n_waves) & F.col("error").isNull()).select(*ANSWER_KEY)
            todo = todo.join(done, ANSWER_KEY, "left_anti")
        # the answers of a finished task are in place as soon as it commits, not only when the wave ends
        EN.enrich(todo, client, max_concurrency, passthrough=("waves",), rate=rate, n_rows=-(-n_dirty // n_waves), unit_rows=unit_rows,
                  slots=slots, **kw).write.mode("append") \
            .option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{answers_path}/wave={w}")
    if not _exists(spark, answers_path):
        spark.createDataFrame([], EN.ANSWER_SCHEMA + ", waves int, wave int").write.mode("append") \
            .partitionBy("wave").parquet(answers_path)
    lap("enrich")
    all_answers = spark.read.schema(EN.ANSWER_SCHEMA + ", waves int, wave int").parquet(answers_path)
    # an answer without error beats a failed one; among equals the later call wins
    latest = all_answers.groupBy(*ANSWER_KEY).agg(F.max_by(
        F.struct("answer", "attempts", "elapsed_ms", "error", "asked_at"),
        F.struct(F.col("error").isNull(), F.col("asked_at"))).alias("a"))
    answers = prompts.select(*ANSWER_KEY).join(latest, ANSWER_KEY, "inner").select(*ANSWER_KEY, "a.*")

    # J8 + J9: records for enriched rows, carried-forward rows, new state
    records = EN.finalize_records(answers, F.lit(run_ts))
    if keep_previous_on_error:
        prev_docs = prev.select(*KEY, F.col("doc").alias("prev_doc"))
        records = records.join(prev_docs, KEY, "left").withColumn(
            "doc", F.when((F.col("doc.description") == "") & F.col("prev_doc").isNotNull(), F.col("prev_doc"))
            .otherwise(F.col("doc"))).drop("prev_doc")
    reused = ST.carry_forward(plan, prev)
    version = getattr(state, "state_version", None)
    version = version if isinstance(version, TB.Version) else None
    if version is not None and version.out_dir == base and not version.full:
        # the state that is being replaced stands in this folder: only what differs from it is written
        changed = ST.as_state(records)
        if nested is not None:  # reused records that came with a nested state are new to this one
            changed = changed.unionByName(reused.join(ST.rebase_state(nested).select(*KEY).distinct(), KEY, "left_semi"))
        kept = plan.where(F.col("action") == "reuse").select(*KEY).unionByName(records.select(*KEY))
        gone = state.select(*KEY).where(F.lit(False)) if partial else state.select(*KEY).join(kept, KEY, "left_anti")
        written = TB.write_changes(spark, version, changed, gone, run_id)
    else:
        new_state = ST.replace_state(reused, records)
        if partial:
            new_state = ST.as_state(prev).join(plan.select(*KEY), KEY, "left_anti").unionByName(new_state)
        written = TB.write_base(spark, new_state, base, run_id, plan.count() + (prev.count() if partial else 0))
    TB.publish(spark, written, run_id)
    state_out = TB.read_version(spark, written)
    TB.drop_other_tables(spark, [written] if version is None else [written, version])
    lap("state")

    # summary
    stale = ST.stale_keys(prev, plan) if not partial else prev.select(*KEY).where(F.lit(False))
    summary = M.run_summary(plan, prev, stale, nested=nested if isinstance(nested, DataFrame) else None,
                            new_state=state_out, unreadable=unreadable, rejected=rejected)
    metrics = prompts.select(*METRIC_COLUMNS).join(answers.select(*KEY, "elapsed_ms", "attempts"), KEY, "left")
    return RunResult(run_id, plan, answers, state_out, summary, written.location, metrics)


def read_current_state(spark: SparkSession, out_dir: str) -> DataFrame | None:
    """The state written by the latest completed run (newest complete pointer), or None."""
    version = TB.current_version(spark, out_dir)
    return None if version is None else TB.read_version(spark, version)
