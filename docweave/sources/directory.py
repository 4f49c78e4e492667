"""Directory scan (S1): folders listed in rounds by tasks, files packed by bytes into read partitions.

Spark's ``binaryFile`` source skips names starting with ``_`` or ``.`` and empty files, so the inventory lists and reads
files itself. The tasks open files, so the folder must be mounted on every worker; the driver opens none.

1. The frontier is a table of directories. A task lists its directories, deepest first, until it has seen
   ``entries_per_task`` entries; what it has not opened yet is the next round's frontier, spread over all tasks anew. Every
   round is written, so a lost executor costs one round. Symbolic links are not followed.
2. Files larger than ``split_bytes`` are hashed in ranges of that size, each range by a task of its own choice of partition:
   their ``content_hash`` is the SHA-256 of the ranges' digests in order, named ``sha256-tree-<split_bytes>``. All other
   files have the SHA-256 of their bytes. A file of any size has a hash.
3. Files are dealt to partitions by the running sum of their bytes (plus a fixed cost per file), so a flat directory of many files, a
   deep chain and a few large files all fill the partitions evenly.

``head`` is the whole content, or its first ``head_bytes`` bytes where that is given; state files (``whole_names``) are kept whole. No
head is longer than ``max_head`` (a cell and its copies must fit a task's memory): ``head_cut`` tells where bytes are left out.
A file that can't be read and a directory that can't be listed give a row with ``error``, never a failure. Batches that
leave a task hold about ``BATCH_BYTES`` of content.
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .packing import deal_by_weight

BLOCK = 1 << 20
BATCH_BYTES = 32 << 20
SPLIT_BYTES = 512 << 20
MAX_HEAD = 512 << 20
PART_BYTES = 128 << 20
FILE_COST = 64 << 10         # opening a file weighs as much as reading so many bytes
ENTRIES_PER_TASK = 20_000
SCHEMA = ("project string, path string, size long, mtime timestamp, head binary, content_hash string, "
          "hash_algo string, error string, head_cut boolean")
ENTRY_SCHEMA = "kind string, project string, root string, raw binary, size long, mtime_us long, error string"
ENTRY_TYPES = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.string()]
ENTRY_NAMES = [c.split()[0] for c in ENTRY_SCHEMA.split(", ")]
ROW_TYPES = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.binary(), pa.string(), pa.string(), pa.string(), pa.bool_()]
ROW_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _batch(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _said(e: OSError) -> str:
    return f"{type(e).__name__}: {e.strerror}"


def _mtime(st: os.stat_result) -> int:
    return round(st.st_mtime * 1_000_000)


def _full(root: str, raw: bytes) -> bytes:
    return os.path.join(os.fsencode(root), raw) if raw else os.fsencode(root)


# ------------------------------------------------------------------ listing

def _lister(prune: frozenset, entries_per_task: int):
    """Directories in; files, errors and directories not opened yet out."""
    skip = frozenset(os.fsencode(n) for n in prune)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo = [tuple(r[c] for c in ("project", "root", "raw")) for b in batches for r in b.to_pylist()]
        seen, out = 0, []
        while todo and seen < entries_per_task:
            project, root, raw = todo.pop()
            try:
                entries = list(os.scandir(_full(root, raw)))
            except OSError as e:
                out.append(("error", project, root, raw, None, None, _said(e)))
                continue
            seen += len(entries) + 1
            for e in entries:
                name = raw + b"/" + e.name if raw else e.name
                try:
                    st = e.stat(follow_symlinks=False)
                except OSError as err:
                    out.append(("error", project, root, name, None, None, _said(err)))
                    continue
                if stat.S_ISDIR(st.st_mode):
                    if e.name not in skip:
                        todo.append((project, root, name))
                elif stat.S_ISREG(st.st_mode):
                    out.append(("file", project, root, name, st.st_size, _mtime(st), None))
            if len(out) >= 10_000:
                yield _batch(out, ENTRY_TYPES, ENTRY_NAMES)
                out = []
        out += [("dir", project, root, raw, None, None, None) for project, root, raw in todo]
        yield _batch(out, ENTRY_TYPES, ENTRY_NAMES)

    return run


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every directory directly below each parent is a project."""
    for b in batches:
        for r in b.to_pylist():
            found = [os.fsdecode(e.name) for e in os.scandir(r["root"]) if e.is_dir(follow_symlinks=False)]
            yield _batch([("dir", n, os.path.join(r["root"], n), b"", None, None, None) for n in found], ENTRY_TYPES, ENTRY_NAMES)


def list_files(spark: SparkSession, roots: DataFrame, prune: list[str] | None = None,
               entries_per_task: int = ENTRIES_PER_TASK) -> DataFrame:
    """``kind`` (file or error), ``project, root, raw, size, mtime_us, error`` of everything below ``roots`` (``project, root, raw``
    directories), from as many rounds as the frontier needs."""
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lister = _lister(frozenset(prune or []), entries_per_task)
    found, frontier = None, roots.select("project", "root", "raw")
    while True:
        # dealt in order of the path's hash: a lost task lists the same directories again
        spread = frontier.repartition(n, F.xxhash64("project", "root", "raw"))
        listed = materialize(spread.mapInArrow(lister, ENTRY_SCHEMA), "scan-round")
        entries = listed.where(F.col("kind") != "dir")
        found = entries if found is None else found.unionByName(entries)
        frontier = listed.where(F.col("kind") == "dir").select("project", "root", "raw")
        if not frontier.take(1):
            return found


# ------------------------------------------------------------------ reading

def _range_digests(split_bytes: int):
    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                h, left, error = hashlib.sha256(), min(split_bytes, r["size"] - r["start"]), None
                try:
                    with open(_full(r["root"], r["raw"]), "rb") as fh:
                        fh.seek(r["start"])
                        while left and (block := fh.read(min(BLOCK, left))):
                            h.update(block)
                            left -= len(block)
                    if left:
                        error = "OSError: shorter than listed"
                except OSError as e:
                    error = _said(e)
                out.append((r["project"], r["root"], r["raw"], r["start"], h.digest(), error))
            yield _batch(out, [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.binary(), pa.string()],
                         ["project", "root", "raw", "start", "digest", "failed"])

    return run


def tree_digests(large: DataFrame, split_bytes: int) -> DataFrame:
    """``project, root, raw, digest, failed`` of large files, hashed in ranges by many tasks; only digests are shuffled."""
    spark = large.sparkSession
    ranges = large.select("project", "root", "raw", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(split_bytes))).alias("start"))
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    each = ranges.repartition(n, "project", "root", "raw", "start").mapInArrow(
        _range_digests(split_bytes), "project string, root string, raw binary, start long, digest binary, failed string")
    parts = F.array_sort(F.collect_list(F.struct("start", "digest")))  # 32 bytes for every split_bytes of the file
    joined = F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, p["digest"]))
    return each.groupBy("project", "root", "raw").agg(F.sha2(joined, 256).alias("digest"), F.max("failed").alias("failed"))


def _reader(with_content: bool, head_bytes: int | None, whole: frozenset, max_head: int, split_bytes: int):
    algo = f"sha256-tree-{split_bytes}"

    def row(r) -> tuple:
        raw = r["raw"]
        path = raw.decode("utf-8", "replace").replace(os.sep, "/")
        if r["error"] is not None or r["failed"] is not None:
            return (r["project"], path, r["size"], r["mtime_us"], None, None, None, r["error"] or r["failed"], None)
        limit = head_bytes
        if limit is None or os.path.basename(path).lower() in whole:
            limit = max_head
        limit = min(limit, max_head) if with_content else 0
        h, head, size = hashlib.sha256(), bytearray(), 0
        try:
            with open(_full(r["root"], raw), "rb") as fh:
                while block := fh.read(BLOCK):
                    size += len(block)
                    if len(head) < limit:
                        head += block[:limit - len(head)]
                    if r["digest"] is None:
                        h.update(block)
                    elif len(head) >= limit:
                        break  # hashed in ranges already
        except OSError as e:
            return (r["project"], path, r["size"], r["mtime_us"], None, None, None, _said(e), None)
        if r["digest"] is not None:
            size = r["size"]
        return (r["project"], path, size, r["mtime_us"], bytes(head) if with_content else None, r["digest"] or h.hexdigest(),
                algo if r["digest"] else "sha256", None, size > len(head) if with_content else None)

    def run(batches):
        for b in batches:
            out, held = [], 0
            for r in b.to_pylist():
                out.append(row(r))
                held += len(out[-1][4] or b"")
                if held >= BATCH_BYTES:
                    yield _batch(out, ROW_TYPES, ROW_NAMES)
                    out, held = [], 0
            yield _batch(out, ROW_TYPES, ROW_NAMES)

    return run


def scan_directory(spark: SparkSession, root: str | None = None, project: str | None = None, parent: str | None = None,
                   with_content: bool = True, prune: list[str] | None = None, head_bytes: int | None = None,
                   whole_names: list[str] | None = None, max_head: int = MAX_HEAD, split_bytes: int = SPLIT_BYTES,
                   part_bytes: int = PART_BYTES, entries_per_task: int = ENTRIES_PER_TASK) -> DataFrame:
    """One project root, or every child directory of ``parent`` as a project: the corpus columns plus ``error`` and ``head_cut``.

    The listing is made now and written; contents are read when the result is used, each time it is used."""
    from ..operators.state import ALL_STATE_NAMES

    if parent:
        roots = spark.createDataFrame([(parent,)], "root string").mapInArrow(_children, ENTRY_SCHEMA)
    else:
        name = project or os.path.basename(os.path.abspath(root))
        roots = spark.createDataFrame([(name, root, bytearray())], "project string, root string, raw binary")
    files = list_files(spark, roots, prune, entries_per_task)
    files = files.withColumn("_large", F.coalesce(F.col("size") > split_bytes, F.lit(False)))
    cost = F.when(F.lit(with_content) | ~F.col("_large"), F.least(F.coalesce("size", F.lit(0)), F.lit(split_bytes))).otherwise(0) + FILE_COST
    dealt, n = deal_by_weight(files.withColumn("_cost", cost), "_cost", part_bytes)
    large = dealt.where("_large").select("project", "root", "raw", "size")
    none = F.lit(None).cast("string")
    if large.take(1):
        digests = materialize(tree_digests(large, split_bytes), "scan-digests")
        dealt = dealt.join(digests, ["project", "root", "raw"], "left")
    else:
        dealt = dealt.withColumn("digest", none).withColumn("failed", none)
    whole = frozenset(x.lower() for x in (ALL_STATE_NAMES if whole_names is None else whole_names))
    read = _reader(with_content, head_bytes, whole, min(max_head, split_bytes), split_bytes)
    return dealt.repartitionById(n, F.col("part").cast("int")).select(
        "project", "root", "raw", "size", "mtime_us", "error", "digest", "failed").mapInArrow(read, SCHEMA)
