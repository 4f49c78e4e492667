"""Line dedup: range-partitioned line hashes, streamed in (hash, document) order, keep bitmaps out.

Every document gives one narrow row per distinct key (128-bit hash, id, positions). The rows are range
partitioned by (hash, id descending) and sorted, so a key that a third of all documents share spans
many tasks. A task streams its keys: the first document of a key is the largest id, which keeps its
lines; the others are dropped as soon as ``min_docs`` documents have been seen. Only a task's first
and last key can go on in a neighbour: rows of theirs that can't be decided yet leave as pending,
with one summary row per key. The summaries (two a task) settle the pending rows. What comes back
are compressed bitmaps of kept lines per document, not text.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, partitions, slices, text_key

BLANK = " \t\n\x0b\x0c\r"


def line_key(line: str, min_chars: int) -> bytes | None:
    """The stripped line with A-Z lower-cased, or None when it is too short to count."""
    line = line.strip(BLANK)
    return line.encode().lower() if len(line) >= min_chars else None  # bytes.lower() maps A-Z only


def line_rows(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    def rows(batches):
        for b in slices(batches, text_col):
            out = ([], [], [], [], [], [])
            for doc, tk, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                at: dict[bytes, list[int]] = {}
                lines = (text or "").split("\n")
                for i, line in enumerate(lines):
                    if (key := line_key(line, min_chars)) is not None:
                        at.setdefault(key, []).append(i)
                for key, places in at.items():
                    h = xxhash.xxh3_128_digest(key)
                    for column, x in zip(out, (int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True),
                                               doc, tk, places, len(lines))):
                        column.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), b.schema.field(0).type, pa.int64(), pa.list_(pa.int32()), pa.int32()))],
                ["h1", "h2", "id", "_tk", "places", "n_lines"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("_tk"), F.col(text_col)).mapInArrow(
        rows, f"h1 long, h2 long, id {kind}, _tk long, places array<int>, n_lines int")


def _stream(min_docs: int):
    """Rows of a task, sorted by key and descending id, to decided drops, pending rows and summaries."""
    names = ["kind", "h1", "h2", "id", "_tk", "places", "n_lines", "pid", "n_docs", "last_id"]

    def run(batches):
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        key = top = last = None
        n, first_key, held, kinds = 0, True, [], None

        def summary():
            return ("summary", *key, top, None, None, None, pid, n, last)

        def pack(rows):
            cols = list(zip(*rows)) or [()] * len(names)
            types = [pa.string(), pa.int64(), pa.int64(), kinds, pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int64(), kinds]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for b in batches:
            kinds, out = b.schema.field(2).type, []
            for h1, h2, doc, tk, places, lines in zip(*(c.to_pylist() for c in b.columns)):
                if key != (h1, h2):
                    if key is not None and first_key:
                        out.append(summary())
                        first_key = False
                    key, top, last, n, held = (h1, h2), doc, doc, 1, []
                    if first_key:
                        out.append(("pending", h1, h2, doc, tk, places, lines, pid, None, None))
                    continue
                if doc != last:
                    n, last = n + 1, doc
                row = (h1, h2, doc, tk, places, lines, pid, None, None)
                if first_key:
                    out.append(("pending", *row))
                elif doc != top:
                    if n >= min_docs:
                        out += [("drop", *x) for x in [*held, row]]
                        held = []
                    else:
                        held.append(row)
            if out:
                yield pack(out)
        if key is not None:
            yield pack([summary(), *(("pending", *x) for x in held)])

    return run


def _settle(summaries: list, min_docs: int) -> list[tuple]:
    """(h1, h2, keeper) of the keys of at least ``min_docs`` documents that meet task borders."""
    runs: dict[tuple, list] = {}
    for s in sorted(summaries, key=lambda s: s.pid):
        runs.setdefault((s.h1, s.h2), []).append(s)
    found = []
    for key, parts in runs.items():
        n = sum(p.n_docs for p in parts) - sum(a.last_id == b.id for a, b in zip(parts, parts[1:]))
        if n >= min_docs:
            found.append((*key, parts[0].id))
    return found


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """id, _tk, n_lines, keep (zlib of the packed bits, first line first) of each document that loses a line.

    A key held by ``min_docs`` ids or more stays only in the largest id (null is the smallest). Rows
    with the same id and text are one document; empty texts and short lines never lose anything."""
    spark = docs.sparkSession
    rows = line_rows(docs, min_chars, id_col, text_col)
    order = ["h1", "h2", F.desc_nulls_last("id")]
    kind = docs.schema[id_col].dataType.simpleString()
    streamed = cut(rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "_tk").mapInArrow(
        _stream(min_docs), f"kind string, h1 long, h2 long, id {kind}, _tk long, places array<int>, n_lines int, pid int, n_docs long, last_id {kind}"), "lines")
    # two rows a task at most
    settled = _settle(streamed.where("kind = 'summary'").select("h1", "h2", "id", "pid", "n_docs", "last_id").collect(), min_docs)
    schema = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()),
                           T.StructField("keeper", docs.schema[id_col].dataType)])
    late = streamed.where("kind = 'pending'").join(F.broadcast(spark.createDataFrame(settled, schema)), ["h1", "h2"]) \
        .where(~F.col("id").eqNullSafe(F.col("keeper")))
    cols = ["id", "_tk", "places", "n_lines"]
    drops = streamed.where("kind = 'drop'").select(*cols).unionByName(late.select(*cols))

    def bitmaps(batches):
        for b in batches:
            keep = []
            for places, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                bits = np.ones(n, np.uint8)
                bits[places] = 0
                keep.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(keep, pa.binary())], ["id", "_tk", "n_lines", "keep"])

    by_doc = drops.groupBy("id", "_tk").agg(F.flatten(F.collect_list("places")).alias("places"), F.max("n_lines").alias("n_lines"))
    return by_doc.mapInArrow(bitmaps, f"id {kind}, _tk long, n_lines int, keep binary")


def kept_text(text: str | None, keep: bytes | None) -> tuple[str, int, int]:
    """What a bitmap leaves of a text, its lines before, and the lines dropped."""
    lines = (text or "").split("\n")
    if keep is None:
        return text or "", len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join(x for x, bit in zip(lines, bits) if bit), len(lines), len(lines) - int(bits.sum())


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, the text without its dropped lines, plus _n_lines, _n_dropped and
    _kept_sha256. A null text becomes empty."""
    maps = keep_bitmaps(docs, min_chars, min_docs, id_col, text_col).withColumnsRenamed({"id": "_id", "_tk": "_mk", "keep": "_keep"}).drop("n_lines")
    keyed = docs.withColumn("_tk", text_key(text_col))
    joined = keyed.join(maps.hint("shuffle_hash"), keyed[id_col].eqNullSafe(maps["_id"]) & (keyed["_tk"] == maps["_mk"]), "left") \
        .drop("_id", "_mk", "_tk")

    def apply(batches):
        for b in slices(batches, text_col):
            at = b.schema.get_field_index(text_col)
            got = [kept_text(t, k) for t, k in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist())]
            sha = [hashlib.sha256(t.encode()).hexdigest() for t, _, _ in got]
            cols = [*b.columns[:-1], pa.array([n for _, n, _ in got], pa.int64()), pa.array([d for _, _, d in got], pa.int64()), pa.array(sha, pa.string())]
            cols[at] = pa.array([t for t, _, _ in got], pa.string())
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:-1], "_n_lines", "_n_dropped", "_kept_sha256"])

    out = T.StructType([*docs.schema.fields, T.StructField("_n_lines", T.LongType()), T.StructField("_n_dropped", T.LongType()),
                        T.StructField("_kept_sha256", T.StringType())])
    return joined.mapInArrow(apply, out)


def op4(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.col("_kept_sha256").alias("kept_sha256"))
