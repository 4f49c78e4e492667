"""Helpers shared by the operators: flat byte views of Arrow text, bounded slices, vectorised hashes,
unique words of a batch and the rule for scratch tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

SLICE_BYTES = 4 << 20

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
EMPTY = np.zeros(0, np.int64)


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps neither recompute it nor depend
    on the executors that made it."""
    return materialize(df, f"llm-{name}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(text: str = "text") -> F.Column:
    """With the document id, the key of a row: repeated rows share it, equal ids with other texts don't."""
    return F.xxhash64(F.col(text))


def same_row(left: DataFrame, right: DataFrame, id_col: str = "doc_id") -> F.Column:
    return left[id_col].eqNullSafe(right[id_col]) & (left["_tk"] == right["_tk"])


def numbered(df: DataFrame, *order) -> DataFrame:
    """``df`` with a gapless ``rank`` from 0 in the given order: a range sort and one offset per task."""
    spark = df.sparkSession

    def number(batches):
        from pyspark import TaskContext
        pid, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, pid, np.int32)), pa.array(np.arange(n, n + b.num_rows))],
                                             [*b.schema.names, "_pid", "_i"])
            n += b.num_rows

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    rows = cut(df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(
        number, f"{fields}, _pid int, _i long"), "numbered")
    total, starts = 0, []
    for r in sorted(rows.groupBy("_pid").count().collect()):  # one number per task
        starts.append((r["_pid"], total))
        total += r["count"]
    return rows.join(F.broadcast(spark.createDataFrame(starts, "_pid int, _start long")), "_pid") \
        .select(*df.columns, (F.col("_start") + F.col("_i")).alias("rank"))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and the n + 1 offsets; a null is an empty text."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        _, off = flat(batch.column(batch.schema.get_field_index(text)))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()  # the worker lives on, and other workers share its executor


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ... start + length - 1, row after row."""
    total = int(lengths.sum())
    if not total:
        return EMPTY
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(32))) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


def words64(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position on as a little-endian word; ``buf`` must have 7 bytes to spare."""
    buf = np.ascontiguousarray(buf)
    return np.ndarray((max(0, len(buf) - 7),), "<u8", buf.data, strides=(1,)) if len(buf) > 7 else np.zeros(0, np.uint64)


def span_hashes(w: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes; ``w`` is words64 of a buffer with 8 bytes to spare."""
    h = mix(lengths.astype(np.uint64) * M3)
    at, left = starts.copy(), lengths.copy()
    live = np.flatnonzero(left > 0)
    while len(live):
        n = np.minimum(left[live], 8).astype(np.uint64)
        x = w[at[live]] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - n * np.uint64(8)))
        h[live] = mix((h[live] ^ x) * M1 + M3)
        at[live] += 8
        left[live] -= 8
        live = live[left[live] > 0]
    return h


def unique_words(texts: pa.Array, pattern: str = " ") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct parts of all texts between ``pattern``, the index of each part, and how many each text has."""
    parts = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), pattern)
    coded = parts.flatten().dictionary_encode()
    counts = np.diff(np.asarray(parts.offsets))
    words = coded.dictionary
    if len(pattern) == 1 and len(words):  # no part holds the pattern: one text to decode in place of many
        whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
        return pc.binary_join(whole, pa.scalar(pattern, pa.large_string()))[0].as_py().split(pattern), np.asarray(coded.indices), counts
    return words.to_pylist(), np.asarray(coded.indices), counts


class PieceCache:
    """Values (id lists) of distinct pieces of text, encoded once per Python worker; bounded, emptied when full."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.store, self.size = np.zeros(0, np.uint32), EMPTY
        self.start = EMPTY

    def add(self, pieces: list[str], values: np.ndarray, sizes: np.ndarray) -> None:
        self.at.update(zip(pieces, range(len(self.at), len(self.at) + len(pieces))))
        self.start = np.concatenate([self.start, len(self.store) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.store = np.concatenate([self.store, values.astype(np.uint32)])

    def lay_out(self, parts: list[list[str] | str], index: np.ndarray, counts: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """Values of all texts in order, and how many each text has. ``parts``: the pieces of each distinct
        part (a text: it is its only piece); ``index``: the part at each place; ``counts``: places per text.
        ``encode`` turns new pieces into (values, sizes)."""
        if len(self.at) > self.limit:
            self.clear()
        whole = np.fromiter((type(p) is str for p in parts), bool, len(parts))
        single, several = [p for p in parts if type(p) is str], [p for p in parts if type(p) is not str]
        split = list(chain.from_iterable(several))
        if new := list(set(single).union(split).difference(self.at)):
            self.add(new, *encode(new))
        n_pieces = np.ones(len(parts), np.int64)
        n_pieces[~whole] = np.fromiter(map(len, several), np.int64, len(several))
        border = np.concatenate([[0], np.cumsum(n_pieces)])
        piece, at = np.empty(border[-1], np.int64), self.at.__getitem__
        piece[border[:-1][whole]] = np.fromiter(map(at, single), np.int64, len(single))
        piece[ranges(border[:-1][~whole], n_pieces[~whole])] = np.fromiter(map(at, split), np.int64, len(split))
        sizes = self.size[piece]
        total = np.concatenate([[0], np.cumsum(sizes)])
        start, size = total[border[:-1]], np.diff(total[border])
        store = self.store[ranges(self.start[piece], sizes)]
        index = index.astype(np.int64)
        each = size[index] if len(index) else EMPTY
        ends = np.concatenate([[0], np.cumsum(each)])
        texts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        return store[ranges(start[index], each)] if len(index) else np.zeros(0, np.uint32), np.diff(ends[texts])
