"""Removal of long repeated substrings by a run-length compressed index.

Every byte covered by a ``WINDOW``-byte string that also starts earlier (smaller id, or same document and
earlier start) goes. What has to be compared is brought together without comparing all with all:

1. Each window is keyed by its anchor, the smallest hash among its ``GRAM``-byte strings (leftmost on a tie),
   so equal windows have equal anchors. Neighbouring windows with one anchor form a context of 100 to 176
   bytes. Only hashes of anchors and contexts, ids and places are shuffled, packed by partition.
2. Equal contexts collapse to their earliest one; all windows of the others start earlier elsewhere. Tasks
   collapse their own first, so a text with copies in a third of all rows costs a row per task.
3. Anchors that still have several different contexts are settled on text. The contexts of an anchor are
   indexed by a run-compressed Burrows-Wheeler transform: only at the head of a run is the match with the
   suffix's neighbour computed; everywhere else it is the match one place before, less one (sampled run
   ends stream the matching statistics through the text). Neighbours with matches of 100 or more
   form classes, and all of a class but its earliest member are marked.
4. An anchor that very many different contexts share (found in a sample whose size follows the number of
   partitions; it steers the load only, never the result) is settled window by window through hashes of
   the whole window, which spreads it over all tasks.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import M1, M2, M3, cut, flat, mix, partitions, ranges, slices, span_hashes, words64

WINDOW, GRAM = 100, 24
SPAN = WINDOW - GRAM + 1
SEGMENT = 1 << 19  # bytes whose hashes a task holds at a time: about 50 times as much memory
POS = np.uint64((1 << 24) - 1)
BUNDLE = 1 << 18   # bytes of a suffix array, which takes over 100 times as much
HOT_SAMPLE = 64  # different contexts of one anchor in the sample
NULL_ID = np.iinfo(np.int64).min
COVERED, CHECK, SPREAD = 0, 1, 2

CONTEXT = np.dtype([("anchor", "<u8"), ("hash", "<u8"), ("doc", "<i8"), ("tk", "<i4"), ("start", "<u4"), ("len", "<u2")])
MARK = np.dtype([("doc", "<i8"), ("tk", "<i4"), ("kind", "u1"), ("start", "<u4"), ("len", "<u4"), ("anchor", "<u8")])


def contexts(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start in the buffer, length, anchor hash) of the contexts of all texts."""
    found = []
    for at in range(0, max(len(buf), 1), SEGMENT):
        to = min(len(buf), at + SEGMENT + WINDOW - 1)
        if to - at < WINDOW:
            break
        w = words64(np.concatenate([buf[at:to], np.zeros(8, np.uint8)]))
        n = to - at - GRAM + 1
        h = mix(w[:n] * M1 + w[8:n + 8] * M2 + w[16:n + 16] * M3)
        key = np.full(-(-n // SPAN) * SPAN, np.iinfo(np.uint64).max, np.uint64)
        key[:n] = (h & ~POS) | np.arange(n, dtype=np.uint64)
        grid = key.reshape(-1, SPAN)
        ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        m = n - SPAN + 1
        anchor = (np.minimum(behind[:m], ahead[SPAN - 1:SPAN - 1 + m]) & POS).astype(np.int64)
        # windows inside one text that start in this segment
        first = np.maximum(off[:-1], at)
        last = np.minimum(off[1:] - WINDOW + 1, min(at + SEGMENT, to - WINDOW + 1))
        text = np.flatnonzero(last > first)
        start = ranges(first[text], last[text] - first[text])
        if not len(start):
            continue
        a = anchor[start - at]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (start[1:] != start[:-1] + 1)]))
        end = np.append(new[1:], len(start)) - 1
        begin = start[new]
        found.append((np.searchsorted(off, begin, "right") - 1, begin, start[end] + WINDOW - begin, h[a[new]]))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(map(np.concatenate, zip(*found)))


def collapse(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by anchor, hash and place; whether each starts later than the first of its context."""
    rows = rows[np.lexsort((rows["tk"], rows["start"], rows["doc"], rows["hash"], rows["anchor"]))]
    if not len(rows):
        return rows, np.zeros(0, bool)
    new = np.concatenate([[True], (rows["anchor"][1:] != rows["anchor"][:-1]) | (rows["hash"][1:] != rows["hash"][:-1])])
    first = rows[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return rows, (rows["doc"] != first["doc"]) | (rows["start"] != first["start"])


def marks(rows: np.ndarray, kind) -> np.ndarray:
    out = np.zeros(len(rows), MARK)
    for f in ("doc", "tk", "start", "len", "anchor"):
        out[f] = rows[f]
    out["kind"] = kind
    return out


def packed(target: np.ndarray, rows: np.ndarray, tag: int) -> list[tuple[int, int, bytes]]:
    """(target, tag, bytes) for each target partition that gets rows."""
    order = np.argsort(target, kind="stable")
    target, rows = target[order], rows[order]
    at = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else []
    return [(int(target[a]), tag, rows[a:b].tobytes()) for a, b in zip(at, [*at[1:], len(rows)])]


def batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    k, tag, data = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(tag, pa.int32()), pa.array(data, pa.large_binary()).cast(pa.binary())], ["k", "tag", "data"])


PACKED = "k int, tag int, data binary"


def home(rows: np.ndarray, n: int) -> np.ndarray:
    return (mix(rows["doc"].view(np.uint64).copy() if rows["doc"].flags.c_contiguous else rows["doc"].astype(np.int64).view(np.uint64)) % np.uint64(n)).astype(np.int32)


def unpacked(batches, dtypes: dict[int, np.dtype]) -> dict[int, np.ndarray]:
    """All packed rows of a task, by tag."""
    parts: dict[int, list] = {t: [] for t in dtypes}
    for b in batches:
        for tag, data in zip(b.column(1).to_pylist(), b.column(2)):
            parts[tag].append(np.frombuffer(data.as_buffer(), dtypes[tag]))
    return {t: np.concatenate(p) if p else np.zeros(0, dtypes[t]) for t, p in parts.items()}


def context_rows(b: pa.RecordBatch) -> np.ndarray:
    """CONTEXT rows of a batch of (doc, tk, text)."""
    buf, off = flat(b.column(2))
    text, start, size, anchor = contexts(buf, off)
    rows = np.zeros(len(text), CONTEXT)
    rows["anchor"], rows["start"], rows["len"] = anchor, start - off[text], size
    rows["doc"], rows["tk"] = b.column(0).to_numpy(zero_copy_only=False)[text], b.column(1).to_numpy(zero_copy_only=False)[text]
    rows["hash"] = span_hashes(words64(np.concatenate([buf, np.zeros(16, np.uint8)])), start, size)
    return rows


def hot_anchors(keyed: DataFrame, n: int) -> np.ndarray:
    """Anchors that hold more than about an eighth of a partition's contexts, judged by a sample.

    Which ones are found changes where rows go, not what comes out."""
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = HOT_SAMPLE * 8 * n * 40

    def run(batches):
        for b in slices(batches):
            rows = context_rows(b)
            yield pa.RecordBatch.from_arrays([pa.array(rows[f].view(np.int64) if rows[f].flags.c_contiguous else rows[f].astype(np.uint64).view(np.int64)) for f in ("anchor", "hash")], ["anchor", "hash"])

    found = keyed.sample(min(1.0, wanted / max(total, 1)), seed=1).mapInArrow(run, "anchor long, hash long").distinct() \
        .groupBy("anchor").count().where(F.col("count") >= HOT_SAMPLE).select("anchor").collect()  # at most 8 n rows
    return np.sort(np.array([r.anchor for r in found], np.int64).view(np.uint64))


def is_in(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x if len(some) else np.zeros(len(x), bool)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Of non-negative numbers, by doubling (from three symbols on where three fit a word)."""
    n = len(text)
    s = np.concatenate([text.astype(np.int64), [0, 0]])
    key, depth = (s[:n] << 42 | s[1:n + 1] << 21 | s[2:n + 2], 3) if s.max() < 1 << 21 else (s[:n], 1)
    while True:
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], key[order][1:] != key[order][:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) + 1
        if rank[order[-1]] == n:
            return order
        ahead = np.zeros(n, np.int64)
        ahead[:max(0, n - depth)] = rank[depth:]
        key, depth = rank << 32 | ahead, depth * 2


def common_prefix(w: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Bytes that agree from places a and b on, at most ``limit``."""
    out, live = np.zeros(len(a), np.int64), np.flatnonzero(limit > 0)
    while len(live):
        x = w[a[live] + out[live]] ^ w[b[live] + out[live]]
        same = np.where(x == 0, 8, 0)
        bad = x != 0
        low = (x[bad] & (~x[bad] + np.uint64(1))).astype(np.float64)
        same[bad] = np.log2(low).astype(np.int64) >> 3
        out[live] += same
        live = live[(same == 8) & (out[live] < limit[live])]
    return np.minimum(out, limit)


def later_windows(buf: np.ndarray, off: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Places in the buffer where a window starts whose string starts earlier in another place.

    ``buf``: the texts one after the other; ``order``: of every place, its rank in the corpus."""
    n_texts, size = len(off) - 1, np.diff(off)
    # a separator of its own after each text, below all letters
    place = np.arange(len(buf)) + np.repeat(np.arange(n_texts), size)
    text = np.empty(len(buf) + n_texts, np.int64)
    text[place] = buf.astype(np.int64) + n_texts + 1
    text[off[1:] + np.arange(n_texts)] = np.arange(1, n_texts + 1)
    sa = suffix_array(text)
    before = text[sa - 1]
    heads = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))  # of the runs of the transform
    # at a head: the suffix, its neighbour (the end of the run before), and how far they agree
    suffix, neighbour = sa[heads], sa[heads - 1]
    neighbour[0] = suffix[0]
    back = np.full(len(text), -1, np.int64)
    back[place] = np.arange(len(buf))
    left = np.zeros(len(text), np.int64)
    left[place] = np.repeat(off[1:], size) - np.arange(len(buf))
    w = words64(np.concatenate([buf, np.zeros(16, np.uint8)]))
    limit = np.minimum(left[suffix], left[neighbour])
    limit[0] = 0
    match = common_prefix(w, np.maximum(back[suffix], 0), np.maximum(back[neighbour], 0), limit)
    # everywhere else the match is that of the place before, less one
    by = np.argsort(suffix)
    suffix, match = suffix[by], match[by]
    sample = np.searchsorted(suffix, np.arange(len(text)), "right") - 1
    match = match[sample] - (np.arange(len(text)) - suffix[sample])
    group = np.flatnonzero(match[sa] < WINDOW)  # where a class of equal windows begins, in suffix order
    group = group if len(group) and group[0] == 0 else np.concatenate([[0], group])
    far = np.iinfo(np.int64).max
    rank = np.where(back[sa] >= 0, order[np.maximum(back[sa], 0)], far) if len(buf) else np.full(len(sa), far)
    least = np.repeat(np.minimum.reduceat(rank, group), np.diff(np.append(group, len(sa))))
    return back[sa[(rank > least) & (back[sa] >= 0)]]


def settle(rows: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """MARK rows of the windows of contexts (rows with ``at``, place in ``texts``) that start earlier elsewhere.

    Contexts are indexed in bundles of whole anchors."""
    rows = rows[np.lexsort((rows["start"], rows["tk"], rows["doc"], rows["anchor"]))]
    found = [np.zeros(0, MARK)]
    new = np.flatnonzero(np.concatenate([[True], rows["anchor"][1:] != rows["anchor"][:-1]])) if len(rows) else np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(rows["len"].astype(np.int64))])
    at = 0
    while at < len(new):
        first = new[at]
        at = max(at + 1, int(np.searchsorted(total[new], total[first] + BUNDLE, "right")) - 1)
        some = rows[first:new[at] if at < len(new) else len(rows)]
        size = some["len"].astype(np.int64)
        buf = texts[ranges(some["at"].astype(np.int64), size)]
        off = np.concatenate([[0], np.cumsum(size)])
        text = np.repeat(np.arange(len(some)), size)
        inside = np.arange(len(buf)) - off[text]
        doc = np.unique(some["doc"], return_inverse=True)[1]
        order = doc[text] << 40 | some["start"].astype(np.int64)[text] + inside
        later = later_windows(buf, off, order)
        out = marks(some[text[later]], COVERED)
        out["start"] += inside[later].astype(np.uint32)
        out["len"] = WINDOW
        found.append(out)
    return np.concatenate(found)


def merged(rows: np.ndarray) -> np.ndarray:
    """MARK rows sorted by document, covered ones joined to maximal runs."""
    rows = rows[np.lexsort((rows["start"], rows["kind"], rows["tk"], rows["doc"]))]
    covered, rest = rows[rows["kind"] == COVERED], rows[rows["kind"] != COVERED]
    if len(covered):
        other = np.concatenate([[False], (covered["doc"][1:] != covered["doc"][:-1]) | (covered["tk"][1:] != covered["tk"][:-1])])
        base = np.cumsum(other) << 40
        start, end = base + covered["start"], np.maximum.accumulate(base + covered["start"] + covered["len"])
        new = np.concatenate([[True], start[1:] > end[:-1]])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(covered)) - 1
        covered = covered[at]
        covered["len"] = (end[last] - start[at]).astype(np.uint32)
    rows = np.concatenate([covered, rest])
    return rows[np.lexsort((rows["start"], rows["kind"], rows["tk"], rows["doc"]))]


def by_document(rows: np.ndarray) -> pa.RecordBatch:
    """One row for each document with all of its marks."""
    rows = merged(rows)
    at = np.flatnonzero(np.concatenate([[True], (rows["doc"][1:] != rows["doc"][:-1]) | (rows["tk"][1:] != rows["tk"][:-1])])) if len(rows) else np.zeros(0, np.int64)
    data = rows.tobytes()
    w = MARK.itemsize
    ends = np.append(at[1:], len(rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(rows["doc"][at], pa.int64()), pa.array(rows["tk"][at], pa.int32()),
         pa.array([data[a * w:b * w] for a, b in zip(at.tolist(), ends.tolist())], pa.binary())], ["mdoc", "mtk", "marks"])


BY_DOCUMENT = "mdoc long, mtk int, marks binary"


def find_marks(keyed: DataFrame, hot: np.ndarray, n: int) -> DataFrame:
    """Steps 1 and 2: marks of each document (covered, to check, to spread)."""
    def collect(batches):
        for b in slices(batches):
            rows, later = collapse(context_rows(b))
            done = marks(rows[later], COVERED)
            rows = rows[~later]
            key = np.where(is_in(rows["anchor"], hot), mix(rows["anchor"] ^ rows["hash"]), rows["anchor"])
            yield batch(packed((key % np.uint64(n)).astype(np.int32), rows, 0) + packed(home(done, n), done, 1))

    def reduce(batches):
        got = unpacked(batches, {0: CONTEXT, 1: MARK})
        rows, later = collapse(got[0])
        done = marks(rows[later], COVERED)
        # a repeated row stands at its first one's place; one of them is enough
        rows = rows[~later]
        rows = rows[np.concatenate([[True], rows[1:] != rows[:-1]])] if len(rows) else rows
        spread = is_in(rows["anchor"], hot)
        same = np.concatenate([[False], rows["anchor"][1:] == rows["anchor"][:-1]]) if len(rows) else np.zeros(0, bool)
        several = (same | np.append(same[1:], False)) & ~spread if len(rows) else same
        out = np.concatenate([got[1], done, marks(rows[several], CHECK), marks(rows[spread], SPREAD)])
        yield batch(packed(home(out, n), out, 0))

    def gather(batches):
        yield by_document(unpacked(batches, {0: MARK})[0])

    return keyed.mapInArrow(collect, PACKED).repartitionById(n, F.col("k")).mapInArrow(reduce, PACKED) \
        .repartitionById(n, F.col("k")).mapInArrow(gather, BY_DOCUMENT)


def settle_marks(marked: DataFrame, n: int) -> DataFrame:
    """Steps 3 and 4: the contexts to check and to spread, fetched from their texts; marks of each document."""
    def fetch(batches):
        for b in slices(batches):
            buf, off = flat(b.column(2))
            parts = [np.frombuffer(m, MARK) if m else np.zeros(0, MARK) for m in b.column(3).to_pylist()]
            rows = np.concatenate(parts) if parts else np.zeros(0, MARK)
            at = np.repeat(off[:-1], [len(p) for p in parts]) + rows["start"]
            out = []
            check = rows["kind"] == CHECK
            for k in np.unique(rows["anchor"][check] % np.uint64(n)):
                pick = check & (rows["anchor"] % np.uint64(n) == k)
                size = rows["len"][pick].astype(np.int64)
                text = buf[ranges(at[pick].astype(np.int64), size)].tobytes()
                out.append((int(k), 0, len(text).to_bytes(8, "little") + text + rows[pick].tobytes()))
            spread = rows["kind"] == SPREAD
            if spread.any():
                each = rows["len"][spread].astype(np.int64) - WINDOW + 1
                windows = np.repeat(rows[spread], each)
                inside = ranges(np.zeros(len(each), np.int64), each)
                w = words64(np.concatenate([buf, np.zeros(16, np.uint8)]))
                start = np.repeat(at[spread].astype(np.int64), each) + inside
                one = np.zeros(len(windows), CONTEXT)
                one["doc"], one["tk"], one["start"], one["len"] = windows["doc"], windows["tk"], windows["start"] + inside, WINDOW
                one["anchor"] = span_hashes(w, start, np.full(len(start), WINDOW))
                one["hash"] = span_hashes(w, start + 1, np.full(len(start), WINDOW - 1)) ^ buf[start].astype(np.uint64) * M2
                one, later = collapse(one)
                done = marks(one[later], COVERED)
                one = one[~later]
                out += packed((one["anchor"] % np.uint64(n)).astype(np.int32), one, 1) + packed(home(done, n), done, 2)
            yield batch(out)

    checked = np.dtype([*MARK.descr, ("at", "<i8")])

    def reduce(batches):
        texts, rows, size, windows, done = [], [], 0, [], []
        for b in batches:
            for tag, data in zip(b.column(1).to_pylist(), b.column(2)):
                data = data.as_buffer()
                if tag == 0:
                    n_text = int.from_bytes(bytes(data[:8]), "little")
                    texts.append(np.frombuffer(data, np.uint8, n_text, 8))
                    part = np.frombuffer(data, MARK, -1, 8 + n_text)
                    some = np.zeros(len(part), checked)
                    for f in MARK.names:
                        some[f] = part[f]
                    some["at"] = size + np.cumsum(part["len"].astype(np.int64)) - part["len"]
                    rows.append(some)
                    size += n_text
                else:
                    (windows if tag == 1 else done).append(np.frombuffer(data, CONTEXT if tag == 1 else MARK))
        found = [np.zeros(0, MARK), *done]
        if rows:
            found.append(settle(np.concatenate(rows), np.concatenate(texts)))
        if windows:
            one, later = collapse(np.concatenate(windows))
            found.append(marks(one[later], COVERED))
        yield by_document(np.concatenate(found))

    return marked.select("doc", "tk", "text", "marks").where("marks is not null").mapInArrow(fetch, PACKED) \
        .repartitionById(n, F.col("k")).mapInArrow(reduce, BY_DOCUMENT) \
        .groupBy("mdoc", "mtk").agg(F.collect_list("marks").alias("late"))


def remove(text: str | None, parts: list[bytes | None]) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes that no mark covers, and the maximal removed spans."""
    raw = (text or "").encode()
    change = np.zeros(len(raw) + 1, np.int32)
    for p in parts:
        if p:
            m = np.frombuffer(p, MARK)
            m = m[m["kind"] == COVERED]
            np.add.at(change, m["start"].astype(np.int64), 1)
            np.add.at(change, m["start"].astype(np.int64) + m["len"], -1)
    gone = np.cumsum(change)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, spans (start and end of each removed run, bytes), kept (the remaining bytes).

    A null text is empty; texts under ``WINDOW`` bytes lose nothing. Rows that share an id are one document:
    repeated rows are not repeats of each other, and all give the same result. A null id comes first."""
    spark = docs.sparkSession
    n = partitions(spark)
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NULL_ID))).alias("doc"),
                        F.xxhash64(text_col).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("tk"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = cut(find_marks(keyed, hot_anchors(keyed, n), n), "marks")
    # one key, the document: a text is shuffled once, and again never, as the table is bucketed by it
    same = (F.col("doc") == F.col("mdoc")) & (F.col("tk") - F.col("mtk") == 0)
    joined = keyed.join(found.hint("shuffle_hash"), same, "left").drop("mdoc", "mtk")
    name = f"llm_repeats_{uuid.uuid4().hex}"
    joined.write.option("path", scratch_path(spark, "llm-repeats")).option("compression", "zstd") \
        .bucketBy(n, "doc").saveAsTable(name)
    marked = spark.table(name)
    late = cut(settle_marks(marked, n), "late-marks")
    both = marked.join(late.hint("shuffle_hash"), same, "left").select("doc", "text", "marks", "late")

    def apply(batches):
        for b in slices(batches):
            got = [remove(t, [m, *(x or [])]) for t, m, x in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([[{"start": s, "end": e} for s, e in x] for _, x in got], SPANS),
                                              pa.array([k for k, _ in got], pa.binary())], ["id", "text", "spans", "kept"])

    return both.mapInArrow(apply, "id long, text string, spans array<struct<start: long, end: long>>, kept binary") \
        .withColumn("id", F.when(F.col("id") == F.lit(int(NULL_ID)), None).otherwise(F.col("id")))


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def op1(docs: DataFrame) -> DataFrame:
    found = dedup_substrings(docs)
    n_bytes = F.octet_length("text").cast("long")
    return found.select(F.col("id").alias("doc_id"), n_bytes.alias("n_bytes"), (n_bytes - F.length("kept")).cast("long").alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
