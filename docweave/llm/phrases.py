"""Phrase collocation mining: double-array tries of Apriori-safe candidates, advanced over all positions at once.

1. Texts become arrays of 64-bit symbols, one per (language, word), 0 between pieces; the words of some slices leave with
   their counts. Two words with one symbol are looked for, and another seed is taken if there are any, so symbols are exact.
2. Level by level (2 to ``max_words``), a position is safe when the shorter phrases that start there and one word later
   fall into buckets that reach ``min_count``. Safe phrases are counted by bucket of their hash, ``FINER_BITS`` finer than
   the bitmaps, so that a corpus of any size leaves few phrases in a bucket: tasks send their counts in packs of
   ``CHUNK_BITS``, the packs are added up, the heavy buckets stay in a table and only a bitmap of them (``BUCKET_BITS``
   bits) is broadcast. Collisions make a bucket heavier, never lighter: no frequent phrase is lost.
3. Phrases that the bitmaps let through and whose own bucket is heavy are the candidates. They are cut into blocks of
   ``block_phrases`` in symbol order; a task lays each block out as a double-array trie, and each block is broadcast. Tasks
   move the states of all positions where a heavy pair of words begins one word on at a time, each position in the blocks
   that hold its first word, and add up accepting states with bincount; the sums over all tasks are the exact counts.
4. Cuts, scores, and the dropping of phrases inside longer ones are joins of the frequent phrases.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import M1, M2, M3, cut, flat, mix, numbered, partitions, ranges, slices, span_hashes, words64

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
BUCKET_BITS = 26            # a bitmap of 8 MB, whatever the corpus
FINER_BITS = 16             # counted are 2 ** 42 buckets
CHUNK_BITS = 10             # buckets with these first bits are counted together: 1,024 packs at most for each HELD_BUCKETS
BLOCK_PHRASES = 1 << 17     # a trie of about 6 MB
BLOCKS_A_PASS = 16
SLICE = 1 << 20
HELD_WORDS = 1 << 19
ROW_SYMBOLS = 1 << 7        # 1 KB: Parquet's pages and reader batches and Arrow's batches hold thousands of rows at once
READ_SYMBOLS = 1 << 17
HELD_BUCKETS = 1 << 20
ADDED_BUCKETS = 1 << 20     # counts that wait to be added up
HELD_PHRASES = 1 << 16
MERGED_BYTES = 8 << 20      # packs that wait to be merged
SENT_BITS = 17              # of a task's memory of the phrases that it has sent, and more for short ones: 24 MB for 2 to 5 words
HELD_STATES = 1 << 19
SUM_PHRASES = 1 << 13       # counts of so many phrases travel together
BATCH_BYTES = 4 << 20

WORD, BLANK, BORDER = 0, 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[32, 9]] = BLANK
KIND[[*b".,;:!?", *range(10, 14)]] = BORDER
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


# ------------------------------------------------------------------ symbols

def _binary(keys: np.ndarray) -> pa.Array:
    """Rows of a (n, k) array of symbols as binary values of 8 k bytes."""
    keys = np.ascontiguousarray(keys, "<u8")
    step = 8 * (keys.shape[1] if keys.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.large_binary(), len(keys), [None, pa.py_buffer(np.arange(len(keys) + 1, dtype=np.int64) * step), pa.py_buffer(keys)]).cast(pa.binary())


def symbols(texts: pa.Array, langs: list[str], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all words with 0 after each piece and text, and each word's place, start, length and text."""
    data, off = flat(texts)
    data = LOWER[data]
    kind = KIND[data]
    inside = kind == WORD
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins, ends = off[:-1][np.diff(off) > 0], off[1:][np.diff(off) > 0]
    first[begins], last[ends - 1] = inside[begins], inside[ends - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    # one 0 after each text and each piece: borders counted before a word shift it
    borders = np.flatnonzero(kind == BORDER)
    doc = np.searchsorted(off, start, "right") - 1
    place = np.arange(len(start)) + np.searchsorted(borders, start) + doc
    buf = np.concatenate([data, np.zeros(16, np.uint8)])
    lang = np.array([xxhash.xxh3_64_intdigest(x, seed) for x in langs], np.uint64)
    sym = mix((span_hashes(words64(buf), start, stop - start) ^ np.uint64(seed * 0x9E37 & 0xFFFFFFFF)) * M1 + (lang[doc] if len(doc) else np.uint64(0)))
    sym[sym == 0] = 1
    out = np.zeros(len(start) + len(borders) + len(texts), np.uint64)
    out[place] = sym
    return out, sym, start, stop - start, doc


def _word_texts(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    body = LOWER[data[ranges(start, length)]]
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).cast(pa.string())


def _squeezed(sym: np.ndarray) -> np.ndarray:
    """One 0 for each run of them."""
    keep = sym != 0
    keep[1:] |= sym[:-1] != 0
    return sym[keep]


def _same(words: pa.Array) -> np.ndarray:
    """Whether a word is the one before it."""
    return pc.equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)


def _summed(held: list[tuple]) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
    """Symbols, languages, words and counts of some slices, with the counts of equal ones added up."""
    sym, n = (np.concatenate([x[i] for x in held]) for i in (0, 3))
    order = np.argsort(sym, kind="stable")
    sym, n = sym[order], n[order]
    lang, word = (pa.concat_arrays([x[i] for x in held]).take(pa.array(order)) for i in (1, 2))
    first = np.flatnonzero(np.concatenate([[True], (sym[1:] != sym[:-1]) | ~_same(lang) | ~_same(word)])) if len(sym) else order
    return sym[first], lang.take(pa.array(first)), word.take(pa.array(first)), np.add.reduceat(n, first) if len(first) else n


def encode(docs: DataFrame, seed: int, text_col: str, lang_col: str) -> DataFrame:
    """Rows with ``codes`` (symbols of some pieces), and rows with ``sym, lang, word, n`` (words of some slices)."""
    def words(held):
        sym, lang, word, n = held
        return pa.RecordBatch.from_arrays([pa.nulls(len(sym), pa.binary()), _binary(sym), lang, word, pa.array(n)], names)

    def run(batches):
        held, size = [], 0
        for b in slices(batches, "text", SLICE):
            langs = b.column(0).to_pylist()
            sym, each, start, length, doc = symbols(b.column(1), langs, seed)
            sym = _squeezed(sym)
            gaps = np.flatnonzero(sym == 0) + 1  # rows end after a 0
            wanted = np.arange(ROW_SYMBOLS, len(sym), ROW_SYMBOLS)
            cuts = np.unique(gaps[np.minimum(np.searchsorted(gaps, wanted), len(gaps) - 1)]) if len(gaps) and len(wanted) else np.zeros(0, int)
            ends = np.unique(np.append(cuts, len(sym)))
            ends = ends[ends > 0]
            parts = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends * 8).astype(np.int32)), pa.py_buffer(sym)])
            keys, at, n = np.unique(each, return_index=True, return_counts=True)
            data, _ = flat(b.column(1))
            blank = pa.nulls(len(parts))
            yield pa.RecordBatch.from_arrays([parts, blank.cast(pa.binary()), blank.cast(pa.string()), blank.cast(pa.string()),
                                              blank.cast(pa.int64())], names)
            held.append((keys, pa.array(langs, pa.string()).take(pa.array(doc[at])), _word_texts(data, start[at], length[at]), n.astype(np.int64)))
            size += len(keys)
            if size >= HELD_WORDS:
                held = [_summed(held)]
                if len(held[0][0]) >= HELD_WORDS // 2:
                    yield words(held.pop())
                size = sum(len(x[0]) for x in held)
        if held:
            yield words(_summed(held))

    names = ["codes", "sym", "lang", "word", "n"]
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "codes binary, sym binary, lang string, word string, n long")


def _arrays(batches):
    """The symbols of an Arrow stream, about READ_SYMBOLS at a time; each array ends with a 0."""
    for b in batches:
        col = b.column(0)
        off = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64) // 8
        if len(col) == 0 or off[-1] == off[0]:
            continue
        data = np.frombuffer(col.buffers()[2], np.uint8)[:off[-1] * 8].view("<u8")
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(off, off[at] + READ_SYMBOLS, "right")) - 1)
            yield np.concatenate([data[off[at]:off[to]], np.zeros(1, np.uint64)])
            at = to
    pa.default_memory_pool().release_unused()  # the worker lives on, and other workers share its executor


# ------------------------------------------------------------------ safe positions

def _longer(h: np.ndarray, sym: np.ndarray) -> np.ndarray:
    return mix((h * M2 + M3) ^ sym)


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _heavy(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = _bucket(h, len(bitmap).bit_length() + 2)
    return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 != 0


def _levels(sym: np.ndarray, bitmaps: list[np.ndarray], most: int):
    """For k from 2 to ``most``: k, the positions whose phrase of k words has only heavy shorter phrases in it, and the
    phrases' hashes; of those, the ones that are heavy themselves if there is a bitmap for k words."""
    at = np.flatnonzero(sym)
    at = at[_heavy(bitmaps[0], mix(sym[at]))]
    h = sym[at]
    for k in range(2, most + 1):
        # a phrase of k words needs the one of k - 1 words here and one word later
        follows = np.flatnonzero(np.diff(at) == 1) if len(at) > 1 else np.zeros(0, np.int64)
        at, h = at[follows], _longer(h[follows], sym[at[follows] + k - 1])
        if k <= len(bitmaps):
            good = _heavy(bitmaps[k - 1], h)
            at, h = at[good], h[good]
        yield k, at, h


def safe(sym: np.ndarray, bitmaps: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose phrase of k words has only heavy shorter phrases in it, and the phrases' hashes."""
    *_, (_, at, h) = _levels(sym, bitmaps[:k - 1], k)
    return at, h


def _low_bits(bits: int) -> int:
    """The bits of a bucket behind those of its chunk: 32 at most."""
    return bits - min(bits, CHUNK_BITS)


def _packs(bucket: np.ndarray, n: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows of ``chunk, pack``: sorted distinct buckets and their counts, one pack for each chunk: all buckets, then all counts."""
    chunk = bucket >> _low_bits(bits)
    first = np.flatnonzero(np.diff(chunk, prepend=-1))
    ends = np.append(first[1:], len(bucket))
    size, i = ends - first, np.arange(len(bucket))
    out = np.empty(2 * len(bucket), "<u4")
    out[i + np.repeat(first, size)] = bucket & (1 << _low_bits(bits)) - 1
    out[i + np.repeat(ends, size)] = n
    offsets = np.append(first, len(bucket)) * 8
    packs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])
    return pa.RecordBatch.from_arrays([pa.array(chunk[first].astype(np.int32)), packs], ["chunk", "pack"])


def _added(lows: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct buckets and the sums of their counts."""
    low, n = np.concatenate(lows), np.concatenate(counts)
    order = np.argsort(low, kind="stable")
    low, n = low[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])) if len(low) else np.zeros(0, np.int64)
    return low[first], np.add.reduceat(n, first) if len(first) else n


def _heavy_buckets(packs: DataFrame, least: int, bits: int, marks: int) -> DataFrame:
    """Rows of ``chunk, heavy, at, bits``: the buckets of a chunk whose counts in all packs come to ``least`` or more, and the
    bytes from byte ``at`` of a bitmap of 2 ** ``marks`` bits that hold their first bits."""
    low = _low_bits(bits)

    def laid(chunk, lows, counts):
        heavy, n = _added(lows, counts)
        heavy = heavy[n >= least]
        if not len(heavy):
            return
        begin, end = (chunk << low) >> (bits - marks), ((chunk + 1 << low) - 1) >> (bits - marks)
        mark = np.zeros(8 * ((end >> 3) - (begin >> 3) + 1), bool)
        mark[((chunk << low) + heavy.astype(np.int64) >> (bits - marks)) - (begin & ~7)] = True
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([heavy.tobytes()], pa.binary()), pa.array([begin >> 3], pa.int32()),
                                          pa.array([np.packbits(mark, bitorder="little").tobytes()], pa.binary())], ["chunk", "heavy", "at", "bits"])

    def add_all(batches):
        """Packs sorted by chunk."""
        now, lows, counts, size, most = None, [], [], 0, ADDED_BUCKETS
        for b in batches:
            for chunk, pack in zip(b.column(0).to_pylist(), b.column(1)):
                if now != chunk:
                    if now is not None:
                        yield from laid(now, lows, counts)
                    now, lows, counts, size, most = chunk, [], [], 0, ADDED_BUCKETS
                pack = np.frombuffer(pack.as_buffer(), "<u4")
                lows.append(pack[:len(pack) // 2].copy())
                counts.append(pack[len(pack) // 2:].astype(np.int64))
                size += len(lows[-1])
                if size > most:
                    low, n = _added(lows, counts)
                    lows, counts, size, most = [low], [n], len(low), 2 * len(low) + ADDED_BUCKETS
        if now is not None:
            yield from laid(now, lows, counts)

    n = min(partitions(packs.sparkSession), 1 << min(bits, CHUNK_BITS))
    return packs.repartition(n, "chunk").sortWithinPartitions("chunk").mapInArrow(add_all, "chunk int, heavy binary, at int, bits binary")


def _marked(heavy: DataFrame, marks: int) -> np.ndarray:
    """The bitmap of the rows of _heavy_buckets."""
    out = np.zeros(1 << (marks - 3), np.uint8)
    for r in heavy.select("at", "bits").collect():  # 2 ** marks bits at most, but for a byte that chunks share
        out[r["at"]:][:len(r.bits)] |= np.frombuffer(r.bits, np.uint8)
    return out


def _bitmap(packs: DataFrame, least: int, bits: int) -> np.ndarray:
    """The bitmap of the buckets whose counts in all packs come to ``least`` or more."""
    return _marked(_heavy_buckets(packs, least, bits, bits), bits)


def _bucket_counts(codes: DataFrame, maps, k: int, bits: int) -> DataFrame:
    """Packs of the counts of the safe phrases of ``k`` words."""
    def run(batches):
        held, size = [], 0
        for sym in _arrays(batches):
            _, h = safe(sym, maps.value, k)
            held.append(_bucket(h, bits))
            size += len(h)
            if size >= HELD_BUCKETS:
                yield _packs(*np.unique(np.concatenate(held), return_counts=True), bits)
                held, size = [], 0
        if size:
            yield _packs(*np.unique(np.concatenate(held), return_counts=True), bits)

    return codes.mapInArrow(run, "chunk int, pack binary")


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Distinct rows of symbols."""
    if len(rows) < 2:
        return rows
    order = np.lexsort(rows.T[::-1])
    rows = rows[order]
    return rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])]


def _hashes(rows: np.ndarray) -> np.ndarray:
    """The hashes of phrases, as in _levels."""
    h = rows[:, 0]
    for j in range(1, rows.shape[1]):
        h = _longer(h, rows[:, j])
    return h


class Sent:
    """Phrases of ``k`` words that a task has sent, one at each place of a table: a phrase that another has pushed out goes
    again, none is held back."""

    def __init__(self, k: int):
        self.rows = np.zeros((1 << SENT_BITS + max(0, 4 - k), k), np.uint64)  # a phrase has no symbol 0

    def new(self, rows: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The rows that are not in the table, which are put there."""
        place = (h & np.uint64(len(self.rows) - 1)).astype(np.int64)
        fresh = (self.rows[place] != rows).any(1)
        rows, place = rows[fresh], place[fresh]
        self.rows[place] = rows
        return rows


def _phrases(codes: DataFrame, maps, heavy: DataFrame, max_words: int, bits: int) -> DataFrame:
    """Distinct phrases of 2 words and more that the bitmaps and ``heavy`` (``words, chunk, heavy``) have, as their symbols.

    Tasks send the phrases that they hold in packs, one per length and chunk of buckets; each is merged once, behind the
    heavy buckets of its length and chunk."""
    n, low = min(partitions(codes.sparkSession), 1 << min(bits, CHUNK_BITS)), _low_bits(bits)

    def packs(k, rows):
        chunk = _bucket(_hashes(rows), bits) >> low
        order = np.argsort(chunk, kind="stable")
        rows, chunk = rows[order], chunk[order]
        first = np.flatnonzero(np.diff(chunk, prepend=-1))
        offsets = (np.append(first, len(rows)) * 8 * k).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])
        return pa.RecordBatch.from_arrays([pa.array(chunk[first].astype(np.int32)), pa.array(np.full(len(first), k, np.int32)),
                                           pa.array(np.ones(len(first), np.int32)), parts], ["chunk", "words", "kind", "pack"])

    def run(batches):
        ks = range(2, max_words + 1)
        held, size, sent = {k: [] for k in ks}, dict.fromkeys(ks, 0), {k: Sent(k) for k in ks}
        for sym in _arrays(batches):
            for k, at, h in _levels(sym, maps.value, max_words):
                held[k].append(sent[k].new(sym[at[:, None] + np.arange(k)], h))
                size[k] += len(held[k][-1])
                if size[k] >= HELD_PHRASES:
                    yield packs(k, _distinct(np.concatenate(held[k])))
                    held[k], size[k] = [], 0
        for k in ks:
            if size[k]:
                yield packs(k, _distinct(np.concatenate(held[k])))

    def wanted(k, buckets, packs):
        """Distinct phrases of some packs whose bucket is one of the sorted ``buckets``."""
        rows = np.frombuffer(b"".join(packs), "<u8").reshape(-1, k)
        own = (_bucket(_hashes(rows), bits) & (1 << low) - 1).astype("<u4")
        return _distinct(rows[buckets[np.minimum(np.searchsorted(buckets, own), len(buckets) - 1)] == own])

    def merge(batches):
        """Packs sorted by chunk, length and kind: the heavy buckets (kind 0) come first."""
        now, buckets, held, size, most = None, None, [], 0, MERGED_BYTES
        for b in batches:
            for chunk, k, kind, pack in zip(*(c.to_pylist() for c in b.columns)):
                if now != (chunk, k):
                    if held:
                        yield pa.RecordBatch.from_arrays([_binary(wanted(now[1], buckets, held))], ["key"])
                    now, buckets, held, size, most = (chunk, k), None, [], 0, MERGED_BYTES
                if kind == 0:
                    buckets = np.frombuffer(pack, "<u4")
                elif buckets is not None:  # without heavy buckets there are no candidates
                    held.append(pack)
                    size += len(pack)
                    if size > most:
                        held = [wanted(k, buckets, held).tobytes()]
                        size, most = len(held[0]), 2 * len(held[0]) + MERGED_BYTES
        if held:
            yield pa.RecordBatch.from_arrays([_binary(wanted(now[1], buckets, held))], ["key"])

    own = heavy.select("chunk", "words", F.lit(0).alias("kind"), F.col("heavy").alias("pack"))
    return codes.mapInArrow(run, "chunk int, words int, kind int, pack binary").unionByName(own).repartition(n, "chunk") \
        .sortWithinPartitions("chunk", "words", "kind").mapInArrow(merge, "key binary")


# ------------------------------------------------------------------ tries

def build_trie(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``rows`` (n, k) of symbols, 0 behind a shorter phrase -> alphabet, base, check, state of each row.

    State 0 is the root; the child of s under code c is base[s] + c if check there is s."""
    alphabet = np.unique(rows[rows != 0])
    codes = np.where(rows != 0, np.searchsorted(alphabet, rows) + 1, 0)
    order = np.lexsort(codes.T[::-1])
    codes = codes[order]
    n, width = codes.shape
    # nodes: each place where the prefix of j + 1 words differs from the row before
    node = np.zeros(n, np.int64)
    parents, edges, row_node = [], [], np.zeros(n, np.int64)
    n_nodes, fresh = 1, np.concatenate([[True], np.zeros(n - 1, bool)]) if n else np.zeros(0, bool)
    for j in range(width):
        live = codes[:, j] != 0
        fresh[1:] |= codes[1:, j] != codes[:-1, j]
        new = fresh & live
        ids = n_nodes + np.cumsum(new) - 1
        parents.append(node[new])
        edges.append(codes[new, j])
        node = np.where(live, ids, node)
        row_node = np.where(live, ids, row_node)
        n_nodes += int(new.sum())
    parent, edge = np.concatenate(parents), np.concatenate(edges)  # of node 1, 2, ...
    by = np.argsort(parent, kind="stable")
    inner, begin, size = np.unique(parent[by], return_index=True, return_counts=True)
    width_all = len(alphabet) + 1
    # room for twice the nodes; the largest families first, each at a random place where all its children fit
    end = width_all + 2 * n_nodes + 4 * width_all
    used = np.zeros(end + width_all, bool)
    used[:width_all] = True               # the root's children stand here alone, so every other base is 0 or more
    at = np.zeros(n_nodes, np.int64)      # slot of each node
    base_of = np.zeros(n_nodes, np.int64)
    rnd = np.random.default_rng(0)
    for i in np.argsort(-size, kind="stable"):
        kids, c = by[begin[i]:begin[i] + size[i]] + 1, edge[by[begin[i]:begin[i] + size[i]]]
        if inner[i] == 0:
            at[kids] = c
            continue
        if size[i] == 1:
            break
        rel, slot = c - c[0], -1
        for _ in range(64):
            tries = rnd.integers(width_all, len(used), min(256, (1 << 20) // len(rel) + 1))
            tries = tries[tries + rel[-1] < len(used)]
            fits = tries[~used[tries[:, None] + rel].any(1)]
            if len(fits):
                slot = int(fits[0])
                break
        if slot < 0:
            slot = len(used)
            used = np.concatenate([used, np.zeros(int(rel[-1]) + 1, bool)])
        used[slot + rel] = True
        at[kids], base_of[inner[i]] = slot + rel, slot - c[0]
    end = len(used)
    single = np.flatnonzero((size == 1) & (inner != 0))
    free = np.flatnonzero(~used[:end])
    free = np.concatenate([free, np.arange(end, end + len(single))])[:len(single)]
    kids, c = by[begin[single]] + 1, edge[by[begin[single]]]
    at[kids], base_of[inner[single]] = free, free - c
    total = int(at.max(initial=0)) + width_all + 1
    base, check = np.zeros(total, np.int32), np.full(total, -1, np.int32)
    base[at] = base_of
    check[at[1:]] = at[parent]
    state = np.empty(n, np.int64)
    state[order] = at[row_node]
    # a leaf must lead nowhere: its base 0 leads to the root's children, whose check is the root
    return alphabet, base, check, state


def reached(sym: np.ndarray, trie, max_words: int, at: np.ndarray) -> np.ndarray:
    """The states of two words and more that are reached from the positions ``at``."""
    alphabet, base, check = trie
    state = np.zeros(len(at), np.int32)
    found = [state[:0]]
    for depth in range(max_words if len(alphabet) else 0):
        inside = at + depth < len(sym)
        at, state = at[inside], state[inside]
        now = sym[at + depth]
        code = np.searchsorted(alphabet, now)
        code[code == len(alphabet)] = 0
        known = alphabet[code] == now
        at, state, code = at[known], state[known], code[known]
        to = base[state] + code + 1
        good = check[to] == state
        at, state = at[good], to[good].astype(np.int32)
        if depth:
            found.append(state)
    return np.concatenate(found)


def advance(sym: np.ndarray, trie, max_words: int, counts: np.ndarray) -> None:
    """Adds to ``counts`` how often each state of two words and more is reached from any position."""
    counts += np.bincount(reached(sym, trie, max_words, np.flatnonzero(sym)), minlength=len(counts))


def _tries(candidates: DataFrame, block_phrases: int, max_words: int) -> DataFrame:
    """``block, alphabet, base, check, states, keys``: a trie, and the accepting state of each phrase of the block."""
    def lay(key, table):
        raw = table.column("key").combine_chunks().to_pylist()
        rows = np.zeros((len(raw), max_words), np.uint64)
        sizes = np.array([len(x) // 8 for x in raw])
        rows[np.arange(max_words) < sizes[:, None]] = np.frombuffer(b"".join(raw), "<u8")
        alphabet, base, check, state = build_trie(rows)
        packed = [pa.array([x.tobytes()], pa.binary()) for x in (alphabet, base, check, state.astype(np.int32))]
        return pa.table([pa.array([key[0].as_py()]), *packed, pa.array([raw], pa.list_(pa.binary()))],
                        names=["block", "alphabet", "base", "check", "states", "keys"])

    blocks = numbered(candidates, "key").select("key", F.floor(F.col("rank") / block_phrases).cast("long").alias("block"))
    return cut(blocks.groupBy("block").applyInArrow(lay, "block long, alphabet binary, base binary, check binary, states binary, keys array<binary>"), "phrase-tries")


def _state_sums(codes: DataFrame, tries, pairs, max_words: int) -> DataFrame:
    """``block, place, a``: the count of the phrase at each place of a block. Tasks send the counts over 0 of ``SUM_PHRASES`` places at once."""
    def run(batches):
        counts = [np.zeros(len(states), np.int64) for *_, states in tries.value]
        # the first words of a block's phrases, as the order of its keys has them: big-endian numbers
        firsts = [alphabet[check[1:len(alphabet) + 1] == 0].byteswap() for _, alphabet, _, check, _ in tries.value]
        spans = [(x.min(), x.max()) for x in firsts]
        held = [[] for _ in counts]
        sizes = [0] * len(counts)

        def count(i):
            if sizes[i]:
                check, states = tries.value[i][3:]
                counts[i] += np.bincount(np.concatenate(held[i]), minlength=len(check))[states]
                held[i], sizes[i] = [], 0

        for sym in _arrays(batches):
            _, at, _ = next(_levels(sym, pairs.value, 2))
            first = sym[at].byteswap()
            for i, ((_, *trie, _), (least, most)) in enumerate(zip(tries.value, spans)):
                held[i].append(reached(sym, trie, max_words, at[(first >= least) & (first <= most)]))
                sizes[i] += len(held[i][-1])
                if sizes[i] >= HELD_STATES:  # bincount goes over all states
                    count(i)
        for i in range(len(counts)):
            count(i)
        for (block, *_), n in zip(tries.value, counts):
            place = np.flatnonzero(n)
            parts = np.split(place, np.searchsorted(place, np.arange(SUM_PHRASES, len(n), SUM_PHRASES)))
            parts = [(i, np.concatenate([(x - i * SUM_PHRASES).astype("<u4"), n[x].view("<u4")]).tobytes()) for i, x in enumerate(parts) if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(parts), pa.int64()), pa.array([i * SUM_PHRASES for i, _ in parts], pa.int64()),
                                              pa.array([x for _, x in parts], pa.binary())], ["block", "first", "counts"])

    def add_all(batches):
        """Rows sorted by block and first: the counts of one stretch follow each other."""
        now, total = None, np.zeros(SUM_PHRASES, np.int64)
        for b in batches:
            for block, first, x in zip(*(c.to_pylist() for c in b.columns)):
                if now != (block, first):
                    if now is not None:
                        yield summed(now, total)
                    now = (block, first)
                    total[:] = 0
                x = np.frombuffer(x, "<u4")
                total[x[:len(x) // 3]] += x[len(x) // 3:].copy().view(np.int64)  # a place is once in a row
        if now is not None:
            yield summed(now, total)

    def summed(now, total):
        place = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(place), now[0], np.int64)), pa.array(now[1] + place), pa.array(total[place])], ["block", "place", "a"])

    n = partitions(codes.sparkSession)
    return codes.mapInArrow(run, "block long, first long, counts binary").repartition(n, "block", "first") \
        .sortWithinPartitions("block", "first").mapInArrow(add_all, "block long, place long, a long")


def exact_counts(spark: SparkSession, codes: DataFrame, candidates: DataFrame, pairs, max_words: int, block_phrases: int) -> DataFrame:
    """``key, a`` of every candidate: one pass over the symbols for each ``BLOCKS_A_PASS`` blocks. ``pairs``: the bitmaps of
    words and of pairs of words; a candidate begins with a heavy pair."""
    tries = _tries(candidates, block_phrases, max_words)
    ids = sorted(r.block for r in tries.select("block").collect())  # one number per block
    found = spark.createDataFrame([], "key binary, a long")
    for i in range(0, len(ids), BLOCKS_A_PASS):
        now = tries.where(F.col("block").isin(ids[i:i + BLOCKS_A_PASS]))
        shared = spark.sparkContext.broadcast([(r.block, np.frombuffer(r.alphabet, np.uint64), *(np.frombuffer(x, np.int32) for x in (r.base, r.check, r.states)))
                                               for r in now.select("block", "alphabet", "base", "check", "states").toLocalIterator()])
        places = now.select("block", F.posexplode("keys").alias("place", "key"))
        found = found.unionByName(cut(places.join(_state_sums(codes, shared, pairs, max_words), ["block", "place"]).select("key", "a"), "phrase-counts"))
        shared.unpersist()
    return found


# ------------------------------------------------------------------ the operator

@contextmanager
def _setting(spark: SparkSession, name: str, value):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def small_batches(spark: SparkSession):
    """Arrow batches of about BATCH_BYTES for what runs inside: by default one may hold 64 MB, for each task and each way."""
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def _sub(key: str, start, words) -> F.Column:
    """``words`` words of a key from word ``start`` (0 first)."""
    return F.substring(F.col(key), start * 8 + 1, words * 8)


def mine_phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, block_phrases: int = BLOCK_PHRASES, bucket_bits: int = BUCKET_BITS,
                 seed: int = 1, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of the phrases of 2 to ``max_words`` words found ``min_count`` times or more in their
    language that no longer such phrase covers with as many occurrences.

    A null text has no words, a null language is ``und``; every row counts, repeated or not; other columns are not
    read. An empty table gives no phrases."""
    spark = docs.sparkSession
    with small_batches(spark):
        while True:
            with _setting(spark, "spark.sql.parquet.compression.codec", "zstd"):  # symbols take a third of what snappy leaves
                coded = cut(encode(docs, seed, text_col, lang_col), "phrase-codes")
            words = cut(coded.where("sym is not null").groupBy("sym", "lang", "word").agg(F.sum("n").alias("n")), "phrase-words")
            if not words.groupBy("sym").count().where("count > 1").take(1):
                break
            seed += 1
        codes = coded.where("codes is not null").select("codes")
        frequent = cut(words.where(F.col("n") >= min_count), "phrase-frequent")

        bits = min(bucket_bits + FINER_BITS, CHUNK_BITS + 32)

        def word_buckets(batches):
            for b in batches:
                sym = np.frombuffer(b"".join(b.column(0).to_pylist()), "<u8")
                yield _packs(*np.unique(_bucket(mix(sym), bits), return_counts=True), bits)

        bitmaps = [_marked(_heavy_buckets(frequent.select("sym").mapInArrow(word_buckets, "chunk int, pack binary"), 1, bits, bucket_bits), bucket_bits)]
        heavy = [spark.createDataFrame([], "chunk int, words int, heavy binary")]
        for k in range(2, max_words + 1):
            maps = spark.sparkContext.broadcast(bitmaps)
            now = cut(_heavy_buckets(_bucket_counts(codes, maps, k, bits), min_count, bits, bucket_bits), "phrase-buckets")
            heavy.append(now.select("chunk", F.lit(k).alias("words"), "heavy"))
            bitmaps = [*bitmaps, _marked(now, bucket_bits)]
            maps.unpersist()
        maps = spark.sparkContext.broadcast(bitmaps)
        candidates = cut(_phrases(codes, maps, reduce(DataFrame.unionByName, heavy), max_words, bits), "phrase-candidates")
        maps.unpersist()
        pairs = spark.sparkContext.broadcast(bitmaps[:2])
        counted = exact_counts(spark, codes, candidates, pairs, max_words, block_phrases)
        found = cut(counted.where(F.col("a") >= min_count), "phrase-found")
    return _scored(found, words, frequent)


def _scored(found: DataFrame, words: DataFrame, frequent: DataFrame) -> DataFrame:
    size = (F.octet_length("key") / 8).cast("int")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    single = frequent.select(F.col("sym").alias("part"), F.col("n").alias("f"))
    known = found.select(F.col("key").alias("part"), F.col("a").alias("f")).unionByName(single)

    # a phrase is dropped when a longer one around it is as frequent
    spans = found.select("key", "a", size.alias("k")).where("k > 2").select("key", "a", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 2)).alias("i")) \
        .select("key", "a", "k", "i", F.explode(F.sequence(F.lit(2), F.col("k") - F.col("i"))).alias("m")).where("m < k")
    around = spans.select(_sub("key", F.col("i"), F.col("m")).alias("part"), "a").groupBy("part").agg(F.max("a").alias("most"))
    kept = found.join(around, found["key"] == around["part"], "left").where("most is null or most < a").select("key", "a")

    first = frequent.select(F.col("sym").alias("_s"), "lang")
    rows = kept.join(first, _sub("key", F.lit(0), F.lit(1)) == F.col("_s")).drop("_s").join(totals, "lang")
    cuts = rows.select("key", "a", "lang", "n", size.alias("size"), F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    cuts = cuts.withColumn("lp", _sub("key", F.lit(0), F.col("cut"))).withColumn("rp", _sub("key", F.col("cut"), F.col("size") - F.col("cut")))
    cuts = cuts.join(known.select(F.col("part").alias("lp"), F.col("f").alias("l")), "lp").join(known.select(F.col("part").alias("rp"), F.col("f").alias("r")), "rp")
    # the products pass 64 bits
    scores = cuts.withColumn("score", F.expr("cast(1000 as decimal(4,0)) * "
                                            "cast(a as decimal(16,0)) * cast(n as decimal(16,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    best = scores.groupBy("key").agg(F.min_by(F.struct("lang", "a", "l", "r", "n", "score"), F.struct("score", "cut")).alias("b")).select("key", "b.*")

    spelled = best.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.substring(F.col("key"), i * 8 + 1, F.lit(8)))).alias("i", "sym")) \
        .join(frequent.select("sym", "word"), "sym").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    return best.join(spelled, "key").select("lang", "phrase", "a", "l", "r", "n", "score")


def op13(docs: DataFrame, top: int = TOP) -> DataFrame:
    """The contract's columns: each language's first ``top`` phrases."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = mine_phrases(docs.select("text", "lang")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
