"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

An item of L characters within k edits of a stretch of text shares at least L - q + 1 - k q of its q-grams
with it, on diagonals (place in the text minus place in the item) at most k apart. Per slice of texts, all
positions are looked up in the items' q-grams at once; hits are counted per (text, item, band) where bands
are 2 (k + 1) diagonals wide and start every k + 1, so any k + 1 neighbouring diagonals lie in one band.
Within a band each place of the item counts once. Bands that reach the bound, for shorter grams too, are verified by banded alignment of the whole
item, many candidates in step. Texts and items are compared with A-Z lower-cased and each run of ASCII white space as one blank.
Items of fewer than ``Q`` characters, which have no q-gram, are found by exact match between word borders.

Memory is bounded whatever the texts hold: texts are searched in windows that overlap by an item's length and its edits, hits are
counted per (window, item) in parts of at most ``HITS``, and only the pairs that reach the bound are looked at by band.

The items go to the tasks in blocks of at most ``BLOCK_BYTES`` of item text, so what is broadcast has a
bound whatever the benchmark's size; each block is one pass over the documents, and the rows are written
after every ``BLOCKS_A_PASS`` of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import EMPTY, M1, cut, flat, ranges, slices, words64
from .shingles import BLANK, LOWER

Q, FINE = 8, 4
EDIT_RATE = 0.1
BLOCK_BYTES = 4 << 20
BLOCKS_A_PASS = 8
FILTER_BITS = 22
WINDOW = 1 << 14
HITS = 1 << 20
ALIGN_ROWS = 2000


def normal(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the normalised texts, one after the other, and the n + 1 offsets."""
    buf, off = flat(texts)
    blank = BLANK[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[off] = True
    keep = ~blank | ~np.concatenate([[False], blank[:-1]]) | first[:-1] if len(buf) else np.zeros(0, bool)
    out = np.where(blank, np.uint8(32), LOWER[buf])[keep]
    return out, np.concatenate([[0], np.cumsum(keep)])[off]


# what can stand inside a word, as bytes: letters, digits, and all beyond ASCII
WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


class Items:
    """The q-grams of a block of benchmark items."""

    def __init__(self, ids: list, texts: list[str | None]):
        buf, off = normal(pa.array(texts, pa.large_string()))
        size = np.diff(off)
        use = np.flatnonzero(size >= Q)
        few = [i for i in np.flatnonzero((size > 0) & (size < Q)) if (buf[off[i]:off[i + 1]] != 32).any()]
        self.short_ids = [ids[i] for i in few]
        self.short = [buf[off[i]:off[i + 1]].tobytes().strip(b" ") for i in few]
        self.ids = [ids[i] for i in use]
        self.size = size[use]
        self.chars = [buf[off[i]:off[i] + size[i]] for i in use]
        # as many edits as the rate allows and the lemma can see
        self.edits = np.minimum((self.size * EDIT_RATE).astype(np.int64), (self.size - Q) // Q)
        self.least = self.size - Q + 1 - self.edits * Q
        grams = words64(np.concatenate([buf, np.zeros(8, np.uint8)]))
        n = self.size - Q + 1
        item = np.repeat(np.arange(len(use)), n)
        place = ranges(np.zeros(len(use), np.int64), n)
        gram = grams[off[use][item] + place] if len(use) else np.zeros(0, np.uint64)
        order = np.argsort(gram, kind="stable")
        self.gram, self.item, self.place = gram[order], item[order], place[order]
        self.keys, self.first = np.unique(self.gram, return_index=True)
        self.count = np.diff(np.append(self.first, len(self.gram)))
        # more than the bands and places of any window
        longest = int(self.size.max(initial=Q))
        self._places, self._span = longest + 1, max(WINDOW, 4 * (2 * longest + Q)) + 4 * longest + 64
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self._slot(self.keys)] = True

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return (grams * M1) >> np.uint64(64 - FILTER_BITS)

    def _windows(self, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, begin and end of the windows: every stretch that an item can match lies in one of them."""
        lap = int((self.size + self.edits).max()) + Q
        step = max(WINDOW, 4 * lap)
        size = np.diff(off)
        n = np.maximum(1, -(-(size - lap) // step))
        text = np.repeat(np.arange(len(size)), n)
        begin = off[text] + ranges(np.zeros(len(n), np.int64), n) * step
        return text, begin, np.minimum(begin + step + lap, off[text + 1])

    def candidates(self, buf: np.ndarray, off: np.ndarray):
        """Parts of (text, item, first diagonal, from the start of the slice) of the bands that meet the bound."""
        if not len(self.keys) or not len(buf):
            return
        grams = words64(np.concatenate([buf, np.zeros(8, np.uint8)]))
        at = np.flatnonzero(self.filter[self._slot(grams)])
        gram = grams[at]
        key = np.minimum(np.searchsorted(self.keys, gram), len(self.keys) - 1)
        text = np.searchsorted(off, at, "right") - 1
        real = (self.keys[key] == gram) & (at + Q <= off[text + 1])
        at, key = at[real], key[real]
        window_text, begin, end = self._windows(off)
        # the hits of each window are a run; windows are taken together while their hits fit
        first, last = np.searchsorted(at, begin), np.searchsorted(at, end - Q, "right")
        total = np.concatenate([[0], np.cumsum(self.count[key])])
        hits = total[np.maximum(first, last)] - total[first]
        full = np.flatnonzero(hits)
        groups = np.cumsum(hits[full]) // HITS
        for part in np.split(full, np.flatnonzero(np.diff(groups)) + 1) if len(full) else ():
            for w, item, diagonal in self._bands(at, key, first[part], last[part], begin[part]):
                yield window_text[part][w], item, diagonal

    def _expanded(self, at, key, first, last, wanted=None):
        """(window, item, diagonal, place in the item) of all hits, at most about ``HITS`` at a time."""
        n = last - first
        where, window = ranges(first, n), np.repeat(np.arange(len(n)), n)
        each = self.count[key[where]]
        for p in np.split(np.arange(len(where)), np.flatnonzero(np.diff(np.cumsum(each) // HITS)) + 1):
            hit = ranges(self.first[key[where[p]]], each[p])
            item, place, w = self.item[hit], self.place[hit], np.repeat(window[p], each[p])
            diagonal = np.repeat(at[where[p]], each[p]) - place
            if wanted is not None:
                good = np.isin(w * len(self.ids) + item, wanted)
                item, place, w, diagonal = item[good], place[good], w[good], diagonal[good]
            yield w, item, diagonal, place

    def _bands(self, at, key, first, last, begin):
        """(window, item, first diagonal) of the bands that meet the bound in the given windows."""
        # by window and item only, which is cheap and keeps little
        pairs, n = EMPTY, EMPTY
        for w, item, _, _ in self._expanded(at, key, first, last):
            found, back = np.unique(np.concatenate([pairs, w * len(self.ids) + item]), return_inverse=True)
            n = np.bincount(back, np.concatenate([n, np.ones(len(w), np.int64)]), len(found)).astype(np.int64)
            pairs = found
        enough = n >= self.least[pairs % len(self.ids)] if len(pairs) else np.zeros(0, bool)
        pairs, n = pairs[enough], n[enough]
        if not len(pairs):
            return
        for some in np.split(pairs, np.flatnonzero(np.diff(np.cumsum(n) // HITS)) + 1):
            bands = EMPTY
            for w, item, diagonal, place in self._expanded(at, key, first, last, some):
                step = self.edits[item] + 1
                low = begin[w] - int(self.size.max())
                band = (diagonal - low) // step
                one = np.concatenate([band, band - 1]) + 1
                pair = np.searchsorted(some, np.concatenate([w, w]) * len(self.ids) + np.concatenate([item, item]))
                bands = np.unique(np.concatenate([bands, (pair * self._span + one) * self._places + np.concatenate([place, place])]))
            found, n_places = np.unique(bands // self._places, return_counts=True)
            pair, one = some[found // self._span], found % self._span
            w, item = pair // len(self.ids), pair % len(self.ids)
            good = n_places >= self.least[item]
            w, item, one = w[good], item[good], one[good]
            yield w, item, (one - 1) * (self.edits[item] + 1) + begin[w] - int(self.size.max())

    def dense(self, buf: np.ndarray, off: np.ndarray, text: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        """Whether the lemma holds in a band for the item's ``FINE``-grams too: a passage that many items share meets the bound of the
        longer grams, not this one. Much cheaper than an alignment."""
        rows, width = int(self.size[item].max()) - FINE + 1, int(2 * (self.edits[item].max() + 1))
        gram = np.full((len(item), rows), 0xFFFFFFFE, np.uint32)  # no text holds such bytes
        for r, i in enumerate(item.tolist()):
            x = self.chars[i]
            gram[r, :len(x) - FINE + 1] = np.ndarray((len(x) - FINE + 1,), "<u4", np.ascontiguousarray(x), strides=(1,))
        # places beyond the text's ends may match by chance; the alignment sees to them
        pad = np.full(rows + width, 255, np.uint8)
        padded = np.concatenate([pad, buf, pad, pad])
        here = np.ndarray((len(padded) - FINE + 1,), "<u4", padded, strides=(1,)).copy()
        at = np.maximum(diagonal + len(pad), 0)[:, None] + np.arange(rows)
        seen = np.zeros(gram.shape, bool)
        for j in range(width):
            seen |= here[j:][at] == gram
        return seen.sum(1) >= self.size[item] - FINE + 1 - FINE * self.edits[item]

    def align(self, buf: np.ndarray, off: np.ndarray, text: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edit distance of each whole item to the best stretch inside its band, and that stretch's end.

        Column c of row i stands for the text's place diagonal - k + c + i; a place outside the text
        matches nothing and can't be passed."""
        k = self.edits[item]
        width = int((2 * (k + 1) + 2 * k).max()) + 1
        rows = int(self.size[item].max())
        chars = np.zeros((len(item), rows), np.int16)
        for r, i in enumerate(item.tolist()):
            chars[r, :self.size[i]] = self.chars[i]
        column = np.arange(width)
        base = (diagonal - k)[:, None] + column
        begin, end = off[text][:, None], off[text + 1][:, None]
        far = 1 << 20
        cost = np.where((base >= begin) & (base <= end), 0, far)
        best, stop = np.full(len(item), far), np.zeros(len(item), np.int64)
        for i in range(1, rows + 1):
            place = base + i - 1  # the text's character that the diagonal step reads
            inside = (place >= begin) & (place < end)
            same = np.zeros(cost.shape, bool)
            same[inside] = (buf[place[inside]] == np.broadcast_to(chars[:, i - 1:i], cost.shape)[inside])
            step = np.where(inside, cost + ~same, far)
            skip = np.concatenate([cost[:, 1:], np.full((len(item), 1), far)], axis=1) + 1
            now = np.minimum(step, skip)
            now = np.minimum.accumulate(now - column, axis=1) + column  # characters of the text left out
            cost = np.where((base + i >= begin) & (base + i <= end), now, far)
            done = np.flatnonzero(self.size[item] == i)
            if len(done):
                c = cost[done].argmin(1)
                best[done], stop[done] = cost[done, c], base[done, c] + i
        return best, stop

    def matches(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, edits) of the items that some stretch of a text holds within the budget."""
        buf, off = normal(texts)
        found = [EMPTY], [EMPTY], [EMPTY]
        for text, item, diagonal in self.candidates(buf, off):
            rows = max(16, min(ALIGN_ROWS, HITS // int(self.size.max())))
            for at in range(0, len(text), rows):
                t, i, d = text[at:at + rows], item[at:at + rows], diagonal[at:at + rows]
                near = self.dense(buf, off, t, i, d)
                t, i, d = t[near], i[near], d[near]
                if not len(t):
                    continue
                best, _ = self.align(buf, off, t, i, d)
                good = best <= self.edits[i]
                for column, x in zip(found, (t[good], i[good], best[good])):
                    column.append(x)
        text, item, best = map(np.concatenate, found)
        order = np.lexsort((best, item, text))
        text, item, best = text[order], item[order], best[order]
        new = np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])]) if len(text) else np.zeros(0, bool)
        return text[new], item[new], best[new]

    def short_matches(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, short item) where the item stands between word borders."""
        buf, off = normal(texts)
        if not self.short or not len(buf):
            return EMPTY, EMPTY
        grams = words64(np.concatenate([buf, np.zeros(8, np.uint8)]))
        border = np.ones(len(buf) + 1, bool)
        border[:-1] &= ~WORD[buf]                    # no word goes on here
        ends = border.copy()
        ends[off] = True
        begins = np.concatenate([[True], ~WORD[buf]])
        begins[off] = True
        text, item = [EMPTY], [EMPTY]
        for size in sorted({len(x) for x in self.short}):
            which = [i for i, x in enumerate(self.short) if len(x) == size]
            keys = np.array([int.from_bytes(self.short[i], "little") for i in which], np.uint64)
            at = np.flatnonzero(begins[:-1])
            at = at[at + size <= len(buf)]
            at = at[ends[at + size]]
            gram = grams[at] & np.uint64((1 << 8 * size) - 1)
            for k, i in zip(keys, which):
                hit = at[gram == k]
                t = np.searchsorted(off, hit, "right") - 1
                t = np.unique(t[hit + size <= off[t + 1]])  # not across the end of its text
                text.append(t)
                item.append(np.full(len(t), i))
        return np.concatenate(text), np.concatenate(item)


def blocks(benchmark: DataFrame, item_id: str, item_text: str):
    """The benchmark's items, read in order of their id, in blocks of at most ``BLOCK_BYTES`` (one at least)."""
    held, size = [], 0
    for r in benchmark.select(item_id, item_text).orderBy(item_id, item_text).toLocalIterator():
        n = len((r[1] or "").encode())
        if held and size + n > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append((r[0], r[1]))
        size += n
    if held:
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
          item_text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` plus _items (ids found in the text, ascending) and _edits (of each).

    Null and empty texts hold nothing; null and blank items are never found; items of fewer than ``Q`` characters are found where
    they stand alone; items with equal texts are all named, repeated rows of the benchmark as often; rows with equal ids are
    searched each by itself; an empty benchmark finds nothing and an empty table gives no rows."""
    spark = docs.sparkSession
    kind = benchmark.schema[item_id].dataType
    fields = [T.StructField("_items", T.ArrayType(kind)), T.StructField("_edits", T.ArrayType(T.LongType()))]
    out = docs.withColumn("_items", F.array().cast(fields[0].dataType)).withColumn("_edits", F.array().cast(fields[1].dataType))
    for i, block in enumerate(blocks(benchmark, item_id, item_text)):
        if i and i % BLOCKS_A_PASS == 0:
            out = cut(out, "leaks")
        sent = spark.sparkContext.broadcast(block)
        built: list = []

        def run(batches, sent=sent, built=built):
            if not built:
                built.append(Items([i for i, _ in sent.value], [t for _, t in sent.value]))
            items = built[0]
            for b in slices(batches, text_col):
                texts = b.column(b.schema.get_field_index(text_col))
                old = [c.to_pylist() for c in b.columns[-2:]]
                text, item, edits = items.matches(texts)
                found = [(t, items.ids[i], e) for t, i, e in zip(text.tolist(), item.tolist(), edits.tolist())]
                text, item = items.short_matches(texts)
                found += [(t, items.short_ids[i], 0) for t, i in zip(text.tolist(), item.tolist())]
                for t, i, e in sorted(found, key=lambda x: (x[1] is None, x[1])):
                    old[0][t].append(i)
                    old[1][t].append(e)
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], *(pa.array(x, c.type) for x, c in zip(old, b.columns[-2:]))], b.schema.names)

        out = out.mapInArrow(run, out.schema)
    return out


def op9(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = leaks(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", F.size("_items").cast("long").alias("n_items"), F.col("_items").alias("items"), F.col("_edits").alias("edits"))


def keep_unleaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, unchanged."""
    return leaks(docs, benchmark).where(F.size("_items") == 0).drop("_items", "_edits")
