"""Word shingles of whole texts as 64-bit hashes, without a Python step per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import M1, M3, flat, mix, span_hashes, words64

# fixed values: the six ASCII white space characters, and A-Z to a-z
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lower-cased) of all texts in order, and how many words each text has."""
    buf, off = flat(texts)
    n = len(buf)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    padded = np.concatenate([LOWER[buf], np.zeros(16, np.uint8)])
    inside = ~BLANK[buf]
    border = np.zeros(n + 1, bool)
    border[off] = True
    starts = np.flatnonzero(inside & (border[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (border[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    counts = np.diff(np.searchsorted(starts, off))
    return span_hashes(words64(padded), starts, ends - starts), counts


def shingles(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, times) of the distinct shingles of each text, sorted by both.

    A text of fewer words than ``size`` has one shingle, all its words; one without words has none."""
    words, counts = word_hashes(texts)
    begin = np.cumsum(counts) - counts
    n = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    doc = np.repeat(np.arange(len(counts)), n)
    first = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
    end = np.repeat(begin + counts, n)
    h = np.zeros(len(doc), np.uint64)
    for k in range(size):
        at = first + k
        word = words[np.minimum(at, len(words) - 1)] if len(words) else h
        h = np.where(at < end, mix((h ^ word) * M1 + M3), h)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(doc) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(doc)))
