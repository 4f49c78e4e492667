"""BPE encoding and decoding by forced-boundary splitting.

A pair of neighbouring byte symbols that occurs inside no token of the vocabulary can never be merged
across, so it marks a certain cut. A word's fragments between cuts are encoded on their own (each
distinct fragment once, in a bounded cache) and concatenated. Texts are taken apart into distinct
words per Arrow slice; ids are then laid out by index arithmetic, without a Python step per word.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import PieceCache, flat, ranges, slices, unique_words

# fixed values of the tokenizer's pipeline: white space, and the pattern that finds words in lower-cased text
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
BLANKS = "\t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CACHE_ENTRIES = 150_000
SHORT = 48
NEVER = 1 << 40


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def lower(text: str) -> str:
    """Lower case code point by code point, so a final capital sigma is no special case."""
    return text.lower() if "Σ" not in text else "".join(map(str.lower, text))


class WordBpe:
    """The tokenizer of one vocabulary file with word ends; built once per Python worker."""

    loaded: dict[str, "WordBpe"] = {}

    @classmethod
    def of(cls, path: str) -> "WordBpe":
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.tokens = [""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.added.items():
            self.tokens[i] = token
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        letters = byte_alphabet()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + end] for c in letters]
        pairs = (tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        base = {c: i for c, i in zip(letters, self.inner)}
        ends = {c: i for c, i in zip(letters, self.last)}
        self.together = set()
        for token in vocab:
            body, tail = (token[:-len(end)], ends) if token.endswith(end) and token != end else (token, base)
            symbols = [base[c] for c in body[:-1]] + [tail[body[-1]]] if body else []
            self.together.update(zip(symbols, symbols[1:]))
        keys = np.array([a * len(self.tokens) + b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_rank = keys[order], order.astype(np.int64)
        self.pair_new = np.array([new for _, new in self.merges.values()], np.int64)
        self.pair_keys_together = np.array(sorted(a * len(self.tokens) + b for a, b in self.together), np.int64)
        self.cache = PieceCache(CACHE_ENTRIES)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * len(self.tokens) + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], NEVER)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and the number of each: cut at forced boundaries,
        encode all fragments in step, concatenate."""
        raw, off = flat(pa.array(words, pa.large_string()))
        symbols = np.array(self.inner, np.int64)[raw]
        symbols[off[1:] - 1] = np.array(self.last, np.int64)[raw[off[1:] - 1]]
        key = symbols[:-1] * len(self.tokens) + symbols[1:]
        at = np.minimum(np.searchsorted(self.pair_keys_together, key), len(self.pair_keys_together) - 1)
        begins = np.concatenate([[True], self.pair_keys_together[at] != key])
        begins[off[:-1]] = True
        first = np.flatnonzero(begins)
        length = np.diff(np.append(first, len(symbols)))
        home = np.repeat(np.arange(len(words)), np.diff(off))  # the word of each symbol
        kept = np.ones(len(symbols), bool)
        for i in np.flatnonzero(length > SHORT):
            got = self.merge_long(symbols[first[i]:first[i] + length[i]].tolist())
            symbols[first[i]:first[i] + len(got)] = got
            kept[first[i] + len(got):first[i] + length[i]] = False
        short = (length <= SHORT) & (length > 1)
        place = ranges(first[short], length[short])
        merged, alive = self.merge_in_step(symbols[place], length[short])
        symbols[place], kept[place] = merged, alive
        return symbols[kept], np.bincount(home[kept], minlength=len(words))

    def merge_in_step(self, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all fragments at once, one step of each per round: its lowest rank, from the left.

        Returns the symbols in place and which places are left."""
        out, alive = symbols.copy(), np.ones(len(symbols), bool)
        place, fragment = np.arange(len(symbols)), np.repeat(np.arange(len(length)), length)
        while len(place) > 1:
            now = out[place]
            rank = np.where(fragment[:-1] == fragment[1:], self.ranks(now[:-1], now[1:]), NEVER)
            rank = np.append(rank, NEVER)
            starts = np.flatnonzero(np.concatenate([[True], fragment[1:] != fragment[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            going = best < NEVER
            if not going.any():
                break
            span = np.diff(np.append(starts, len(place)))
            take = (rank == np.repeat(best, span)) & (rank < NEVER)
            # of overlapping places (x x x) every other one, from the left
            at = np.arange(len(take))
            before = np.maximum.accumulate(np.where(take, -1, at))
            take &= (at - before) % 2 == 1
            hit = np.flatnonzero(take)
            out[place[hit]] = self.pair_new[rank[hit]]
            alive[place[hit + 1]] = False
            left = np.repeat(going, span)
            left[hit + 1] = False
            place, fragment = place[left], fragment[left]
        return out, alive

    def merge_long(self, symbols) -> list[int]:
        """The same order with a heap over a linked list: n log n steps for a long fragment."""
        ids, merges = list(symbols), self.merges
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(m[0], i, p, m[1]) for i, p in enumerate(zip(ids, ids[1:])) if (m := merges.get(p))]
        heapq.heapify(heap)
        while heap:
            _, i, pair, new = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b >= 0 and (m := merges.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (m[0], a, (ids[a], ids[b]), m[1]))
        return [x for x in ids if x >= 0]

    def pieces(self, part: str) -> list[str]:
        """The words of normalised text without white space."""
        if part.isalpha():
            return [part]
        if part[-1:] in ".,;:" and part[:-1].isalpha():
            return [part[:-1], part[-1]]
        return WORDS.findall(part)

    def normal(self, text: str) -> str:
        """Normalised text; white space as blanks, whose number doesn't matter."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        for c in BLANKS:
            if c in text:
                text = text.replace(c, " ")
        return lower(text)

    def encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words, index, n_words = unique_words(pa.array(map(self.normal, texts), pa.large_string()))
        return self.cache.lay_out([self.pieces(w) for w in words], index, n_words, self.encode_words)

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other (uint32), and how many each text has. Added tokens in a
        text are found first; what stands between them is encoded as texts of its own."""
        texts = [t or "" for t in texts]
        if not (self.split_added and any(map(self.split_added.search, texts))):
            return self.encode_plain(texts)
        parts = [self.split_added.split(t) for t in texts]
        ids, counts = self.encode_plain(["" if p in self.added else p for t in parts for p in t])
        cuts = np.split(ids, np.cumsum(counts)[:-1])
        cuts = [np.array([self.added[p]], np.uint32) if p in self.added else c for p, c in zip((p for t in parts for p in t), cuts)]
        border = np.cumsum([0, *map(len, parts)])
        sizes = [sum(map(len, cuts[a:b])) for a, b in zip(border, border[1:])]
        return np.concatenate(cuts), np.array(sizes, np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by a space, special ones included."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


def _rows(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, fields: list[T.StructField], make) -> DataFrame:
    def run(batches):
        codec = WordBpe.of(vocabulary)
        for b in slices(batches, text_col):
            ids, counts = codec.encode_all(b.column(1).to_pylist())
            border = np.concatenate([[0], np.cumsum(counts)])
            yield pa.RecordBatch.from_arrays([b.column(0), *make(codec, ids, border)], [id_col, *(f.name for f in fields)])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([docs.schema[id_col], *fields]))


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the array of token ids of every whole text, row for row; null and empty texts have none."""
    def make(codec, ids, border):
        return [pa.ListArray.from_arrays(pa.array(border.astype(np.int32)), pa.array(ids.astype(np.int32)))]

    return _rows(docs, vocabulary, id_col, text_col, [T.StructField("ids", T.ArrayType(T.IntegerType()))], make)


def decode_documents(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id") -> DataFrame:
    """id and the decoded text of each array of ids."""
    def run(batches):
        codec = WordBpe.of(vocabulary)
        for b in batches:
            texts = [codec.decode(np.array(x or [], np.uint32)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, T.StructType([encoded.schema[id_col], T.StructField("text", T.StringType())]))


def token_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 without moving ids or decoded texts out of the tasks."""
    def make(codec, ids, border):
        each = [ids[a:b] for a, b in zip(border[:-1], border[1:])]
        return [pa.array(np.diff(border)), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each], pa.string()),
                pa.array([hashlib.sha256(codec.decode(x).encode()).hexdigest() for x in each], pa.string())]

    text = T.StringType()
    return _rows(docs, vocabulary, id_col, text_col, [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", text),
                                                      T.StructField("decoded_sha256", text)], make)


def op10(docs: DataFrame, vocabulary: str) -> DataFrame:
    return token_digests(docs, vocabulary)
