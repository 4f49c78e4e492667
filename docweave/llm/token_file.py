"""Token-id files: canonical length-limited Huffman codes, decoded by table in independent blocks.

Texts are encoded in the scan tasks with the tokenizers library (parts that a worker hasn't met only), the
ids are counted over the whole corpus, and package-merge gives the best code lengths up to
``MAX_BITS``. Rows are then range partitioned by document id, and each partition becomes one file of
blocks. A block stands alone: header, document ids and sizes, the bit offset of every
``EVERY``-th symbol, and the bits. Decoding looks up ``MAX_BITS`` bits in one table and runs from all
checkpoints of a block in step. Files are written and read by Spark, so any store it knows will do.
"""

from __future__ import annotations

import os
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .bpe import byte_alphabet
from .common import PieceCache, flat, partitions, ranges, slices

MAX_BITS = 18
EVERY = 512
BLOCK_SYMBOLS = 1 << 20
MAGIC = b"HUF1"
CACHE_ENTRIES = 1_200_000  # about 200 MB of a worker
CACHE_CHARACTERS = 16 * CACHE_ENTRIES
PIECE_ENTRIES = 100_000
JOINED = 128
SLICE = 8 << 20
COUNTED_ROWS = 256

# a blank inside or at the end of a run of white space is no certain piece border
SPACE = r"[\s\v\x1c-\x1f\x{85}\p{Z}]"
ODD = rf"{SPACE} ({SPACE}|\z)"
# kinds of bytes by which text is cut: letters, digits, signs, \n, blanks; 0 (no cut beside it) is all else, and ' may begin a piece like 's
LETTER, DIGIT, SIGN, LINE, BLANK = range(1, 6)
KINDS = np.zeros(256, np.uint8)
KINDS[33:127], KINDS[48:58], KINDS[10], KINDS[32], KINDS[39] = SIGN, DIGIT, LINE, BLANK, 0
KINDS[65:91] = KINDS[97:123] = LETTER
KINDS[0xC3:0xCB] = KINDS[0xD0:0xD2] = LETTER  # first bytes of U+00C0 to U+02BF and U+0400 to U+047F, letters but for two
NO_LETTERS = (0xD7, 0xF7)
BORDERS = np.zeros(64, bool)  # by 8 * kind before + kind after
BORDERS[[8 * a + b for a in (LETTER, DIGIT, SIGN, LINE) for b in (LETTER, DIGIT, SIGN, LINE) if a != b]] = True
BORDERS[[8 * a + BLANK for a in range(6)]] = True


class ByteBpe:
    """The library's tokenizer over distinct pieces; built once per Python worker."""

    loaded: dict[str, "ByteBpe"] = {}

    @classmethod
    def of(cls, path: str) -> "ByteBpe":
        if path not in cls.loaded:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        alphabet = byte_alphabet()
        self.table = np.array(list(map(ord, alphabet)), "<u2")
        self.parts, self.cache, self.held = PieceCache(CACHE_ENTRIES), PieceCache(PIECE_ENTRIES), 0
        # no merge crosses the border of a byte and a blank that stand side by side in no token
        model, number = self.tokenizer.model, {c: i for i, c in enumerate(alphabet)}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.begins = np.zeros(max(vocab.values()) + 1, bool)
        self.begins[[i for t, i in vocab.items() if t[:1] == alphabet[32]]] = True
        self.apart = np.ones(256, bool)
        self.apart[[number[a] for t in vocab for a, b in zip(t, t[1:]) if b == alphabet[32] and a in number]] = False
        if model.ignore_merges or model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix:
            self.apart[:] = False

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, given in the letters of bytes, by the library's model."""
        tokenize = self.tokenizer.model.tokenize
        values = [[t.id for t in tokenize(p)] for p in pieces]
        sizes = np.fromiter(map(len, values), np.int64, len(values))
        return np.fromiter(chain.from_iterable(values), np.uint32, int(sizes.sum())), sizes

    def encode_joined(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that are a blank and letters, many in one call of the library's model; a part whose
        last byte may merge with a blank gets none and the size 0."""
        raw = np.frombuffer("".join(parts).encode(), np.uint8)
        starts = np.flatnonzero(raw == 32)
        fine = self.apart[raw[np.append(starts[1:], len(raw)) - 1]]
        raw = raw[np.repeat(fine, np.diff(np.append(starts, len(raw))))]
        shown, at = self.table[raw].tobytes().decode("utf-16-le"), np.flatnonzero(raw == 32)[::JOINED].tolist()
        tokenize, ids = self.tokenizer.model.tokenize, []
        for x, y in zip(at, [*at[1:], len(raw)]):
            ids.extend([t.id for t in tokenize(shown[x:y])])
        values, sizes = np.array(ids, np.uint32), np.zeros(len(parts), np.int64)
        sizes[fine] = np.diff(np.append(np.flatnonzero(self.begins[values]), len(values)))
        return values, sizes

    def encode_parts(self, parts: list[str]) -> None:
        """Put new parts into the cache."""
        words = [p for p in parts if p[0] == " " and p[1:].isalpha()]
        rest = list(set(parts).difference(words))
        if words:
            values, sizes = self.encode_joined(words)
            self.parts.add([p for p, n in zip(words, sizes.tolist()) if n], values, sizes[sizes > 0])
            rest += [words[i] for i in np.flatnonzero(sizes == 0)]
        if rest:
            pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str
            split = [[x for x, _ in pieces(p)] for p in rest]
            self.parts.add(rest, *self.cache.lay_out(split, np.arange(len(rest)), np.ones(len(rest), np.int64), self.encode_pieces))
        self.held += sum(map(len, parts))

    @staticmethod
    def cuts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where parts begin: at the texts' first bytes, at blanks, and where letters, digits, signs and single
        line ends meet. All are certain borders of pieces, so each part has the same ids on its own."""
        kind = KINDS[data]
        lead = np.flatnonzero((data >= 0xC3) & (kind == LETTER))
        kind[lead + 1] = LETTER
        other = lead[np.isin(data[lead].astype(np.int64) << 6 & 0x7FF | data[lead + 1] & 63, NO_LETTERS)]
        kind[other] = kind[other + 1] = 0
        begins = np.concatenate([[False], BORDERS[kind[:-1] << 3 | kind[1:]]])
        # a white space after a line end, or one before it, makes a run, which is not cut
        line = np.flatnonzero(begins[2:] & (kind[1:-1] == LINE) & (kind[2:] != BLANK)) + 2
        begins[line[(kind[line - 2] == 0) | (kind[line - 2] >= LINE)]] = False
        begins[off[:-1][off[1:] > off[:-1]]] = True
        return np.flatnonzero(begins)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, ODD)
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        alone = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        data, off = flat(pc.if_else(odd, "", texts))
        ids, sizes = self.encode_plain(data, off) if len(data) else (np.zeros(0, np.uint32), np.zeros(len(texts), np.int64))
        if not len(alone):
            return ids, sizes
        cuts = np.split(ids, np.cumsum(sizes)[:-1])
        for i in alone.tolist():
            cuts[i] = np.array(self.ids(texts[i].as_py()), np.uint32)
        return np.concatenate(cuts), np.fromiter(map(len, cuts), np.int64, len(cuts))

    def encode_plain(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts given by their bytes, with neither added tokens nor odd white space."""
        begin = self.cuts(data, off)
        coded = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, len(data))), pa.py_buffer(data)).dictionary_encode()
        parts = coded.dictionary
        if (data == 0).any():
            parts = parts.to_pylist()
        else:  # one text to decode in place of many
            whole = pa.LargeListArray.from_arrays(pa.array([0, len(parts)], pa.int64()), parts)
            parts = pc.binary_join(whole, pa.scalar("\0", pa.large_string()))[0].as_py().split("\0")
        if len(self.parts.at) > CACHE_ENTRIES or self.held > CACHE_CHARACTERS:
            self.parts.clear()
            self.held = 0
        known = self.parts.at
        if new := [p for p in parts if p not in known]:
            self.encode_parts(new)
        place = np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))[np.asarray(coded.indices)]
        each = self.parts.size[place]
        ends = np.concatenate([[0], np.cumsum(each)])
        return self.parts.store[ranges(self.parts.start[place], each)], np.diff(ends[np.searchsorted(begin, off)])


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Package-merge: the best prefix code lengths of at most ``max_bits`` (0 where the count is 0)."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols don't fit codes of {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, levels = leaves, []
    is_leaf = np.ones(len(leaves), bool)
    for _ in range(max_bits - 1):
        levels.append(is_leaf)
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        by = np.argsort(both, kind="stable")
        level, is_leaf = both[by], by < len(leaves)
    levels.append(is_leaf)
    take, length = 2 * len(leaves) - 2, np.zeros(len(leaves), np.uint8)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        length[:n] += 1
        take = 2 * (take - n)
    out[order] = length
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol)."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for s in order[lengths[order] > 0].tolist():
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for each value of the next ``max_bits`` bits."""
    symbols, sizes = np.zeros(1 << max_bits, np.uint32), np.ones(1 << max_bits, np.uint8)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = np.int64(1) << (max_bits - lengths[order].astype(np.int64))
    n = int(span.sum())
    symbols[:n], sizes[:n] = np.repeat(order, span), np.repeat(lengths[order], span)
    return symbols, sizes


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, every: int = EVERY) -> tuple[bytes, np.ndarray]:
    """The codes of all ids, highest bit first, and the bit offset of every ``every``-th id."""
    size = lengths[ids]
    start = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(size, out=start[1:])
    total, start = int(start[-1]), start[:-1]
    out = np.zeros(total // 64 + 2, np.uint64)
    word, bit = start >> 6, (start & 63).astype(np.uint8)
    top = (codes << (64 - np.maximum(lengths, 1)).astype(np.uint64))[ids]  # each code in the highest bits
    if len(ids):
        groups = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[groups]] = np.bitwise_or.reduceat(top >> bit, groups)
        cross = np.flatnonzero(bit + size > 64)  # their last bits fall into the next word
        out[word[cross] + 1] |= top[cross] << (64 - bit[cross])
    return out.astype(">u8").tobytes()[: (total + 7) // 8], start[::every]


def unpack_bits(payload: bytes, n: int, checkpoints: np.ndarray, table: tuple[np.ndarray, np.ndarray], every: int = EVERY,
                max_bits: int = MAX_BITS) -> np.ndarray:
    """The ids: from every checkpoint one symbol a step, all checkpoints at once. Up to 25 bits a code, ids below 2^27."""
    symbols, sizes = table
    entries, left, mask = symbols << 5 | sizes, 32 - max_bits, np.uint32((1 << max_bits) - 1)
    buf = np.frombuffer(payload + bytes(16), np.uint8)
    window = np.ndarray((len(buf) - 3,), ">u4", buf.data, strides=(1,)).astype(np.uint32)
    at, rows = checkpoints.astype(np.int64), len(checkpoints)
    out = np.zeros((every, rows), np.uint32)
    full = rows - (n % every > 0)
    for k in range(min(every, n)):
        if k >= n - full * every:  # the last run is shorter
            at = at[:full]
        entry = entries[window[at >> 3] >> (left - (at & 7)).astype(np.uint32) & mask]
        out[k, :len(at)] = entry
        at = at + (entry & 31)
    return (out >> 5).T.reshape(-1)[:n]


def write_block(first: int, ids: np.ndarray, docs: np.ndarray, sizes: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """``first``: symbols before it in its file."""
    payload, checkpoints = pack_bits(ids, codes, lengths)
    return b"".join([MAGIC, struct.pack("<QQII", first, len(ids), len(docs), len(checkpoints)), docs.astype("<i8").tobytes(),
                     sizes.astype("<u8").tobytes(), checkpoints.astype("<u8").tobytes(), payload])


def read_block(block: bytes, table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """first, ids, docs, sizes."""
    if block[:4] != MAGIC:
        raise ValueError("not a block")
    first, n, n_docs, n_checks = struct.unpack_from("<QQII", block, 4)
    at = 4 + struct.calcsize("<QQII")
    docs = np.frombuffer(block, "<i8", n_docs, at)
    sizes = np.frombuffer(block, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
    checks = np.frombuffer(block, "<u8", n_checks, at + 16 * n_docs)
    return first, unpack_bits(block[at + 16 * n_docs + 8 * n_checks:], n, checks, table), docs, sizes


def tokenize(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids of its text with the end id, as little-endian uint16 or uint32 (``wide``)."""
    def run(batches):
        codec = ByteBpe.of(vocabulary)
        wide = codec.tokenizer.get_vocab_size() > 1 << 16 or end_id >= 1 << 16
        for b in slices(batches, text_col, SLICE):
            ids, sizes = codec.encode_all(b.column(1))
            ends = np.cumsum(sizes)
            ids = np.insert(ids, ends, end_id).astype("<u4" if wide else "<u2")
            border = np.concatenate([[0], np.cumsum(sizes + 1)])
            data = ids.tobytes()
            w = ids.itemsize
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([data[x * w:y * w] for x, y in zip(border, border[1:])], pa.binary()),
                                              pa.array([wide] * b.num_rows)], ["doc_id", "ids", "wide"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, ids binary, wide boolean")


def as_ids(ids: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(ids, "<u4" if wide else "<u2").astype(np.int64)


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in the corpus: a count per id and task, added up (a row per id at most)."""
    def count(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, COUNTED_ROWS):
                data, wide = b.column(0).slice(at, COUNTED_ROWS).to_pylist(), b.column(1).slice(at, COUNTED_ROWS).to_pylist()
                for kind in set(wide):
                    n = np.bincount(as_ids(b"".join([d for d, w in zip(data, wide) if w == kind]), kind))
                    if len(n) > len(total):
                        total = np.concatenate([total, np.zeros(len(n) - len(total), np.int64)])
                    total[:len(n)] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    rows = tokens.select("ids", "wide").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def write_token_files(tokens: DataFrame, path: str) -> None:
    """Files of blocks below ``path``/blocks, in ascending document id from file to file and inside each;
    ``path``/book holds the code lengths. Null ids are written as the smallest number, first."""
    spark = tokens.sparkSession
    lengths = code_lengths(id_counts(tokens))
    codes = canonical_codes(lengths)
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").coalesce(1).write.parquet(f"{path}/book")
    null = np.iinfo(np.int64).min

    def blocks(batches):
        from pyspark import TaskContext
        file, number, first = TaskContext.get().partitionId(), 0, 0
        held, docs, n = [], [], 0

        def flush():
            nonlocal number, first, held, docs, n
            ids = np.concatenate(held)
            block = write_block(first, ids, np.array(docs, np.int64), np.fromiter(map(len, held), np.int64, len(held)), codes, lengths)
            row = pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([number], pa.int64()), pa.array([n], pa.int64()),
                                              pa.array([block], pa.binary())], ["file", "number", "n", "block"])
            number, first, held, docs, n = number + 1, first + n, [], [], 0
            return row

        for b in batches:
            for doc, data, wide in zip(*(c.to_pylist() for c in b.columns)):
                ids = as_ids(data, wide)
                if n and n + len(ids) > BLOCK_SYMBOLS:
                    yield flush()
                held.append(ids)
                docs.append(null if doc is None else doc)
                n += len(ids)
        if n:
            yield flush()

    tokens.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", F.length("ids"), "ids") \
        .mapInArrow(blocks, "file int, number long, n long, block binary") \
        .write.option("compression", "none").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str, rows, schema: str) -> DataFrame:
    """One row per document; ``rows`` makes it of (docs, starts, ids, border): document ids, the number of
    ids before each in the whole corpus, all ids of the block, and where each document's ids begin and end."""
    table_bits = spark.read.parquet(f"{path}/book").first().lengths
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = blocks.groupBy("file").agg(F.sum("n").alias("n")).collect()  # a row per file
    before, at = {}, 0
    for r in sorted(totals, key=lambda r: r.file):
        before[r.file], at = at, at + r.n
    table: list = []

    def run(batches):
        if not table:
            table.append(decode_table(np.frombuffer(table_bits, np.uint8)))
        for b in batches:
            for file, block in zip(b.column(0).to_pylist(), b.column(1)):
                first, ids, docs, sizes = read_block(block.as_py(), table[0])
                border = np.concatenate([[0], np.cumsum(sizes)])
                yield rows(docs, before[file] + first + border[:-1], ids, border)

    return blocks.select("file", "block").mapInArrow(run, schema)


def _digest(docs, starts, ids, border):
    null = np.iinfo(np.int64).min
    ids = ids.astype("<u4")
    return pa.RecordBatch.from_arrays(
        [pa.array(docs, pa.int64(), mask=docs == null), pa.array(starts, pa.int64()), pa.array(np.diff(border), pa.int64()),
         pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(border, border[1:])], pa.int64())],
        ["doc_id", "start", "n_tokens", "ids_crc32"])


def op6(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write the files, read them back, and return what the contract asks of each document.

    Every row is a document: repeated rows are written as often as they come; equal ids stand next to
    each other, in order of their ids' length and bytes."""
    spark = docs.sparkSession
    path = scratch_path(spark, "llm-token-files")
    write_token_files(cut_zstd(tokenize(docs, vocabulary, end_id), "tokens"), path)
    return read_token_files(spark, path, _digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def cut_zstd(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)
