import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from docweave.llm.queries import QUERIES
from docweave.llm.token_file import EVERY, ByteBpe, canonical_codes, code_lengths, decode_table, op6, pack_bits, read_block, unpack_bits, write_block

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, "a", "  x  y ", "<|endoftext|>hi A", " lead", "tail ", "tail  ", "a \n b", "a\n\n b", "x\x1cy\x85z\xa0w　q​z  k", "it's we'll I'M 'S",
       "aaaa" * 300, "12 3456 a1b2", "日本語テキスト!!  　 x", "\x00\x01", "\n", "\r\n x", "' 's  's", "a  ", "   ", "x .y, z. \t.", "　 a", "a 　"]


def brute(rows):
    library = Tokenizer.from_file(PATH)
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_ids_as_the_library():
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choice("ab cdé,.'\n \t 12日") for _ in range(rnd.randrange(120))) for _ in range(400)]
    library = Tokenizer.from_file(PATH)
    ids, counts = ByteBpe(PATH).encode_all(pa.array(texts))
    for t, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert got.tolist() == library.encode(t or "", add_special_tokens=False).ids, t


@pytest.mark.parametrize("bits", [4, 6, 18])
def test_lengths_are_limited_and_complete(bits):
    counts = np.array([2 ** i for i in range(12)] + [0, 0])
    lengths = code_lengths(counts, bits)
    assert lengths.max() <= bits and sum(2.0 ** -int(x) for x in lengths if x) == 1.0 and not lengths[12:].any()
    if bits == 18:  # no limit met: as Huffman's
        assert sorted(lengths[:12].tolist()) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 11]


def test_best_under_the_limit():
    """Against all length vectors of a small alphabet."""
    from itertools import product
    counts = np.array([1, 1, 2, 30, 50])
    best = min(int((counts * np.array(x)).sum()) for x in product(range(1, 4), repeat=5) if sum(2.0 ** -k for k in x) <= 1)
    assert int((counts * code_lengths(counts, 3)).sum()) == best


@pytest.mark.parametrize("n", [0, 1, 5, EVERY - 1, EVERY, EVERY + 1, 3 * EVERY, 5000])
def test_blocks_round_trip(n):
    rnd = np.random.default_rng(n)
    ids = np.minimum(rnd.geometric(0.01, n), 3000).astype(np.int64)
    lengths = code_lengths(np.bincount(ids, minlength=3001))
    codes, table = canonical_codes(lengths), decode_table(lengths)
    payload, checks = pack_bits(ids, codes, lengths)
    assert (unpack_bits(payload, n, checks, table) == ids).all()
    sizes = np.array([n // 2, n - n // 2])
    first, back, docs, got = read_block(write_block(9, ids, np.array([4, -7]), sizes, codes, lengths), table)
    assert first == 9 and (back == ids).all() and docs.tolist() == [4, -7] and (got == sizes).all()


def test_brute_force(frame, odd_rows):
    rows = [r for r in odd_rows if r[0] not in (None, 5)] + [(None, "no id")] + list(enumerate(ODD, 100))
    key = lambda r: (r[0] is not None, r[0], r[1])
    assert sorted(map(tuple, op6(frame(rows), PATH).collect()), key=key) == brute(rows)


def test_empty(frame):
    assert op6(frame([]), PATH).collect() == []


def test_registered(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op6_token_file"](spark, d).collect())) == brute(rows)


def test_words_and_pieces_are_laid_out_in_order():
    """Parts that are one piece stand beside parts of several pieces or none."""
    from docweave.llm import common
    words, index, counts = common.unique_words(pa.array(["b a  b", None, "", "é日 x\n", "a"]))
    assert [words[i] for i in index] == ["b", "a", "", "b", "", "", "é日", "x\n", "a"] and counts.tolist() == [4, 1, 1, 2, 1]
    assert len(set(words)) == len(words)

    cache = common.PieceCache(10)
    encode = lambda pieces: (np.array([ord(c) for p in pieces for c in p], np.uint32), np.array([len(p) for p in pieces]))
    got, sizes = cache.lay_out(["ab", ["c", "de"], [], "f"], np.array([1, 0, 3, 2, 1]), np.array([2, 0, 3]), encode)
    assert "".join(map(chr, got)) == "cdeabfcde" and sizes.tolist() == [5, 0, 4]


def test_words_are_encoded_many_in_a_call():
    """New words take a call of the library's model per ``JOINED`` words, not one each; known ones none."""
    codec, calls = ByteBpe(PATH), []
    library, model = codec.tokenizer, codec.tokenizer.model

    class Counted:
        def tokenize(self, text):
            calls.append(text)
            return model.tokenize(text)

    class Stub:
        model, pre_tokenizer = Counted(), library.pre_tokenizer

    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdeéàж") for _ in range(rnd.randrange(3, 12))) for _ in range(4000)]
    texts = [" ".join(w + rnd.choice(["", "", ",", ".\nThe", "!!", "$$$"]) for w in words[i:i + 100]) for i in range(0, 4000, 100)]
    codec.tokenizer = Stub()
    for most in (1000, 0):  # those that end in à, whose last byte may merge with a blank, and the texts' first words go alone
        calls.clear()
        ids, _ = codec.encode_all(pa.array(texts))
        assert len(calls) <= most
        assert ids.tolist() == [i for e in library.encode_batch(texts, add_special_tokens=False) for i in e.ids]


def test_texts_are_cut_at_certain_borders():
    """Every letter of the cut alphabets, and others, beside line ends, signs, digits and apostrophes."""
    codec, library = ByteBpe(PATH), Tokenizer.from_file(PATH)
    some = [*range(0x500), *range(0x1F00, 0x2100), *range(0x3000, 0x3100)]
    texts = [x for c in map(chr, some) for x in (f"a{c}.\n{c}b", f"x.{c}5{c}", f"{c}\n{c}'s{c}", f"\n{c} {c}!")]
    rnd = random.Random(4)
    texts += ["".join(rnd.choice(["a", "é", "×", "5", "²", "\n", " ", ".", "'s", "!'", "_", "\x0b", "　", "。", "́", "\0"]) for _ in range(12))
              for _ in range(3000)]
    ids, counts = codec.encode_all(pa.array(texts))
    want = library.encode_batch(texts, add_special_tokens=False)
    for t, got, e in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), want):
        assert got.tolist() == e.ids, t


def test_cache_is_emptied_when_full(monkeypatch):
    from docweave.llm import token_file
    codec, library = ByteBpe(PATH), Tokenizer.from_file(PATH)
    for name, limit in (("CACHE_ENTRIES", 5), ("CACHE_CHARACTERS", 40)):
        monkeypatch.setattr(token_file, name, limit)
        for k in range(6):
            text = " ".join(f"{'xyz'[k % 3] * n}{k}," for n in range(1, 9))
            ids, _ = codec.encode_all(pa.array([text]))
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
            assert len(codec.parts.at) <= 40 and codec.held <= 200
        monkeypatch.undo()
