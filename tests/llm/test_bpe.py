import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docweave.llm.bpe import WordBpe, decode_documents, encode_documents, op10
from docweave.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "a", "  x  y ", "<|endoftext|>hi<|startoftext|> A", "ΑΣ ΟΔΟΣ Σ", "İstanbul", "á é", "x\x1cy\x85z\xa0w　q​z", "it's we'll I'M 'S",
       "aaaa" * 300, "12 3456", "日本語テキスト!!", "\x00\x01", "é" * 200, "ſt ǅ ß ẞ", "<|endoftext|", "퟿😀😀", " ' ' 's", "ﬁ Å", "ab.cd,", ".", "x" * 5000]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def random_texts(n, seed=3):
    rnd = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzABCÄÖéñç012 ,.'!?-\n\t日本"
    return ["".join(rnd.choice(letters) for _ in range(rnd.randrange(200))) for _ in range(n)]


def test_ids_and_texts_as_the_library(library):
    texts = ODD + random_texts(300)
    codec = WordBpe(PATH)
    for _ in range(2):  # the second time from the cache
        ids, counts = codec.encode_all(texts)
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for t, got in zip(texts, parts):
            want = library.encode(t, add_special_tokens=False).ids
            assert got.tolist() == want, t
            assert codec.decode(got) == library.decode(want, skip_special_tokens=False)


def test_long_and_short_merges_agree():
    codec = WordBpe(PATH)
    for w in [w for t in random_texts(60, 9) for w in t.split()] + ["a" * 200, "ab" * 150]:
        raw = w.encode()
        symbols = [codec.inner[b] for b in raw[:-1]] + [codec.last[raw[-1]]]
        ids, alive = codec.merge_in_step(np.array(symbols), np.array([len(symbols)]))
        assert codec.merge_long(symbols) == ids[alive].tolist()


def test_no_token_spans_a_forced_boundary():
    codec = WordBpe(PATH)
    assert all((a, b) in codec.together for a, b in codec.merges if a in codec.inner and b in codec.inner)


def test_digests(frame, odd_rows, library):
    rows = odd_rows + list(enumerate(ODD, 100))
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, op10(frame(rows), PATH).collect()), key=str) == sorted(want, key=str)


def test_round_trip_of_documents(frame, library):
    rows = list(enumerate(ODD + [None]))
    got = dict(map(tuple, decode_documents(encode_documents(frame(rows), PATH), PATH).collect()))
    assert got == {i: library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for i, t in rows}


def test_empty(frame):
    assert op10(frame([]), PATH).collect() == []


def test_registered(spark):
    d = "/root/testdata/sf0.001"
    assert QUERIES["op10_bpe"](spark, d).count() == spark.read.parquet(f"{d}/documents.parquet").count()
