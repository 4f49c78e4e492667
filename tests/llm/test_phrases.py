import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docweave.llm import phrases
from docweave.llm.phrases import advance, build_trie, mine_phrases, op13
from oracle import same


def brute(rows, min_count, max_words):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                f.setdefault((lang, k), Counter()).update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for (lang, k), c in f.items():
        longer = [(p, a) for m in range(k + 1, max_words + 1) for p, a in f[lang, m].items() if a >= min_count]
        for p, a in c.items():
            if k < 2 or a < min_count or any(b >= a and p in [q[i:i + k] for i in range(len(q) - k + 1)] for q, b in longer):
                continue
            score, j = min((1000 * a * n[lang] // (f[lang, j][p[:j]] * f[lang, k - j][p[j:]]), j) for j in range(1, k))
            out.append((lang, " ".join(p), a, f[lang, j][p[:j]], f[lang, k - j][p[j:]], n[lang], score))
    return sorted(out)


def frame_of(spark, rows, parts=3):
    schema = "text string, lang string, sym int, n long, key string"
    rows = [(t, lang, 1, 2, "x") for t, lang in rows]
    return spark.createDataFrame(rows, schema).repartition(parts) if rows else spark.createDataFrame([], schema)


def mined(spark, rows, min_count, max_words=5, **kw):
    df = mine_phrases(frame_of(spark, rows), min_count, max_words, **kw)
    return sorted(tuple(r[c] for c in ("lang", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(5)
    vocab = ["the", "new", "york", "Times", "éa", "a", "of", "日本", "x" * 40, "b.c", "d-e", "\x00f"]
    out = []
    for i in range(300):
        w = [vocab[int(x)] for x in rnd.zipf(1.4, int(rnd.integers(0, 60))) % len(vocab)]
        if i % 2:
            w[3:3] = "In the New York stock market".split()
        out.append((rnd.choice([" ", "\t ", ", ", "\n"]).join(w) if i % 9 == 0 else " ".join(w) + rnd.choice([".", "!\n", "", "?a b"]), ["en", "de", None, "und"][i % 4]))
    out += [(None, "en"), ("", None), (" \t ", "fr"), ("...", "en"), ("the new", "en"), ("the new", "en"), ("z" * 100_000, "en"), ("of the " * 20_000, "long"),
            (" x y", "en"), ("x y ", "en")]
    return out


@pytest.mark.parametrize("min_count,max_words", [(20, 5), (3, 4)])
def test_equals_brute_force(spark, rows, min_count, max_words):
    got = mined(spark, rows, min_count, max_words)
    assert got == brute(rows, min_count, max_words) and len(got) > 20


def test_many_blocks_and_crowded_buckets(spark, rows):
    got = mined(spark, rows[:120], 5, block_phrases=400, bucket_bits=5)
    assert got == brute(rows[:120], 5, 5)


def test_rare_phrases_that_share_a_bit_are_no_candidates(spark, rows, monkeypatch):
    """The bitmap fills up as the corpus grows; candidates must not grow with what falls into its bits."""
    seen, real = [], phrases.exact_counts

    def exact_counts(spark, codes, candidates, *a):
        seen.append(candidates.count())
        return real(spark, codes, candidates, *a)

    monkeypatch.setattr(phrases, "exact_counts", exact_counts)
    w = [f"w{i % 40} v{i * 7 % 41}" for i in range(1640)]  # 1,640 pairs of frequent words, each in one place
    texts = [(". ".join(w), "en")] + [("new york city", "en")] * 50
    got = mined(spark, texts, 20, bucket_bits=5)
    assert got == brute(texts, 20, 5) and len(got) == 1 and seen == [3]


def test_small_families_stand_between_the_children_of_large_ones():
    rnd = np.random.default_rng(11)
    share = 1 / np.arange(1, 8001)
    words = rnd.permutation(8000) + 100
    rows = np.concatenate([np.column_stack([np.full(n, i), np.sort(words[rnd.choice(8000, n, False, share / share.sum())])])
                           for i, n in enumerate(np.maximum(2, 4000 // np.arange(1, 1500)), 10_000)]).astype(np.uint64)
    alphabet, base, check, state = build_trie(np.column_stack([rows, np.zeros((len(rows), 3), np.uint64)]))
    assert len(check) < 6.5 * len(rows), len(check) / len(rows)
    counts = np.zeros(len(check), np.int64)
    advance(np.column_stack([rows, np.zeros(len(rows), np.uint64)]).ravel(), (alphabet, base, check), 5, counts)
    assert (counts[state] == 1).all() and counts.sum() == len(rows)


def test_words_of_slices_are_added_up(spark, monkeypatch):
    """A slice is a megabyte; a word leaves a task once for many of them."""
    text = "one two three four. " * 200_000
    coded = phrases.encode(frame_of(spark, [(text, "en"), (text, "en"), ("one", "de")], 1), 1, "text", "lang").where("sym is not null")
    got = sorted((r.lang, r.word, r.n) for r in coded.collect())
    assert got == [("de", "one", 1)] + sorted(("en", w, 400_000) for w in ("one", "two", "three", "four"))
    # words that share a symbol stay apart
    held = [(np.array([5, 7], np.uint64), pa.array(["en", "en"]), pa.array([w, "x"]), np.array([2, 1])) for w in ("a", "a", "b")]
    sym, lang, word, n = phrases._summed(held)
    assert list(zip(sym.tolist(), word.to_pylist(), n.tolist())) == [(5, "a", 4), (5, "b", 2), (7, "x", 3)]


def test_a_phrase_is_sent_once_and_none_is_held_back(monkeypatch):
    monkeypatch.setattr(phrases, "SENT_BITS", 0)  # 4 places
    sent, rnd, want, got = phrases.Sent(2), np.random.default_rng(4), set(), set()
    for _ in range(50):
        rows = rnd.integers(1, 6, (20, 2)).astype(np.uint64)
        want |= set(map(tuple, rows.tolist()))
        got |= set(map(tuple, sent.new(rows, phrases._hashes(rows)).tolist()))
    assert got == want
    again = rows[-1:]
    assert len(sent.new(again, phrases._hashes(again))) == 0


def test_counts_of_a_chunk_are_added_up_in_parts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "ADDED_BUCKETS", 3)
    rnd = np.random.default_rng(8)
    units = [np.unique(rnd.integers(0, 1 << 42, 30) // (1 << 36) * (1 << 36) + rnd.integers(0, 3, 30), return_counts=True) for _ in range(40)]
    packs = [p for b, n in units for p in zip(*(c.to_pylist() for c in phrases._packs(b, n, 42).columns))]
    got = phrases._heavy_buckets(spark.createDataFrame(packs, "chunk int, pack binary"), 10, 42, 26)
    total = Counter()
    for b, n in units:
        total.update(dict(zip(b.tolist(), n.tolist())))
    want = sorted(b for b, n in total.items() if n >= 10)
    rows = got.collect()
    assert sorted((r.chunk << 32) + int(x) for r in rows for x in np.frombuffer(r.heavy, "<u4")) == want != []
    assert np.flatnonzero(np.unpackbits(phrases._marked(got, 26), bitorder="little")).tolist() == sorted({b >> 16 for b in want})


def test_another_seed_when_two_words_share_a_symbol(spark, monkeypatch):
    seeds, real = [], phrases.encode

    def encode(docs, seed, *a):
        seeds.append(seed)
        out = real(docs, seed, *a)
        return out.unionByName(out.where("sym is not null").limit(1).selectExpr("codes", "sym", "lang", "'other' as word", "n")) if seed == 1 else out

    monkeypatch.setattr(phrases, "encode", encode)
    rows = [("one two three", "en")] * 4
    assert mined(spark, rows, 2) == brute(rows, 2, 5) and seeds == [1, 2]


def test_trie_states_are_phrase_counts():
    rnd = np.random.default_rng(2)
    text = rnd.integers(1, 30, 5000).astype(np.uint64) * np.uint64(977)
    text[rnd.integers(0, 5000, 400)] = 0
    found = sorted({tuple(text[i:i + k].tolist()) for k in (2, 3, 4) for i in range(0, 4990, 3) if (text[i:i + k] != 0).all()})
    rows = np.array([[*p, *[0] * (5 - len(p))] for p in found], np.uint64)
    alphabet, base, check, state = build_trie(rows)
    counts = np.zeros(len(check), np.int64)
    advance(np.concatenate([text, np.zeros(1, np.uint64)]), (alphabet, base, check), 5, counts)
    want = Counter(tuple(text[i:i + k].tolist()) for k in (2, 3, 4) for i in range(5000 - k + 1))
    assert [counts[s] for s in state] == [want[p] for p in found]
    assert len(set(state.tolist())) == len(found) and base.min() >= 0


def test_packs_hold_each_phrase_once():
    rnd = np.random.default_rng(7)
    rows = rnd.integers(1, 4, (500, 3)).astype(np.uint64)
    got = phrases._distinct(rows)
    assert sorted(map(tuple, got.tolist())) == sorted({tuple(x) for x in rows.tolist()})
    assert len(phrases._distinct(rows[:0])) == 0 and len(phrases._distinct(rows[:1])) == 1


def test_rows_of_symbols_are_small_and_whole(spark):
    text = "one two three four. " * 20_000
    coded = phrases.encode(frame_of(spark, [(text, "en"), ("x " * 9_000, "en")], 1), 1, "text", "lang").where("codes is not null")
    found = [np.frombuffer(r.codes, "<u8") for r in coded.select("codes").collect()]
    assert sum((x != 0).sum() for x in found) == 89_000 and all(x[-1] == 0 for x in found)
    # a row of words that nothing parts stays whole, others are of about 1 KB: hundreds of them made a page of Parquet
    sizes = sorted(map(len, found))
    assert sizes[-1] >= 9_001 and sizes[-2] < 2 * phrases.ROW_SYMBOLS <= 256 and len(sizes) > 500


@pytest.mark.parametrize("bits", [5, 20])
def test_heavy_buckets_are_those_of_all_packs(spark, monkeypatch, bits):
    monkeypatch.setattr(phrases, "HELD_BUCKETS", 100)
    monkeypatch.setattr(phrases, "READ_SYMBOLS", 50)
    rnd = np.random.default_rng(3)
    rows = [np.append(rnd.zipf(1.3, 40) % 500 + 1, 0).astype("<u8") for _ in range(60)]
    codes = spark.createDataFrame([(bytearray(x.tobytes()),) for x in rows], "codes binary").repartition(4)
    maps = spark.sparkContext.broadcast([np.full(1 << (bits - 3), 255, np.uint8)])
    want = Counter(int(b) for x in rows for b in phrases._bucket(phrases._longer(x[:-2], x[1:-1]), bits))
    got = np.unpackbits(phrases._bitmap(phrases._bucket_counts(codes, maps, 2, bits), 30, bits), bitorder="little")
    assert len(got) == 1 << bits and set(np.flatnonzero(got).tolist()) == {b for b, n in want.items() if n >= 30} != set()


def test_batches_are_small_while_it_runs(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = spark.range(0, 200, numPartitions=1).selectExpr("repeat('x', 100000) as t")
    with phrases.small_batches(spark):
        got = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(got) >= 20_000_000 and max(got) < 2 * phrases.BATCH_BYTES
    mined(spark, [("a b", "en")], 1)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_empty(spark):
    assert op13(frame_of(spark, [])).collect() == []
    assert op13(frame_of(spark, [(None, None), ("", "en")])).collect() == []


def test_registered_equals_sql(spark):
    same(spark, "op13_phrases", "/root/testdata/sf0.001")
